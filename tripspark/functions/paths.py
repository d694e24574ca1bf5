"""Clip paths: their canonical form, kind and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_clip_path(file: Column) -> Column:
    """Forward slashes; one leading ``RecentClips/`` goes unless nothing would remain."""
    return F.regexp_replace(F.translate(file, "\\", "/"), "^RecentClips/(?=.)", "")


def is_event_clip(path: Column) -> Column:
    """Is a canonical path in one of the two event folders?"""
    return path.startswith("SavedClips/") | path.startswith("SentryClips/")


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def clip_timestamp_ms(path: Column, tz: str = "UTC") -> Column:
    """Epoch milliseconds of the first ``YYYY-MM-DD_HH-MM-SS`` in the base name, local in ``tz``; null if none or invalid.

    24:00:00 is the next midnight. Daylight saving: an hour that occurs twice is the
    earlier one, an hour that does not occur counts by the offset before the gap.
    """
    name = base_name(path)
    pattern = r"(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})"
    y, mo, d, h, mi, s = (F.regexp_extract(name, pattern, k) for k in range(1, 7))
    midnight = (h == "24") & (mi == "00") & (s == "00")
    text = F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit(" "), F.when(midnight, "00").otherwise(h), F.lit(":"), mi, F.lit(":"), s)
    local = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    local = F.when(midnight, local + F.expr("INTERVAL 1 DAY")).otherwise(local)
    return F.when(F.regexp_like(name, F.lit(pattern)), F.unix_millis(F.to_utc_timestamp(local, tz)))


def repair_timestamp_ms(file: Column, tz: str = "UTC") -> Column:
    """Epoch milliseconds of the first ``YYYY-MM-DD_HH-MM-SS`` anywhere in a path, local in ``tz``, as the repair of clips reads it; null if none or invalid.

    Unlike clip_timestamp_ms it takes folders in, and days up to 31 of any month: those past
    its end run on into the next. 24:00:00 is the next midnight. Only the first match counts.
    """
    found = F.regexp_extract(file, r"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}", 0)
    part = lambda a, n: F.substring(found, a, n).try_cast("int")
    year, month, day, hour, minute, second = part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2)
    good = month.between(1, 12) & day.between(1, 31) & ((hour < 24) & (minute < 60) & (second < 60) | (hour == 24) & (minute == 0) & (second == 0))
    first = F.when(good, F.concat(F.substring(found, 1, 8), F.lit("01"))).try_cast("timestamp_ntz")
    local = first + F.make_dt_interval(day - 1, hour, minute, second.cast("decimal(18,6)"))
    return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), tz))


def external_signature(source: Column, start_ms: Column, odometer_text: Column) -> Column:
    """``source:minute:odometer`` with the odometer at two decimals as text, or ``x``."""
    return F.concat_ws(":", source, F.floor(start_ms / 60000).cast("string"), F.coalesce(odometer_text, F.lit("x")))


def clip_file_name(source: Column, start_ms: Column, signature: Column) -> Column:
    """``source/date/date_time-front-source-signature.mp4``; of the signature, without its source, letters, digits and ``_`` stay."""
    t = F.timestamp_millis(start_ms)
    safe = F.regexp_replace(F.regexp_replace(signature, "^[a-z]+:", ""), "[^A-Za-z0-9_]", "")
    return F.concat(source, F.lit("/"), F.date_format(t, "yyyy-MM-dd"), F.lit("/"), F.date_format(t, "yyyy-MM-dd_HH-mm-ss"), F.lit("-front-"), source, F.lit("-"), safe, F.lit(".mp4"))
