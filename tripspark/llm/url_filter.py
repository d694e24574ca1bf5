"""URL filters: host and path rules, and a cascade of Bloom filters for listed keys.

The first level of the cascade holds the listed keys; every further level holds
the keys that the level before lets through though it should not, in turn of
listed and unlisted ones, over all keys of the corpus. When no false one is
left the cascade answers exactly for every key of the corpus, and a row is
judged by a few hashes of its own key: no join, no shuffle of the pages. Levels
are arrays of 64-bit words, worked out by grouping bit positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import ascii_lower, cut

#: (action, host, path) of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words between the dots and hyphens of a host whose pages the query lists.
SPAM_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: Bits of all levels that may be sent to every task: 64 MB.
MOST_BITS = 1 << 29


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host + path; the longer host first, block before allow) that fits and its action, or null. A short list: it becomes one expression."""
    name = action = None
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r)):
        name = F.when(fits(h, p), F.lit(h + p)) if name is None else name.when(fits(h, p), F.lit(h + p))
        action = F.when(fits(h, p), F.lit(act)) if action is None else action.when(fits(h, p), F.lit(act))
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, action)


class Level:
    """One Bloom filter: ``size`` bits in 64-bit words, ``hashes`` positions a key, and the one-row table with the words."""

    def __init__(self, keys: DataFrame, number: int, n: int, rate: float) -> None:
        self.number, self.hashes = number, max(1, round(-math.log2(rate)))
        self.size = 64 * max(1, math.ceil(n * self.hashes / math.log(2) / 64))
        at = F.explode(F.array(*(self._position(F.col("key"), j) for j in range(self.hashes))))
        spark = keys.sparkSession
        words = keys.select(at.alias("at")).select(F.expr("at div 64").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
        words = words.groupBy("w").agg(F.bit_or("bits").alias("bits")).unionByName(spark.range(self.size // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("bits")))
        words = words.groupBy("w").agg(F.bit_or("bits").alias("bits"))
        # at most MOST_BITS / 64 words meet in one row
        self.words = cut(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words")))

    def _position(self, key: Column, j: int) -> Column:
        # the number is hashed first, so keys with equal hashes on one level part on the next
        return F.pmod(F.xxhash64(F.lit(self.number), F.lit(j), key), F.lit(self.size).cast("bigint"))

    def holds(self, key: Column) -> Column:
        """Whether the filter holds the key; the words come in as one value per job (a scalar subquery)."""
        words, all_set = self.words.scalar(), F.lit(True)
        for j in range(self.hashes):
            at = self._position(key, j)
            all_set = all_set & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return all_set


def cascade(keys: DataFrame, later_rate: float = 1 / 16, most_bits: int = MOST_BITS) -> list[Level] | None:
    """The levels for ``keys`` (key, listed), distinct. None if they would take over ``most_bits``.

    The first level lets through about as many unlisted keys as there are listed ones;
    each later one ``later_rate`` of what it should keep out, so levels shrink fast.
    """
    keys = cut(keys)
    inside, outside, levels = keys.where("listed").select("key"), keys.where("NOT listed").select("key"), []
    counts = {r.listed: r.n for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, rate, bits = counts.get(True, 0), min(0.5, counts.get(True, 0) / max(1, counts.get(False, 0))), 0
    while n:
        bits += n * max(1, round(-math.log2(rate))) / math.log(2) + 64
        if bits > most_bits:
            return None
        level = Level(inside, len(levels), n, rate)
        levels.append(level)
        inside, outside = cut(outside.where(level.holds(F.col("key")))), inside
        n, rate = inside.count(), later_rate
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for the keys that the cascade was made for: the first level that does not hold the key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.holds(key), F.lit(level.number % 2 == 1)).otherwise(out)
    return out


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", later_rate: float = 1 / 16, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    verdict: the action of the longest rule that fits, else block if the page's key
    (host and path) is in ``listed`` (a column ``key``), else allow. A rule fits its host and
    all subdomains where the path starts with the rule's. Keys of the list that no page has
    are of no account. A null url, or one without ``://``, has an empty host, path and key.
    Repeated rows and ids are judged each for itself; null keys of the list are passed
    over; empty tables give no rows or list nothing. Other columns are not read.

    A cascade over ``most_bits`` is not sent to all tasks: the keys are then looked
    up by a plain join, with the same result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    key = F.concat("host", "path")
    own = rows.select(key.alias("key"), F.lit(True).alias("own"), F.lit(False).alias("listed"))
    given = listed.where("key IS NOT NULL").select("key", F.lit(False).alias("own"), F.lit(True).alias("listed"))
    # all keys of the corpus, each once, and whether it is listed: one shuffle of slim rows, summed before
    keys = own.unionByName(given).groupBy("key").agg(F.max("own").alias("own"), F.max("listed").alias("listed")).where("own").select("key", "listed")
    levels = cascade(keys, later_rate, most_bits)
    if levels is None:
        hits = given.select(F.col("key").alias("hit")).distinct()
        rows = rows.join(hits, key == F.col("hit"), "left").withColumn("listed", F.col("hit").isNotNull())
    else:
        rows = rows.withColumn("listed", is_listed(key, levels))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


SPAM_HOST = rf"(^|[.-])({'|'.join(SPAM_WORDS)})([.-]|$)"


def spam_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The keys of pages whose host has one of SPAM_WORDS between dots and hyphens."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return rows.where(F.col("host").rlike(SPAM_HOST)).select(F.concat("host", "path").alias("key"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, spam_keys(pages))


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'" for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
ORACLE = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {_FITS} END AS fit, regexp_matches(host, '{SPAM_HOST}') AS listed FROM u)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r
"""
