"""Drives from a stream of clips, with recording holes filled by event clips that may come late."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VEHICLE = "seen bigint, ordinary bigint, kept bigint, before bigint, last bigint, has boolean, start bigint, end bigint, n bigint, filled bigint"
#: Times and kinds (event clip or not) of the clips that are waiting and of those that are held.
CLIPS = "waiting array<bigint>, waiting_event array<boolean>, held array<bigint>, held_event array<boolean>"
DRIVE = "start_ms bigint, end_ms bigint, n bigint, filled bigint"
_NAMES = [f.split()[0] for f in VEHICLE.split(", ")]
_NONE = 1 << 60


class HoleDrivesProcessor:
    """Per vehicle: clips after the watermark (waiting), clips up to it that are not settled yet (held), and the open drive.

    Rows up to the watermark are complete, so they are thinned for good. An event clip is
    settled when it is known to be let in (it lies in a hole, or its chain has met an ordinary
    clip and one is near) or left out (no ordinary clip can come near any more, or its chain
    has ended without one). Held rows leave in order of time and extend the open drive, so the state is
    what the last ``max_ms`` and the last open chain hold.
    """

    def __init__(self, min_ms: int, max_ms: int, hop_ms: int, thin_ms: int, gap_ms: int) -> None:
        self.min_ms, self.max_ms, self.hop_ms, self.thin_ms, self.gap_ms = min_ms, max_ms, hop_ms, thin_ms, gap_ms

    def thinned(self, now: dict, rows: pd.DataFrame) -> list[tuple[int, bool]]:
        """(t, event) of rows that are complete: ordinary clips, and event clips that neither one of those nor the event clip kept before covers."""
        return self._thin(now, rows["t"].to_numpy(np.int64), rows["event"].to_numpy(bool))

    def _thin(self, now: dict, t: np.ndarray, event: np.ndarray) -> list[tuple[int, bool]]:
        # of event clips of one time any one is kept, as only its time goes on
        order = np.lexsort((event, t))
        t, event = t[order], event[order]
        upto = np.maximum.accumulate(np.concatenate([[-_NONE if now["ordinary"] is None else now["ordinary"]], np.where(event, -_NONE, t)]))
        now["ordinary"] = None if upto[-1] == -_NONE else int(upto[-1])
        free = t[event & (t - upto[1:] > self.thin_ms)]
        kept, at = [], 0 if now["kept"] is None else int(np.searchsorted(free, now["kept"] + self.thin_ms, "right"))
        while at < len(free):
            kept.append(int(free[at]))
            at = int(np.searchsorted(free, free[at] + self.thin_ms, "right"))
        now["kept"] = kept[-1] if kept else now["kept"]
        return sorted([(x, False) for x in t[~event].tolist()] + [(x, True) for x in kept])

    def settle(self, now: dict, held: list[tuple[int, bool]], until: int) -> tuple[list[tuple], list[tuple[int, bool]]]:
        """The drives that end, and the rows that stay undecided. All rows up to ``until`` are among ``held`` or settled."""
        out: list[tuple] = []
        if held:
            t, event = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], bool)
            before = np.maximum.accumulate(np.concatenate([[-_NONE if now["before"] is None else now["before"]], np.where(event, -_NONE, t)]))[1:]
            after = np.minimum.accumulate(np.where(event, _NONE, t)[::-1])[::-1]
            chain = np.cumsum(np.diff(t, prepend=-_NONE if now["last"] is None else now["last"]) > self.hop_ms)
            met = np.bincount(chain, ~event, chain[-1] + 1) > 0
            met[0] |= bool(now["has"])
            ended = (chain < chain[-1]) | (until >= t[-1] + self.hop_ms)
            span, has = after - before, met[chain]
            hole = (before < t) & (t < after) & (span > self.min_ms) & (span <= self.max_ms)
            near = (t - before <= self.max_ms) | (after - t <= self.max_ms)
            let_in = ~event | hole | (has & near)
            no_hole = (after < _NONE) | (before == -_NONE) | (until - before >= self.max_ms)
            never_near = ~near & ((after < _NONE) | (until >= t + self.max_ms))
            settled = let_in | no_hole & (never_near | ended & ~has)
            k = len(t) if settled.all() else int(settled.argmin())
            if k:
                now.update(before=None if before[k - 1] == -_NONE else int(before[k - 1]), last=int(t[k - 1]), has=bool(has[k - 1]))
                out += self._extend(now, t[:k][let_in[:k]], event[:k][let_in[:k]])
            held = held[k:]
        if now["start"] is not None and (held[0][0] if held else until + 1) - now["end"] > self.gap_ms:
            out += self._end(now)
        return out, held

    def _extend(self, now: dict, t: np.ndarray, event: np.ndarray) -> list[tuple]:
        out: list[tuple] = []
        if not len(t):
            return out
        cuts = np.flatnonzero(np.diff(t, prepend=t[0] if now["start"] is None else now["end"]) > self.gap_ms)
        for a, b in zip([0, *cuts], [*cuts, len(t)]):
            if a < b:
                if now["start"] is not None and t[a] - now["end"] > self.gap_ms:
                    out += self._end(now)
                if now["start"] is None:
                    now.update(start=int(t[a]), n=0, filled=0)
                now.update(end=int(t[b - 1]), n=now["n"] + int(b - a), filled=now["filled"] + int(event[a:b].sum()))
        return out

    def _end(self, now: dict) -> list[tuple]:
        out = (now["start"], now["end"], now["n"], now["filled"])
        now.update(start=None, end=None, n=None, filled=None)
        return [out]

    def next_time(self, now: dict, waiting: pd.DataFrame | dict[str, np.ndarray], held: list[tuple[int, bool]], until: int) -> int | None:
        """The least watermark that can change something."""
        times = [int(waiting["t"].min())] if len(waiting["t"]) else []
        if held:
            times += [held[0][0] + self.max_ms, held[-1][0] + self.hop_ms]
        elif now["start"] is not None:
            times.append(now["end"] + self.gap_ms)
        return min((x for x in times if x > until), default=None)

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A step of one vehicle: its new clips, or none at its time-out."""
        until = state.getCurrentWatermarkMs()
        old = state.get if state.exists else (*[None] * len(_NAMES), [], [], [], [])
        now, (waiting, kinds, held, held_kinds) = dict(zip(_NAMES, old)), old[len(_NAMES):]
        new = [] if state.hasTimedOut else list(parts)
        t = np.concatenate([np.array(waiting, np.int64), *(p["t_ms"].to_numpy(np.int64) for p in new)])
        event = np.concatenate([np.array(kinds, bool), *(p["event"].to_numpy(bool) for p in new)])
        if now["seen"] is not None:
            t, event = t[t > now["seen"]], event[t > now["seen"]]  # later than the watermark allows
        ready = t <= until
        rows = list(zip(held, held_kinds))
        if ready.any():
            rows += self._thin(now, t[ready], event[ready])
        out, rows = self.settle(now, rows, until)
        now["seen"] = until if now["seen"] is None else max(now["seen"], until)
        t, event = t[~ready], event[~ready]
        plain = tuple(None if now[k] is None else bool(now[k]) if k == "has" else int(now[k]) for k in _NAMES)
        state.update((*plain, t.tolist(), event.tolist(), [int(r[0]) for r in rows], [bool(r[1]) for r in rows]))
        at = self.next_time(now, {"t": t}, rows, until)
        if at is not None:
            state.setTimeoutTimestamp(max(1, at - 1))  # comes once the watermark has passed it
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["vehicle_id", "start_ms", "end_ms", "n", "filled"])


def stream_filled_drives(clips: DataFrame, min_ms: int = 90_000, max_ms: int = 1_800_000, hop_ms: int = 180_000, thin_ms: int = 30_000, gap_ms: int = 300_000, delay: str = "1 hour") -> DataFrame:
    """Drives as they end: vehicle_id, start_ms, end_ms, n clips and how many of them filled holes; the rows of fill_holes followed by sessionize_drives.

    Expects t (timestamp), t_ms, is_event, driving. Event clips, which are often copied later than
    others, count as long as they come within ``delay``; a clip is settled once the watermark has
    passed it by ``max_ms`` at most, or its chain of event clips has ended. A vehicle's state is one row; the RocksDB state store keeps it off the heap.
    """
    kind = clips.schema["vehicle_id"].dataType.simpleString()
    rows = clips.where("t_ms IS NOT NULL AND (NOT is_event OR driving)").withWatermark("t", delay)
    rows = rows.select("vehicle_id", "t", F.col("is_event").alias("event"), F.col("t_ms").cast("bigint").alias("t_ms"))
    processor = HoleDrivesProcessor(min_ms, max_ms, hop_ms, thin_ms, gap_ms)
    return rows.groupBy("vehicle_id").applyInPandasWithState(processor, f"vehicle_id {kind}, {DRIVE}", f"{VEHICLE}, {CLIPS}", "append", GroupStateTimeout.EventTimeTimeout)

