"""Suffix dedup: remove bytes of long strings that start in an earlier document too.

A global suffix array would be one huge sort of overlapping suffixes. Here the
50-byte windows are first dealt into groups by content: the smallest hash of the
20-byte strings in a window is the same wherever the window occurs, and neighbours
mostly share it, so a text falls into runs of about 16 windows per group. Steps,
each a grouped map over chunks of documents or buckets of groups:

1. a chunk sends the 32-bit keys of its groups, each once;
2. a bucket answers which keys lie in at least two documents;
3. a chunk sends the runs of those keys, equal ones once with the smallest document;
4. a bucket puts the windows of its runs in suffix order, with the common prefixes of
   neighbours. A window's longest previous factor is the larger of its common
   prefixes with the previous and with the next smaller document in that order; of
   50 bytes and more, the window starts in an earlier document too. The bucket
   answers each run with its smallest document and a bit for each window;
5. a chunk marks the bytes and writes its documents.

The documents are shuffled once, by chunk, and that exchange is used three
times. A passage or copy that a third of all documents hold is sent once a chunk,
not once a document. Runs that reach beyond a common string into text of their
own differ, and all lie in its group: of a group with more than ``hot_runs`` runs
(counted in step 2) each window is sent alone, as its hash, and dealt by that hash,
so that equal windows still meet and the group is spread over all buckets.
Chunks and buckets grow in number with the input.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.arrays import Rolling, joined, mix, pieces, ragged
from tripspark.llm.common import documents

#: Bytes of the strings whose smallest hash names a window's group; below the least window length.
SEED = 20
#: Windows of a run; longer ones are cut, so that a bit mask of a run is one 64-bit number.
RUN = 64
PIECE = 1 << 18
#: Runs of a group in a chunk from which on they are counted; a group that is never counted has fewer runs than this a chunk.
COUNTED = 8


def _minima(data: np.ndarray, rolling: Rolling, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the smallest hash of its SEED-byte strings."""
    m = len(data) - SEED + 1
    now = mix((rolling.sums[SEED:] - rolling.sums[:m]) * rolling.down[:m])
    width, span = length - SEED + 1, 1
    while span * 2 <= width:
        now = np.minimum(now[:-span], now[span:])
        span *= 2
    return np.minimum(now[: len(now) - (width - span)], now[width - span :]) if span < width else now


def _runs(texts: list[bytes], length: int):
    """(first doc, data, where docs begin, start, windows, doc, group, hash) of the runs and the rolling hashes, piece by piece."""
    for lo, hi in pieces(texts, PIECE):
        data, at = joined(texts[lo:hi])
        if len(data) <= length:
            continue
        rolling = Rolling(data)
        low = _minima(data, rolling, length)
        doc = np.repeat(np.arange(hi - lo), np.diff(at))[: len(low)]
        inside = np.arange(len(low)) + length < at[doc + 1]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(low)))
        keep = inside[start]
        start, count = start[keep], count[keep]
        if len(start) and count.max() > RUN:
            parts = -(-count // RUN)
            k = ragged(np.zeros(len(parts), np.int64), parts)
            whole = np.repeat(count, parts)
            start, count = np.repeat(start, parts) + k * RUN, np.minimum(RUN, whole - k * RUN)
        group = mix(low[start] ^ np.uint64(0x5851F42D4C957F2D))
        yield lo, data, at, start, count, doc[start], group, mix(rolling.spans(start, start + count + length - 1)), rolling


def _table(cols: dict) -> pa.Table:
    return pa.table(cols)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; a null one is smaller than all others."""
    return column.combine_chunks().fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _per_bucket(bucket: np.ndarray, order: np.ndarray):
    """(bucket, indices) for each bucket; order sorts by bucket."""
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def send_keys(buckets: int, length: int):
    def of(table: pa.Table) -> pa.Table:
        groups, ids, hashes = [], [], []
        own = _ids(table["doc_id"])
        for lo, _, _, _, _, doc, group, h, _ in _runs(_texts(table["text"]), length):
            groups.append(group)
            ids.append(own[doc + lo])
            hashes.append(h)
        out = {"bucket": [], "chunk": [], "keys": [], "shared": [], "counted": [], "counts": []}
        if groups:
            group, ids, h = np.concatenate(groups), np.concatenate(ids), np.concatenate(hashes)
            order = np.argsort(group, kind="stable")
            group, ids, h = group[order], ids[order], h[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            shared = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            size = np.diff(np.append(first, len(group)))
            # of large groups the different runs, as equal ones are sent once
            large = np.flatnonzero(size >= COUNTED)
            runs = np.zeros(len(first), np.int64)
            if len(large):
                of_group, of_run = np.repeat(large, size[large]), h[ragged(first[large], size[large])]
                by = np.lexsort((of_run, of_group))
                new = np.append(True, (of_run[by][1:] != of_run[by][:-1]) | (of_group[by][1:] != of_group[by][:-1]))
                runs = np.bincount(of_group[by][new], minlength=len(first))
            group = group[first]
            bucket, key = (group % np.uint64(buckets)).astype(np.int64), (group >> np.uint64(32)).astype(np.uint32)
            for b, part in _per_bucket(bucket, np.argsort(bucket, kind="stable")):
                out["bucket"].append(b)
                out["chunk"].append(table["chunk"][0].as_py())
                out["keys"].append(key[part].tobytes())
                out["shared"].append(key[part][shared[part]].tobytes())
                many = part[runs[part] >= COUNTED]
                out["counted"].append(key[many].tobytes() if len(many) else None)
                out["counts"].append(runs[many].tobytes() if len(many) else None)
        return _table({k: pa.array(v, pa.int64() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()})

    return of


def answer_keys(hot_runs: int):
    def of(table: pa.Table) -> pa.Table:
        keys = [np.unique(np.frombuffer(x, np.uint32)) for x in table["keys"].to_pylist()]
        shared = [np.frombuffer(x, np.uint32) for x in table["shared"].to_pylist()]
        value, count = np.unique(np.concatenate(keys), return_counts=True)
        hit = np.union1d(value[count > 1], np.concatenate(shared))
        counted, counts = (np.concatenate([np.frombuffer(x, kind) for x in table[k].to_pylist() if x] or [np.zeros(0, kind)]) for k, kind in (("counted", np.uint32), ("counts", np.int64)))
        many, at = np.unique(counted, return_inverse=True)
        hot = np.intersect1d(many[np.bincount(at, counts, len(many)) > hot_runs], hit)
        out = [np.intersect1d(k, hit, assume_unique=True) for k in keys]
        some = [i for i, k in enumerate(out) if len(k)]
        hot_of = [np.intersect1d(out[i], hot, assume_unique=True).tobytes() or None for i in some] if len(hot) else [None] * len(some)
        return _table({"chunk": table["chunk"].take(pa.array(some, pa.int64())), "bucket": table["bucket"].take(pa.array(some, pa.int64())), "keys": pa.array([out[i].tobytes() for i in some], pa.binary()), "hot": pa.array(hot_of, pa.binary())})

    return of


def _full(buckets: list[int], keys: list[bytes | None]) -> np.ndarray:
    """Sorted numbers of bucket and key."""
    parts = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, np.uint32).astype(np.uint64) for b, k in zip(buckets, keys) if k]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def send_runs(buckets: int, length: int):
    def of(docs: pa.Table, answer: pa.Table) -> pa.Table:
        out = {k: [] for k in ("bucket", "chunk", "hash", "least", "greatest", "windows", "bytes", "group")}
        if docs.num_rows and answer.num_rows:
            chunk = docs["chunk"][0].as_py()
            wanted, hot = (_full(answer["bucket"].to_pylist(), answer[k].to_pylist()) for k in ("keys", "hot"))
            own = _ids(docs["doc_id"])
            found, single = [], []
            for lo, data, _, start, count, doc, group, h, rolling in _runs(_texts(docs["text"]), length):
                bucket = group % np.uint64(buckets)
                full = (bucket << np.uint64(32)) | (group >> np.uint64(32))
                is_hot = _among(full, hot)
                # the windows of hot groups, each alone and dealt by its own hash
                one = np.flatnonzero(is_hot)
                if len(one):
                    p, run = ragged(start[one], count[one]), np.repeat(one, count[one])
                    h_of, ids = mix(rolling.spans(p, p + length)), own[doc[run] + lo]
                    order = np.argsort(h_of, kind="stable")
                    first = np.flatnonzero(np.append(True, h_of[order][1:] != h_of[order][:-1]))
                    single.append((h_of[order][first], np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first), group[run[order[first]]]))
                hit = np.flatnonzero(_among(full, wanted) & ~is_hot)
                if not len(hit):
                    continue
                ids = own[doc[hit] + lo]
                # equal runs of the piece once
                order = np.argsort(h[hit], kind="stable")
                hit, ids = hit[order], ids[order]
                first = np.flatnonzero(np.append(True, h[hit][1:] != h[hit][:-1]))
                one = hit[first]
                text = data[ragged(start[one], count[one] + length - 1)]
                found.append((bucket[one].astype(np.int64), h[one], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first), count[one].astype(np.uint8), text))
            if found:
                bucket, h, least, greatest, count, text = (np.concatenate(x) for x in zip(*found))
                size = count.astype(np.int64) + length - 1
                begin = np.cumsum(size) - size
                # and once in the chunk
                order = np.lexsort((h, bucket))
                first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                least, greatest = np.minimum.reduceat(least[order], first), np.maximum.reduceat(greatest[order], first)
                one = order[first]
                bucket, h, count, size, begin = bucket[one], h[one], count[one], size[one], begin[one]
                for b, part in _per_bucket(bucket, np.arange(len(bucket))):
                    for k, v in (("bucket", b), ("chunk", chunk), ("hash", h[part].tobytes()), ("least", least[part].tobytes()), ("greatest", greatest[part].tobytes()), ("windows", count[part].tobytes()), ("bytes", text[ragged(begin[part], size[part])].tobytes()), ("group", None)):
                        out[k].append(v)
            if single:
                h, least, greatest, group = (np.concatenate(x) for x in zip(*single))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((h, bucket))
                first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                least, greatest = np.minimum.reduceat(least[order], first), np.maximum.reduceat(greatest[order], first)
                one = order[first]
                bucket, h, group = bucket[one], h[one], group[one]
                for b, part in _per_bucket(bucket, np.arange(len(bucket))):
                    for k, v in (("bucket", b), ("chunk", chunk), ("hash", h[part].tobytes()), ("least", least[part].tobytes()), ("greatest", greatest[part].tobytes()), ("windows", None), ("bytes", None), ("group", group[part].tobytes())):
                        out[k].append(v)
        return _table({k: pa.array(v, pa.int64() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()})

    return of


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


class SuffixOrder:
    """The suffixes of a text by their first ``length`` bytes (prefix doubling), and how far any two agree."""

    def __init__(self, text: np.ndarray, length: int):
        n, self.length = len(text), length
        self.wide = np.zeros(n + 2 * length, np.uint8)
        self.wide[:n] = text
        size = 1
        while size * 2 <= min(8, length):
            size *= 2
        packed = np.zeros(n + length, np.uint64)
        for k in range(size):
            packed = (packed << np.uint64(8)) | self.wide[k : k + n + length].astype(np.uint64)
        #: (size, rank of the ``size`` bytes at every place), in the order of the bytes.
        self.levels = [(size, _dense(packed))]
        while size * 2 <= length:
            rank = self.levels[-1][1]
            self.levels.append((size * 2, np.append(_dense((rank[:-size] << np.uint64(32)) | rank[size:]), np.zeros(size, np.uint64))))
            size *= 2

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """The order of the windows at ``starts``; all must have ``length`` bytes left."""
        size, rank = self.levels[-1]
        return np.argsort((rank[starts] << np.uint64(32)) | rank[starts + self.length - size], kind="stable")

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, at most ``length``."""
        out = np.zeros(len(a), np.int64)
        for size, rank in [*self.levels[:0:-1], self.levels[0], self.levels[0]]:
            same = np.flatnonzero((out + size <= self.length) & (rank[np.minimum(a + out, len(rank) - 1)] == rank[np.minimum(b + out, len(rank) - 1)]))
            out[same] += size
        for _ in range(self.levels[0][0]):
            same = np.flatnonzero((out < self.length) & (self.wide[a + out] == self.wide[b + out]))
            out[same] += 1
            if not len(same):
                break
        return out


def _previous_smaller(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with the nearest place before it of a smaller document; 0 if there is none, or if it falls below ``least``.

    ``lcp``: the common prefix with the place before. All places between a place and
    where it has got to so far are of documents no smaller, so it may go on from there as
    far as that place has got: pointers double their reach in each round.
    """
    reach, common = np.arange(-1, len(doc) - 1), lcp.copy()
    live = np.flatnonzero(common >= least)
    common[common < least] = 0
    while len(live):
        live = live[doc[reach[live]] >= doc[live]]
        at = reach[live]
        common[live] = np.minimum(common[live], common[at])
        reach[live] = reach[at]
        live = live[common[live] >= least]
    return common


def longest_previous_factor(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor of each place in suffix order: how much of it also starts in a smaller document; 0 stands for less than ``least``.

    doc: the document of each place; lcp: its common prefix with the place before, 0
    for the first. It is the larger of the common prefixes with the previous and with
    the next place of a smaller document.
    """
    before = _previous_smaller(doc, lcp, least)
    after = _previous_smaller(doc[::-1], np.append(lcp[1:], 0)[::-1], least)[::-1]
    return np.maximum(before, after)


def answer_runs(length: int):
    def alone(table: pa.Table, out: dict[str, list]) -> None:
        """Windows sent alone: equal ones have equal hashes."""
        h, least, greatest, group = ([np.frombuffer(x, kind) for x in table[k].to_pylist()] for k, kind in (("hash", np.uint64), ("least", np.int64), ("greatest", np.int64), ("group", np.uint64)))
        source = np.repeat(np.arange(len(h)), [len(x) for x in h])
        h, least, greatest, group = (np.concatenate(x) for x in (h, least, greatest, group))
        value, back = np.unique(h, return_inverse=True)
        smallest = np.full(len(value), np.iinfo(np.int64).max)
        np.minimum.at(smallest, back, least)
        tell = np.flatnonzero(greatest > smallest[back])
        chunks = table["chunk"].to_pylist()
        for s, part in _per_bucket(source[tell], np.arange(len(tell))):
            rows = tell[part]
            for k, v in (("chunk", chunks[s]), ("hash", h[rows].tobytes()), ("least", smallest[back[rows]].tobytes()), ("mask", None), ("group", group[rows].tobytes())):
                out[k].append(v)

    def of(table: pa.Table) -> pa.Table:
        out = {"chunk": [], "hash": [], "least": [], "mask": [], "group": []}
        whole = table["group"].is_null()
        if (windows := table.filter(pc.invert(whole))).num_rows:
            alone(windows, out)
        if (runs := table.filter(whole)).num_rows:
            together(runs, out)
        return _table({k: pa.array(v, pa.int64() if k == "chunk" else pa.binary()) for k, v in out.items()})

    def together(table: pa.Table, out: dict[str, list]) -> None:
        def column(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in table[name].to_pylist()]

        h, least, greatest, windows, text = column("hash", np.uint64), column("least", np.int64), column("greatest", np.int64), column("windows", np.uint8), column("bytes", np.uint8)
        source = np.repeat(np.arange(len(h)), [len(x) for x in h])
        h, least, greatest, windows, text = (np.concatenate(x) for x in (h, least, greatest, windows, text))
        windows = windows.astype(np.int64)
        size = windows + length - 1
        begin = np.cumsum(size) - size
        value, one, back = np.unique(h, return_index=True, return_inverse=True)
        smallest = np.full(len(value), np.iinfo(np.int64).max)
        np.minimum.at(smallest, back, least)
        # the distinct runs: which of their windows start in a document before the run's first one?
        starts_of = windows[one]
        picked = text[ragged(begin[one], size[one])]
        at = np.cumsum(size[one]) - size[one]
        starts = ragged(at, starts_of)
        run = np.repeat(np.arange(len(value)), starts_of)
        suffixes = SuffixOrder(picked, length)
        order = suffixes.sort(starts)
        lcp = np.append(0, suffixes.agree(starts[order[:-1]], starts[order[1:]]))
        earlier = np.zeros(len(order), bool)
        earlier[order] = longest_previous_factor(smallest[run[order]], lcp, length) >= length
        bit = (starts - at[run]).astype(np.uint64)
        mask = np.zeros(len(value), np.uint64)
        np.bitwise_or.at(mask, run[earlier], np.uint64(1) << bit[earlier])
        # to a chunk go the runs in which something is to be removed there
        tell = np.flatnonzero((greatest > smallest[back]) | (mask[back] != 0))
        chunks = table["chunk"].to_pylist()
        for s, part in _per_bucket(source[tell], np.arange(len(tell))):
            rows = tell[part]
            for k, v in (("chunk", chunks[s]), ("hash", h[rows].tobytes()), ("least", smallest[back[rows]].tobytes()), ("mask", mask[back[rows]].tobytes()), ("group", None)):
                out[k].append(v)

    return of


def mark(length: int, keep_text: bool):
    def of(docs: pa.Table, answer: pa.Table) -> pa.Table:
        texts, own = _texts(docs["text"]), _ids(docs["doc_id"])
        spans: dict[int, list[tuple[int, int]]] = {}
        if answer.num_rows:
            alone = pc.invert(answer["group"].is_null())
            runs, windows = answer.filter(pc.invert(alone)), answer.filter(alone)

            def column(table: pa.Table, name: str, kind) -> np.ndarray:
                return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)])

            h, least, mask = column(runs, "hash", np.uint64), column(runs, "least", np.int64), column(runs, "mask", np.uint64)
            order = np.argsort(h)
            h, least, mask = h[order], least[order], mask[order]
            w, w_least, groups = column(windows, "hash", np.uint64), column(windows, "least", np.int64), np.unique(column(windows, "group", np.uint64))
            order = np.argsort(w)
            w, w_least = w[order], w_least[order]
            for lo, data, begins, start, count, doc, group, own_hash, rolling in _runs(texts, length):
                parts = []
                hit = np.flatnonzero(_among(own_hash, h))
                if len(hit):
                    at, n, of_doc = np.searchsorted(h, own_hash[hit]), count[hit], doc[hit]
                    later = own[of_doc + lo] > least[at]
                    p, run = ragged(start[hit], n), np.repeat(np.arange(len(hit)), n)
                    bit = (p - start[hit][run]).astype(np.uint64)
                    parts.append(p[later[run] | (((mask[at][run] >> bit) & np.uint64(1)) == 1)])
                hit = np.flatnonzero(_among(group, groups))
                if len(hit):
                    p, run = ragged(start[hit], count[hit]), np.repeat(hit, count[hit])
                    own_window = mix(rolling.spans(p, p + length))
                    some = np.flatnonzero(_among(own_window, w))
                    parts.append(p[some][own[doc[run[some]] + lo] > w_least[np.searchsorted(w, own_window[some])]])
                gone = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                if not len(gone):
                    continue
                gone = np.sort(gone)
                # windows of one document that touch are one span
                where = np.searchsorted(begins, gone, "right") - 1
                new = np.append(True, (gone[1:] > gone[:-1] + length) | (where[1:] != where[:-1]))
                ends = np.append(gone[np.flatnonzero(new)[1:] - 1], gone[-1]) + length
                for d, a, b in zip(where[new].tolist(), gone[new].tolist(), ends.tolist()):
                    spans.setdefault(d + lo, []).append((a - int(begins[d]), b - int(begins[d])))
        n_removed, n_spans, sha, kept = [], [], [], []
        for i, t in enumerate(texts):
            cut = spans.get(i, [])
            at, parts = 0, []
            for a, b in cut:
                parts.append(t[at:a])
                at = b
            rest = b"".join([*parts, t[at:]])
            n_removed.append(len(t) - len(rest))
            n_spans.append(len(cut))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        out = {"doc_id": docs["doc_id"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary())
            out["spans"] = pa.array([[{"start": a, "end": b} for a, b in spans.get(i, [])] for i in range(len(texts))], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return _table(out)

    return of


def parts_for(n_bytes: int) -> int:
    """Chunks (or buckets): of about 128 KB up to 1024 of them, then 1024 until they hold 16 MB, then of 16 MB."""
    return max(1, min(1024, math.ceil(n_bytes / (128 << 10))), math.ceil(n_bytes / (16 << 20)))


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, hot_runs: int = 10_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if keep_text) kept (bytes) and spans (start, end in bytes).

    Texts are UTF-8 bytes (a null text has none). Every byte within a ``length``-byte
    string that also starts in a document of smaller id is removed, judged on the
    input; matches never cross documents. n_spans counts the maximal removed runs.
    What is kept may begin or end inside a character. A null id is smaller than all
    others; rows with equal ids are no earlier documents of each other. An empty
    table gives no rows. Other columns are not read. ``length`` is at least 21.
    Groups of more than ``hot_runs`` runs are spread window by window, with the same result.
    """
    if length <= SEED:
        raise ValueError(f"length must be above {SEED}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts_for(total)
    chunked = rows.select(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(n)).alias("chunk"), "doc_id", "text")
    by_chunk = chunked.groupBy("chunk")
    keys = by_chunk.applyInArrow(send_keys(n, length), "bucket bigint, chunk bigint, keys binary, shared binary, counted binary, counts binary")
    shared = keys.groupBy("bucket").applyInArrow(answer_keys(hot_runs), "chunk bigint, bucket bigint, keys binary, hot binary")
    runs = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_runs(n, length), "bucket bigint, chunk bigint, hash binary, least binary, greatest binary, windows binary, bytes binary, group binary")
    answers = runs.groupBy("bucket").applyInArrow(answer_runs(length), "chunk bigint, hash binary, least binary, mask binary, group binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary, spans array<struct<start: bigint, end: bigint>>" if keep_text else "")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(mark(length, keep_text), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), keep_text=False)


#: Every 50-byte string by itself, in hexadecimal digits and by its 64-bit hash.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, range(greatest(length(h) // 2 - 49, 0)) AS ps, list_transform(range(length(h) // 1000 + 1), lambda j: substr(h, 1000 * j + 1, 1100)) AS cs FROM d),
w AS (SELECT doc_id, unnest(ps) AS p, unnest(list_transform(ps, lambda p: hash(substr(cs[p // 500 + 1], 2 * (p % 500) + 1, 100)))) AS s FROM n),
f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first_doc < doc_id),
i AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS n FROM g)),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, k),
pc AS (SELECT sp.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY sp.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY sp.doc_id ORDER BY a), 0))) AS piece FROM sp JOIN d USING (doc_id)),
r AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last_b, string_agg(piece, '' ORDER BY a) AS head FROM pc GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last_b, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
