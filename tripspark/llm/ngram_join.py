"""Jaccard join on word n-grams: MinHash banding finds candidates, full n-gram sets verify them.

Rows with the same n-gram set are one class of copies; one representative each
goes on. Bands of MinHashes are shuffled on their hashes; a bucket links its
members to its smallest one, never to each other. Candidates that are linked over
such links travel together: a component of up to ``TILE`` representatives is
verified in one task from its full sets, a larger one in tiles of two parts each,
parts being of one size class of sets or of two neighbouring ones (sets whose
sizes differ by more cannot reach the similarity). Pairs are counted where they
are verified and never written out; what leaves a tile is one row per
representative: its number of links and the smallest member it is linked to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.arrays import Rolling, joined, mix, pieces, powers, word_spans
from tripspark.llm.common import cut, documents, free_memory, free_name, hold, small_batches
from tripspark.llm.components import connected_components

#: Representatives of a tile's side, and n-grams of all of them together (8 bytes each).
TILE, TILE_GRAMS = 512, 1 << 20
#: Side of the members of a tile in which all pairs count; a tile of two parts has sides 0 and 1, one of which may be empty.
WITHIN = 2
NO_ID = -(1 << 63)


def banding(threshold: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): pairs at the threshold share a band with this probability, more similar ones with a higher."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def ngram_sets(texts: list[bytes], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, hashes, sizes): the sorted distinct n-gram hashes of each text, one text after the other.

    Words are runs of non-blank bytes with A-Z lower-cased. A text with fewer
    than n words has one n-gram of all its words, one without words has none.
    """
    weight = powers(0xD6E8FEB86659FD93, n + 1)
    for lo, hi in pieces(texts):
        data, at = joined(texts[lo:hi])
        starts, ends = word_spans(data)
        word = mix(Rolling(data, fold=True).spans(starts, ends))
        doc = np.searchsorted(at, starts, "right") - 1
        count = np.bincount(doc, minlength=hi - lo)
        first = np.cumsum(count) - count
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(word) >= n:
            size = len(word) - n + 1
            grams = np.zeros(size, np.uint64)
            for k in range(n):
                grams += word[k : k + size] * weight[k]
            inside = doc[:size] == doc[n - 1 :]
            grams, owner = mix(grams[inside]), doc[:size][inside]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            own = np.array([int(np.sum(word[first[d] : first[d] + count[d]] * weight[: count[d]])) & ((1 << 64) - 1) for d in short], np.uint64)
            grams, owner = np.append(grams, mix(own + count[short].astype(np.uint64))), np.append(owner, short)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        once = np.ones(len(grams), bool)
        once[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield lo, hi - lo, grams[once], np.bincount(owner[once], minlength=hi - lo)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """docs (id, text) -> id, grams, fp1, fp2 (a 128-bit fingerprint of the set), bands (null without n-grams)."""
    rng = np.random.default_rng(7)
    flips, factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64), rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("n-grams",))
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, many, grams, sizes in ngram_sets(texts, n):
                full = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[full]
                fp1, fp2 = np.zeros(many, np.uint64), np.zeros(many, np.uint64)
                out = np.zeros((many, bands), np.uint64)
                if len(full):
                    fp1[full] = np.add.reduceat(mix(grams ^ np.uint64(0x1234567)), begin)
                    fp2[full] = np.add.reduceat(mix(grams + np.uint64(0x89ABCDE)), begin)
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for k in range(b * rows, (b + 1) * rows):
                            key = mix(key + np.minimum.reduceat((grams ^ flips[k]) * factors[k], begin))
                        out[full, b] = key
                offsets = np.zeros(many + 1, np.int32)
                np.cumsum(np.where(sizes > 0, bands, 0), out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(out[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, many), pa.array(sizes.astype(np.int64)), _signed(fp1), _signed(fp2), lists], names=["id", "grams", "fp1", "fp2", "bands"])
        free_memory()

    return docs.mapInArrow(run, "id bigint, grams bigint, fp1 bigint, fp2 bigint, bands array<bigint>")


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """rows (rep, fp1, text, copies, group, tiles) -> rep, copies, group, tiles, grams (sorted hashes); a row whose text has another set than fp1 says goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("n-grams",))
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            wanted = batch.column(1).to_pylist()
            for lo, many, grams, sizes in ngram_sets(texts, n):
                part = batch.slice(lo, many)
                begin = np.cumsum(sizes) - sizes
                keep, blobs = [], []
                for d in range(many):
                    own = grams[begin[d] : begin[d] + sizes[d]]
                    if len(own) and int(np.add.reduce(mix(own ^ np.uint64(0x1234567))).astype(np.int64)) == wanted[lo + d]:
                        keep.append(d)
                        blobs.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(keep, pa.int64())) for k in (0, 3, 4)), pa.array(blobs, pa.binary())], names=["rep", "copies", "tiles", "grams"])
        free_memory()

    return rows.select("rep", "fp1", "text", "copies", "tiles").mapInArrow(run, "rep bigint, copies bigint, tiles array<struct<group:bigint,tile:bigint,side:int>>, grams binary")


def verify_tile(rep: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, smallest linked member) of each representative: all pairs of a tile of side WITHIN, else those of side 0 with side 1.

    In order of size, a set is compared only with those up to 1 / threshold times as large.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    back = np.argsort(order)
    links, least = _by_size(rep[order], copies[order], side[order], [sets[k] for k in order], threshold)
    return links[back], least[back]


def _by_size(rep: np.ndarray, copies: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets])
    begin = np.append(0, np.cumsum(sizes))
    last = np.searchsorted(sizes, sizes / threshold + 1e-9, "right")
    universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.zeros(len(universe), np.int32)
    links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
    cross = not (side == WITHIN).any()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rep) - 1):
        lo, hi = i + 1, int(last[i])
        if hi <= lo:
            continue
        own = ids[begin[i] : begin[i + 1]]
        seen[own] = 1
        shared = np.add.reduceat(seen[ids[begin[lo] : begin[hi]]], begin[lo:hi] - begin[lo])
        seen[own] = 0
        near = shared * (1 + threshold) >= threshold * (sizes[i] + sizes[lo:hi]) - 1e-9
        if cross:
            near &= side[lo:hi] != side[i]
        partners = lo + np.flatnonzero(near & (rep[lo:hi] != rep[i]))
        links[i] += copies[partners].sum()
        links[partners] += copies[i]
        for p in partners.tolist():
            a, b = find(int(i)), find(p)
            if a != b:
                root[max(a, b, key=lambda x: rep[x])] = min(a, b, key=lambda x: rep[x])
    return links, rep[[find(i) for i in range(len(rep))]]


def _verify(threshold: float):
    def of(table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        order = np.argsort(tile, kind="stable")
        rep, copies, side = (table[k].to_numpy()[order] for k in ("rep", "copies", "side"))
        blobs = table["grams"].take(pa.array(order)).to_pylist()
        out_rep, out_links, out_root = [], [], []
        cuts = np.flatnonzero(np.diff(tile[order])) + 1
        for part in np.split(np.arange(len(order)), cuts):
            _, once = np.unique(np.stack([rep[part], side[part]], axis=1), axis=0, return_index=True)
            part = part[once]
            if len(part) > 1:
                links, root = verify_tile(rep[part], copies[part], side[part], [np.frombuffer(blobs[k], np.uint64) for k in part], threshold)
                some = links > 0
                out_rep.append(rep[part][some])
                out_links.append(links[some])
                out_root.append(root[some])
        empty = np.zeros(0, np.int64)
        return pa.table({"rep": np.concatenate([empty, *out_rep]), "links": np.concatenate([empty, *out_links]), "root": np.concatenate([empty, *out_root])})

    return of


def _tiles(members: DataFrame, threshold: float) -> DataFrame:
    """members (rep, component, grams) with tiles: array of (group, tile, side)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("grams").alias("all_grams"))
    sized = members.join(sizes, "component")
    total = members.agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("grams"), F.lit(0)).alias("grams")).first()
    groups = max(1, math.ceil(total.members / TILE), math.ceil(total.grams / TILE_GRAMS))
    fits = (F.col("members") <= TILE) & (F.col("all_grams") <= TILE_GRAMS)
    small = sized.where(fits).withColumn(
        "tiles", F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("group"), F.col("component").alias("tile"), F.lit(WITHIN).alias("side")))
    )
    # set sizes of a pair at the threshold lie in the same or neighbouring classes
    sized = sized.where(~fits).withColumn("cls", F.floor(F.log(F.col("grams").cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)))
    parts = sized.groupBy("component", "cls").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TILE), F.sum("grams") / F.lit(TILE_GRAMS))).alias("parts"))
    near = lambda step, name: parts.select("component", (F.col("cls") + step).alias("cls"), F.col("parts").alias(name))
    large = sized.join(parts, ["component", "cls"]).join(near(-1, "above"), ["component", "cls"], "left").join(near(1, "below"), ["component", "cls"], "left")
    large = large.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    def tile(kind: int, cls: Column, i: Column, j: Column, side: Column) -> Column:
        key = F.xxhash64("component", F.lit(kind), cls, i, j)
        return F.struct(key.alias("group"), key.alias("tile"), side.cast("int").alias("side"))

    me = F.col("part")

    def upto(n: Column) -> Column:
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    within = F.transform(upto(F.col("parts")), lambda j: tile(0, F.col("cls"), F.least(me, j), F.greatest(me, j), F.when(me == j, WITHIN).when(me < j, 0).otherwise(1)))
    up = F.transform(upto(F.col("above")), lambda j: tile(1, F.col("cls"), me, j, F.lit(0)))
    down = F.transform(upto(F.col("below")), lambda j: tile(1, F.col("cls") - 1, j, me, F.lit(1)))
    large = large.withColumn("tiles", F.concat(within, up, down))
    return small.select("rep", "tiles").unionByName(large.select("rep", "tiles"))


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, copy_id, n_links, kept.

    Two documents are linked if the Jaccard similarity of their sets of ``n`` words
    in a row is at least ``threshold`` (words: runs of non-blank characters, A-Z
    lower-cased; a document with fewer than n words has one n-gram of all of them).
    class_id: the smallest doc_id linked over any number of links; copy_id: the
    smallest doc_id with the same set; n_links: the number of other rows linked
    directly; kept: the row is its class's smallest (of rows that repeat an id in a
    class, all). ``recall`` is the probability that banding finds a pair exactly at
    the threshold; links within found components are exact. Documents without words (null
    texts, too) are linked to nothing. A null id counts as the smallest and comes
    out as null. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs)
    bands, per_band = banding(threshold, recall)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    sig = cut(signatures(rows, n, bands, per_band))
    worded = sig.where("grams > 0")
    reps = worded.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # of rows that repeat an id the fingerprint says which is meant
    of_rep = worded.withColumnRenamed("id", "rep").join(reps, ["rep", "fp1", "fp2"]).select("rep", "fp1", "copies", "grams", "bands")
    of_rep = cut(of_rep)  # read for the buckets, the links and the members
    banded = of_rep.select("rep", F.explode("bands").alias("key"))
    bucket = banded.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least")
    stars = banded.join(bucket, "key").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    candidates = connected_components(stars)
    members = cut(of_rep.select("rep", "fp1", "copies", "grams").distinct().join(candidates, F.col("rep") == F.col("node")).drop("node"))
    tiled = members.select("rep", "fp1", "copies").join(_tiles(members, threshold), "rep")
    sets = _with_sets(rows.join(tiled, rows["id"] == tiled["rep"]), n)
    tiles = sets.select("rep", "copies", "grams", F.explode("tiles").alias("t")).select("rep", "copies", "grams", "t.group", "t.tile", "t.side")
    verified = cut(tiles.groupBy("group").applyInArrow(_verify(threshold), "rep bigint, links bigint, root bigint"))
    links = verified.groupBy(F.col("rep").alias("linked")).agg(F.sum("links").alias("links"))
    classes = connected_components(verified, "rep", "root")
    known = reps.join(links, F.col("rep") == F.col("linked"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    known = known.select("fp1", "fp2", "rep", "copies", "links", "component")
    found = worded.select("id", "fp1", "fp2").join(known, ["fp1", "fp2"])
    linked = found.select("id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = sig.where("grams = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"))
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias("doc_id" if c == "id" else c)
    return linked.unionByName(alone).select(plain("id"), plain("class_id"), plain("copy_id"), "n_links", (F.col("id") == F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class of ngram_join; all columns stay as they are, whatever their names.

    Of rows that repeat an id, all stay if any does; rows with a null id stay, and so
    do documents without words. An empty table gives no rows.
    """
    found = ngram_join(docs, id_col=id_col, text_col=text_col)
    gone_id = free_name(docs, "gone_id")
    gone = found.groupBy(F.col("doc_id").alias(gone_id)).agg(F.bool_or("kept").alias("any_kept")).where("NOT any_kept").select(gone_id)
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


#: All pairs that share an n-gram, without hashing.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y, k = nx.n AND k = ny.n AS equal FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE k >= 0.8 * (nx.n + ny.n - k) - 1e-9),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT w.doc_id, r.class_id, coalesce(l.copy_id, w.doc_id) AS copy_id, coalesce(l.n, 0) AS n_links, w.doc_id = r.class_id AS kept
FROM w JOIN (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x) r USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n, least(x, min(y) FILTER (WHERE equal)) AS copy_id FROM e GROUP BY x) l USING (doc_id)
"""
