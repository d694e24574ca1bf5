import re
from collections import Counter

import corpus_pipeline
import pytest
from helpers import SF
from pyspark.sql import functions as F

from tripspark.llm import exact_dedup, mixing, ngram_join
from tripspark.llm.components import connected_components

NULL = -(1 << 63)


def grams(text, n=5):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_join(rows, threshold=0.8):
    """(class, links) of each row, by all pairs."""
    sets = [grams(t) for _, t in rows]
    ids = [NULL if i is None else i for i, _ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return Counter((ids[k], least[find(k)] if sets[k] else ids[k], links[k]) for k in range(len(rows)))


def found(df):
    plain = lambda x: NULL if x is None else x
    return Counter((plain(r.doc_id), plain(r.class_id), r.n_links) for r in df.collect())


@pytest.mark.parametrize("tile, grams", [(512, 1 << 20), (2, 1 << 20), (512, 150)])
def test_ngram_join(odd, odd_rows, none, monkeypatch, tile, grams):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", grams)
    assert found(ngram_join.ngram_join(odd)) == brute_join([r[:2] for r in odd_rows])
    assert ngram_join.ngram_join(none).count() == 0


def test_ngram_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(ngram_join.op6_ngram_join(spark, SF)) == brute_join(rows)


def test_drop_near_copies(odd):
    left = ngram_join.drop_near_copies(odd)
    assert left.columns == odd.columns and left.where("doc_id BETWEEN 100 AND 130").count() == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (7, 3), (11, 12), (30, 29)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, 12: 10, 29: 29, 30: 29} | {100 + i: 100 for i in range(41)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shares_add_up():
    for weights in ([1.0], [0.5, 0.25, 0.25], [1e9, 1, 1, 1], [3.3, 2.2, 1.1] * 20):
        shares = mixing.shares_of(weights, 512)
        assert sum(shares) == 512 and min(shares) >= 1


def test_frame_keeps_every_deadline():
    for shares in ([512], [256, 128, 128], [509, 1, 1, 1], [100, 99, 98, 97, 118]):
        slots, run = sum(shares), Counter()
        for k, j, slot in mixing.frame(shares):
            assert j * slots // shares[k] <= slot < -(-(j + 1) * slots // shares[k])
            run[k] += 1
            assert all(abs(run[s] - shares[s] * (slot + 1) / slots) < 1 for s in range(len(shares)))


def test_mix_sources(odd, odd_rows, none):
    weights = {"s0": 0.5, "s1": 0.25, "s2": 0.125, None: 0.125}
    out = mixing.mix_sources(odd, weights, block_docs=2).collect()
    rows = Counter((r.doc_id, r.source, hash(r.text)) for r in out)
    assert set(rows) == {(i, s, hash(t)) for i, t, _, s in odd_rows}  # none is lost
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.source_block, r.epoch)) == (r.source, r.source_block, r.epoch) and r.release <= r.slot < r.deadline and 0 <= r.place < 2
    assert sorted(slots) == list(range(len(slots)))
    run = Counter()
    for s in sorted(slots):
        run[slots[s][0]] += 1
        assert all(abs(run[k] - w * (s + 1)) < 1 + (s + 1) / 1024 for k, w in weights.items())
    last = max(slots)
    assert slots[last][2] == 0  # the stream ends with the last block that was not yet read
    assert mixing.mix_sources(none).count() == 0
    stream = mixing.mixed_stream(odd, weights=weights, block_docs=2)
    assert stream.columns == odd.columns and stream.count() == len(out)


def brute_schedule(blocks, shares, slots):
    """{(source, run): slot} by trying all sources in every slot, until each source has been read whole once."""
    done, out, slot = [0] * len(shares), {}, 0
    while any(d < b for d, b in zip(done, blocks)):
        ready = [k for k in range(len(shares)) if done[k] * slots // shares[k] <= slot]
        k = min(ready, key=lambda k: (-(-(done[k] + 1) * slots // shares[k]), k))
        out[k, done[k]] = slot
        done[k] += 1
        slot += 1
    return out


def test_mix_rows_by_brute_force(odd, odd_rows):
    for weights, block in (({"s0": 0.5, "s1": 0.25, "s2": 0.125, None: 0.125}, 2), ({"s0": 1.0}, 3), ({}, 1), (None, 4)):
        out = mixing.mix_sources(odd, weights, block_docs=block).collect()
        count = Counter(s for *_, s in odd_rows)
        names = sorted(count, key=lambda s: (s is not None, s))
        wanted = [count[s] ** 0.8 if weights is None else weights.get(s, min(weights.values(), default=1.0)) for s in names]
        shares, blocks = mixing.shares_of(wanted, 1024), [-(-count[s] // block) for s in names]
        schedule = brute_schedule(blocks, shares, 1024)
        want = Counter()
        for (k, run), slot in schedule.items():
            epoch, at = divmod(run, blocks[k])
            for place in range(min(block, count[names[k]] - at * block)):
                want[names[k], at, epoch, slot, run * 1024 // shares[k], -(-(run + 1) * 1024 // shares[k]), place] += 1
        assert Counter((r.source, r.source_block, r.epoch, r.slot, r.release, r.deadline, r.place) for r in out) == want
        # in each epoch every row has one place, the same in all
        rows = {}
        for r in out:
            rows.setdefault((r.source, r.source_block, r.place), set()).add((r.doc_id, hash(r.text)))
        assert all(len(x) == 1 for x in rows.values()) and Counter((s, *next(iter(x))) for (s, _, _), x in rows.items()) == Counter((s, i, hash(t)) for i, t, _, s in odd_rows)


def test_columns_of_any_name_keep_their_values(spark):
    names = "slot place epoch release deadline source_block _k _j _rank _part _source row gone_id gone_digest doc_id id fp1".split()
    rows = [tuple(100 * k + i for k in range(len(names))) + (f"some words of text number {i // 2} and no more", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names) + ", text string, source string")
    stream = mixing.mixed_stream(docs, {"s0": 1.0, "s1": 1.0}, block_docs=1)
    assert stream.columns == docs.columns and {tuple(r) for r in stream.collect()} == set(rows)
    for left in (exact_dedup.drop_exact_copies(docs), ngram_join.drop_near_copies(docs)):
        assert left.columns == docs.columns and left.count() == 6 and {tuple(r) for r in left.collect()} <= set(rows)
    assert set(mixing.mix_sources(docs, {"s0": 1.0}).columns) == {*docs.columns}
    for bad in ({"s0": 0.0}, {"s0": -1.0}, {"s0": float("inf")}):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, bad)


def test_a_written_stream_keeps_its_order(spark, odd, tmp_path):
    weights = {"s0": 0.5, "s1": 0.25, "s2": 0.125, None: 0.125}
    mixing.mixed_stream(odd, weights, block_docs=2).write.parquet(f"{tmp_path}/stream")
    read = mixing.stream_position(spark.read.parquet(f"{tmp_path}/stream"))
    got = [r.source for r in read.orderBy("stream_part", "stream_row").collect()]
    want = [r.source for r in mixing.mix_sources(odd, weights, block_docs=2).orderBy("slot", "place").collect()]
    assert got == want and mixing.stream_position(odd).where("stream_part IS NULL").count() == odd.count()


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.op4_mix_sources(spark, SF)
    assert out.select("doc_id").distinct().count() == docs.count()
    again = mixing.op4_mix_sources(spark, SF)
    assert out.exceptAll(again).count() == 0


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mix_sources", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    got = {r.doc_id for r in out.select("doc_id").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {low(t): i for i, t in sorted(rows.items())}
    unique = [(i, rows[i]) for i in last.values() if re.search(r"[^\W\d_]", rows[i] or "")]
    want = {c for _, c, _ in brute_join(unique)}
    assert got == want


def test_pipeline_stages_keep_columns(spark, odd, tmp_path):
    docs = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where(F.col("n_tokens") > 0).count() > 0
