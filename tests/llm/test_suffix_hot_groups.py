import random

import numpy as np
import pyarrow as pa
from test_dedup import brute_suffix, low

from tripspark.llm import suffix_dedup

LINE = "Licensed to all who read this line"


def some_texts(n):
    rnd = random.Random(5)
    own = lambda k: "".join(rnd.choice("abcdefghijklmnop") for _ in range(k))
    shared = own(120)
    return [own(rnd.randint(60, 90)) + (LINE if i % 3 else shared + LINE) + own(rnd.randint(60, 90)) for i in range(n)]


def test_hot_groups_give_the_same_result(spark, odd, odd_rows):
    rows = [(i, t) for i, t in enumerate(some_texts(150))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for hot in (0, 20, 10_000):
        got = suffix_dedup.suffix_dedup(docs, hot_runs=hot).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_suffix(rows, 50))
    got = suffix_dedup.suffix_dedup(odd, hot_runs=0).collect()
    assert sorted((low(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_suffix(odd_rows, 50))


def test_a_common_line_is_spread_over_the_buckets():
    texts, buckets = some_texts(600), 16
    chunks = [pa.table({"chunk": [c] * 100, "doc_id": list(range(100 * c, 100 * c + 100)), "text": texts[100 * c : 100 * c + 100]}) for c in range(6)]
    keys = pa.concat_tables([suffix_dedup.send_keys(buckets, 50)(c) for c in chunks])
    hot = suffix_dedup.answer_keys(200)
    answers = pa.concat_tables([hot(keys.filter(pa.compute.equal(keys["bucket"], b))) for b in range(buckets)])
    sent = [0] * buckets
    for k, c in enumerate(chunks):
        runs = suffix_dedup.send_runs(buckets, 50)(c, answers.filter(pa.compute.equal(answers["chunk"], k)))
        for b, h in zip(runs["bucket"].to_pylist(), runs["hash"].to_pylist()):
            sent[b] += len(h) // 8
    assert sum(sent) > 1000 and max(sent) < 2 * sum(sent) / buckets


def test_suffix_order_and_longest_previous_factors():
    rnd = random.Random(2)
    for length in (21, 30, 50):
        text = bytes(rnd.choice(b"ab") if rnd.random() < 0.9 else rnd.choice(b"abc") for _ in range(600)) + b"ab" * 60
        text += text[100:260]
        starts = np.array(sorted(rnd.sample(range(len(text) - length), 400)))
        doc = np.array([rnd.randrange(12) for _ in starts])
        suffixes = suffix_dedup.SuffixOrder(np.frombuffer(text, np.uint8), length)
        order = suffixes.sort(starts)
        windows = [text[p : p + length] for p in starts]
        assert [windows[k] for k in order] == sorted(windows)
        agree = lambda x, y: next((k for k in range(length) if x[k] != y[k]), length)
        lcp = np.append(0, suffixes.agree(starts[order[:-1]], starts[order[1:]]))
        assert lcp.tolist() == [0, *(agree(windows[a], windows[b]) for a, b in zip(order[:-1], order[1:]))]
        for least in (1, 5, length):
            got = suffix_dedup.longest_previous_factor(doc[order], lcp, least)
            for k, factor in zip(order, got.tolist()):
                want = max((agree(windows[k], windows[x]) for x in range(len(windows)) if doc[x] < doc[k]), default=0)
                assert factor == (want if want >= least else 0)


def test_previous_factors_of_long_falling_and_rising_stretches():
    for doc in (np.arange(5000), np.arange(5000)[::-1].copy(), np.zeros(5000, np.int64), np.arange(5000) % 7):
        lcp = np.append(0, np.full(4999, 60))
        assert ((suffix_dedup.longest_previous_factor(doc, lcp, 50) > 0) == (doc > doc.min())).all()


def test_ids_that_repeat_over_chunks_and_very_long_texts(spark):
    rnd = random.Random(6)
    own = lambda k: "".join(rnd.choice("abcdefghijklmnop") for _ in range(k))
    shared = own(300)
    rows = [(1, own(80) + shared[k : k + 150] + own(80)) for k in range(0, 150, 30)] + [(None, shared[:100])] * 3 + [(2, own(300_000) + shared + own(300_000)), (3, shared), (3, shared), (4, "é" * 400), (5, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted((low(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_suffix(rows, 50))
