import hashlib
from collections import Counter, defaultdict

from helpers import SF, same

from tripspark.llm import exact_dedup, line_dedup, registry, suffix_dedup
from tripspark.llm.common import WS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
low = lambda x: -(1 << 63) if x is None else x


def test_sql(spark, duck):
    for name, sql in registry.oracle_sql().items():
        same(registry.queries()[name](spark, SF), duck, sql)


def test_exact_dedup(odd, odd_rows, none):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[sha((t or "").translate(LOWER))].append(i)
    want = Counter((low(i), max((x for x in g if x is not None), default=None) if any(x is not None for x in g) else None, len(g), d) for d, g in groups.items() for i in g)
    for tracked, hot in ((8192, 64), (64, 2)):
        got = exact_dedup.exact_dedup(odd, tracked=tracked, hot_min=hot).collect()
        assert Counter((low(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(none).count() == 0
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and Counter(r.doc_id for r in left.collect())[171] == 1 and left.where("doc_id BETWEEN 100 AND 111").count() == 0
    assert left.where("doc_id = 5").count() == 2  # a repeated row stays with its like


def brute_suffix(rows, length):
    first = {}
    docs = [(low(i), (t or "").encode()) for i, t, *_ in rows]
    for i, t in sorted(docs):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))


def test_suffix_dedup(odd, odd_rows, none):
    for length in (50, 30):
        got = suffix_dedup.suffix_dedup(odd, length).collect()
        assert sorted((low(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_suffix(odd_rows, length))
        assert all(sha(bytes(r.kept)) == r.kept_sha256 and len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = suffix_dedup.op2_suffix_dedup(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_suffix(rows, 50))


def brute_lines(rows, min_docs):
    key = lambda x: x.strip(WS).translate(LOWER)
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= min_docs)]
        yield low(i), len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup(odd, odd_rows, none):
    for batches in (odd, [odd], [odd.where("doc_id < 100"), odd.where("doc_id >= 100"), odd.where("doc_id IS NULL"), none]):
        for min_docs in (10, 2):
            got = line_dedup.line_dedup(batches, min_docs, fanout=2).collect()
            assert sorted((low(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == sorted(brute_lines(odd_rows, min_docs))
    assert line_dedup.line_dedup([none]).count() == 0


def test_line_runs_are_levelled_and_know_what_is_new(spark, odd):
    runs = line_dedup.LineRuns(spark, fanout=2)
    parts, seen = [odd.where(f"doc_id % 4 = {k}") for k in range(4)], set()
    for k, part in enumerate(parts):
        own = {(r.h1, r.h2) for r in line_dedup.line_hashes(part, 1, "doc_id", "text").collect()}
        assert {(r.h1, r.h2) for r in runs.unseen(part).collect()} == own - seen
        seen |= own
        runs.add(part)
        held = [(r.h1, r.h2) for r in runs.keys().collect()]
        assert len(held) == len(set(held)) and set(held) == seen  # a line is new in one run only
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert runs.unseen(parts[1]).count() == 0 and runs.unseen(spark.createDataFrame([(1, "never seen")], "doc_id bigint, text string")).count() == 1
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_runs_are_matched_and_merged_without_a_shuffle(spark, odd):
    runs = line_dedup.LineRuns(spark, fanout=9)
    for k in range(3):
        runs.add(odd.where(f"doc_id % 3 = {k}"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(runs.all()) and "Bucketed: true" in plan(runs.all())
    unseen = plan(runs.unseen(odd))
    assert "SortMergeJoin" in unseen and unseen.count("Exchange hashpartitioning") == 1  # the batch only
    runs.close()
