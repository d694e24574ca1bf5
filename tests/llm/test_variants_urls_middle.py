"""Spelling variants, URL filters and fill-in-middle against plain versions of them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF
from pyspark.sql import functions as F

from tripspark.llm import fill_middle, spelling_variants, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
nn = lambda rows: sorted(rows, key=repr)


def brute_counts(rows, every, chars, least):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= chars
    return {w: k for w, k in n.items() if k >= least}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, times=2):
    near = {a: [b for b in counts if abs(len(a) - len(b)) < 2 and is_near(a, b)] for a in counts}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= times * counts[a] else None
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        yield a, form[a], root, counts[a], len(near[a]), counts[form[a]] if form[a] is not None else None


def test_counted_words(odd, odd_rows, none):
    for every, chars, least in ((97, 5, 3), (3, 1, 1)):
        got = {r.word: r.n for r in spelling_variants.counted_words(odd, every=every, min_chars=chars, min_count=least).collect()}
        assert got == brute_counts(odd_rows, every, chars, least)
    assert spelling_variants.counted_words(none).count() == 0


def test_spelling_variants(spark, none):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))): int(2 ** rnd.uniform(0, 9)) for _ in range(400)}
    words |= {"aaaa": 70, "aaa": 9, "aaaaa": 2, "": 3, "é": 4, "日本語": 8, "日本": 1, "日語": 2, "x" * 5000: 4, "x" * 4999: 9, "x" * 4998 + "yx": 2}
    table = spark.createDataFrame([(w, n, 1, 2) for w, n in words.items()] + [(None, 5, 1, 2)], "word string, n bigint, wid bigint, form int").repartition(5)
    for times in (2, 3):
        got = spelling_variants.spelling_variants(table, times).collect()
        assert nn((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == nn(brute_variants(words, times))
    assert spelling_variants.spelling_variants(none.select(F.col("text").alias("word"), F.col("id").alias("n"))).count() == 0
    # the whole way
    got = spelling_variants.spelling_variants(spelling_variants.counted_words(none.sparkSession.createDataFrame([(1, "stone stone stone stones stones stoned stone stone")], "doc_id int, text string"), min_count=1)).collect()
    assert {r.word: (r.form, r.root) for r in got} == {"stone": (None, "stone"), "stones": ("stone", "stone"), "stoned": ("stone", "stone")}


def test_trie_numbers_are_those_of_the_prefixes():
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in range(150)})
    for parts in (1, 3, 40):
        at = sorted({0, *(rnd.randrange(len(words)) for _ in range(parts - 1))})
        firsts, seen = [words[k] for k in at], {}
        for lo, hi in zip(at, [*at[1:], len(words)]):
            numbers = spelling_variants.TrieNumbers(firsts)
            for w in words[lo:hi]:
                for k, node in enumerate(numbers.nodes(w)):
                    assert seen.setdefault(w[:k], node) == node
        assert len(set(seen.values())) == len(seen)


def test_groups_over_several_batches():
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    rows = sorted({(int(p), int(s), not skip, -int(n), int(w)) for p, s, skip, n, w in zip(rnd.integers(0, 9, 300), rnd.integers(0, 4, 300), rnd.random(300) < 0.9, rnd.integers(1, 50, 300), range(300))})
    whole, kept = set(), []
    for p, s, plain, n, w in rows:  # at most one word does not skip
        if not plain or (p, s) not in whole:
            kept.append((p, s, not plain, -n, w, not plain and w % 2 == 0))
            whole |= {(p, s)} if plain else set()
    cols = dict(zip(("p", "s", "skip", "n", "wid", "fresh"), map(list, zip(*kept))))
    table = pa.table(cols)
    one = [b.to_pylist() for b in spelling_variants.settle(iter(table.to_batches()))]
    for size in (1, 7, 50):
        many = [b.to_pylist() for b in spelling_variants.settle(iter(table.to_batches(max_chunksize=size)))]
        assert sorted(map(repr, sum(many, []))) == sorted(map(repr, sum(one, [])))
    assert list(spelling_variants.settle(iter([]))) == []


URLS = [
    (1, "https://www.Example.ORG/es/x?y#z"), (2, "http://example.org/en/1"), (3, "http://example.org/en/12.html"), (4, "http://a.org"), (5, "http://org/"), (6, "http://borg/x"), (7, "x.com/fr/1"), (8, None), (9, ""),
    (10, "ftp://a.b.com/de/?q=://c.org/"), (11, "://"), (12, "http://a.com/fr/1://b.org/"), (13, "http://é.COM/de/\nx#"), (14, "http://casino-win.net/1"), (14, "http://casino-win.net/1"), (None, "http://casinos.net/1?2"), (15, "http://a.example.org?es/"), (16, "HTTP://X.example.org/es/#" + "q" * 9000),
]


def brute_urls(rows, listed, rules):
    for i, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
            host, slash, path = rest.partition("/")
            host, path = host.translate(LOWER), slash + path
        fits = [(len(h + p), len(h), a == "block", a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        hit = host + path in listed
        yield i, host, path, max(fits)[4] if fits else None, max(fits)[3] if fits else ("block" if hit else "allow"), hit


def test_url_filter(spark, none):
    pages = spark.createDataFrame([(i, u, "h", "k", True) for i, u in URLS], "page_id bigint, url string, host string, key string, listed boolean").repartition(4)
    listed = {"casino-win.net/1", "a.org", "", "nowhere.net/"}
    table = spark.createDataFrame([(k,) for k in [*listed, "a.org"]] + [(None,)], "key string")
    for rules in (url_filter.RULES, (), (("allow", "a.org", ""), ("block", "a.org", ""))):
        for bits in (1 << 29, 1):  # too large a cascade is looked up by a join
            got = url_filter.url_filter(pages, table, rules, most_bits=bits).collect()
            assert nn(tuple(r) for r in got) == nn(brute_urls(URLS, listed, rules))
    assert url_filter.url_filter(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), table).count() == 0
    assert {r.listed for r in url_filter.url_filter(pages, none.select(F.col("text").alias("key"))).collect()} == {False}


def test_cascade_is_exact_at_any_rate(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for rate in (0.5, 1 / 64):
        levels = url_filter.cascade(keys, rate)
        assert len(levels) > (4 if rate == 0.5 else 1)
        assert keys.where(url_filter.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0
        assert sum(x.size for x in levels) < 3000 * 8
    every = keys.withColumn("listed", F.lit(True))
    assert every.where(~url_filter.is_listed(F.col("key"), url_filter.cascade(every))).count() == 0
    assert url_filter.cascade(keys.where("NOT listed")) == []


def brute_middle(i, text):
    text = text or ""
    us = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(us), "plain", None, None, text
    a, b = sorted(x % (len(us) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (us[:a], us[a:b], us[b:]))
    return (i, len(us), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (i, len(us), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, odd, odd_rows, none):
    more = [(900, "a<P>b"), (901, "<S"), (902, "S> <P <M"), (903, "<<P"), (904, "x" * 30_000), (905, "é" * 20_000), (906, "ab1 " * 400_000), (907, "😀a" * 9), (908, "\n"), (909, "<<S<M<P")]
    rows = [(i, t) for i, t, *_ in odd_rows] + more + [(i, "<S<P<M " + "word " * (i % 50) + "é") for i in range(2000, 2200)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id bigint, text string")).withColumns({"n": F.lit(1), "output": F.lit("o"), "key": F.lit("k"), "form": F.lit("f")})
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored()).collect()
    assert nn(tuple(r)[:6] for r in got) == nn(brute_middle(i, t) for i, t in rows)
    assert nn((r.doc_id, r.back) for r in got) == nn((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(none).count() == 0


def test_chunks_are_those_of_the_content():
    rnd = random.Random(9)
    shared = "".join(rnd.choice("abc dé.\n") for _ in range(20_000)).encode()
    cut = lambda t: {t[a:b] for ends in [fill_middle.chunk_ends(np.frombuffer(t, np.uint8))] for a, b in zip([0, *ends], ends)}
    one, two = cut(b"some opening " + shared), cut(b"another one, longer; " * 9 + shared)
    assert len(one & two) > 0.8 * len(one) > 10
    long = shared * 120  # more than one piece is hashed
    ends = fill_middle.chunk_ends(np.frombuffer(long, np.uint8))
    assert ends[-1] == len(long) and all(0 < b - a <= fill_middle.MOST for a, b in zip([0, *ends], ends))
    cache = fill_middle.ChunkCache(most_bytes=3000)
    for k in range(5):
        text = shared[k * 1001 : 9000 + k * 1001].decode(errors="ignore")
        whole = fill_middle.Chunked(text.encode(), cache)
        us = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert whole.n == len(us) and whole.chars[-1] == len(text)
        for at in (0, 1, whole.n // 3, whole.n - 1, whole.n):
            assert whole.cut(at) == (len("".join(us[:at]).encode()), len("".join(us[:at])))


@pytest.mark.parametrize("module", [spelling_variants, url_filter, fill_middle])
def test_queries_read_whole_tables(spark, module):
    query = next(f for n, f in vars(module).items() if re.match(r"op\d+_", n))
    assert query(spark, SF).count() > 0
