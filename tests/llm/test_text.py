import hashlib
import json
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripspark.llm import bpe, language_id, license_scan, quality_rules, token_counts
from tripspark.llm.tokenization_automaton import TokenizationAutomaton

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
TEXTS = ["", "   ", "a", "'s it's I'LL Don't", "Σίσυφος ΟΔΥΣΣΕΥΣ", "İstanbul ǅ ﬁ", "日本語テキスト 123 ４５", "<|endoftext|>hello <|startoftext|> x", "a\x1cb\x85c d", "é café", "a" * 40, "naïve 😀😀👍🏽 !!!???...---", "x" * 3000, "  two  three   four    ", "\n\n a\n  b\t\tc", "▁ ▁▁x <s> </s> <0x0A> <unk>", " " * 37 + "z" + " " * 100]


def some_texts():
    rnd = random.Random(1)
    letters = "abcdehilnorst" * 3 + "AEé' .,!0123\n  ▁日ñß"
    return TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)] + ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 40))) for _ in range(300)]


def library():
    t = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_library_and_round_trips():
    model, lib = bpe.WordBpe(public_tokenizers.path(bpe.VOCABULARY)), library()
    texts = some_texts()
    for (ids, text), e in zip(model.encode_many(texts, most=500), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert text == lib.decode(e.ids, skip_special_tokens=False) == model.decode(ids)


def equal_to_library(model, lib, texts):
    for text, (ids, decoded), e in zip(texts, model.encode_many(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids and decoded == lib.decode(e.ids, skip_special_tokens=False), ascii(text)[:300]


def test_bpe_equals_library_on_every_code_point():
    model, lib = bpe.WordBpe(public_tokenizers.path(bpe.VOCABULARY)), library()
    agreed, others = [], []
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        (agreed if bpe.known_to_python(c) and c not in model.odd else others).append(c)
    assert len(agreed) > 250_000
    for part in (agreed, others):  # apart, as one odd character sends its whole text the other way
        equal_to_library(model, lib, [" ".join(f"a{c}b {c} {c}{c}" for c in part[lo : lo + 500]) for lo in range(0, len(part), 500)])


def test_bpe_equals_library_on_random_unicode():
    model, lib, rnd = bpe.WordBpe(public_tokenizers.path(bpe.VOCABULARY)), library(), random.Random(5)
    points = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    agreed = [c for c in points if bpe.known_to_python(c) and c not in model.odd]
    marks, made = [c for c in agreed if unicodedata.combining(c)], [c for c in agreed if unicodedata.decomposition(c)]
    for letters in (points, agreed):
        pick = [lambda: rnd.choice(letters), lambda: rnd.choice(marks), lambda: unicodedata.normalize("NFD", rnd.choice(made)), lambda: rnd.choice("aeiou '\nABΣς")]
        equal_to_library(model, lib, ["".join(rnd.choice(pick)() for _ in range(rnd.randint(1, 30))) for _ in range(4000)])


def test_bpe_refuses_other_vocabularies(tmp_path):
    with pytest.raises(ValueError):
        bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"][0]["type"] = "NFKC"
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        bpe.WordBpe(str(tmp_path / "other.json"))


def merged(units, merges):
    """The definition: in order of rank, from left to right, until nothing merges."""
    rank = {(u, v): (r, made) for r, (u, v, made) in reversed(list(enumerate(merges)))}
    out = list(units)
    while best := min((rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank) if any(p in rank for p in zip(out, out[1:])) else None:
        i = best[1]
        out[i : i + 2] = [rank[out[i], out[i + 1]][1]]
    return out


def test_tokenization_automaton_on_small_vocabularies():
    rnd = random.Random(8)
    for _ in range(150):
        merges, tokens = [], [0, 1, 2]
        for made in range(3, rnd.randint(4, 14)):
            merges.append((rnd.choice(tokens), rnd.choice(tokens), made))
            tokens.append(made)
        pairs, kept, have = set(), [], {0, 1, 2}
        for u, v, made in merges:  # a pair merges once, and of tokens that were made before
            if (u, v) not in pairs and {u, v} <= have:
                pairs.add((u, v))
                have.add(made)
                kept.append((u, v, made))
        merges = kept or [(0, 1, 3)]
        automaton = TokenizationAutomaton(3, merges, most=rnd.choice([5, 1000]))
        for _ in range(60):
            word = [rnd.randrange(3) for _ in range(rnd.randint(1, 12))]
            assert automaton.encode(word) == merged(word, merges), (merges, word)


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        TokenizationAutomaton(2, [(2, 1, 3), (0, 1, 2)])


def test_gadgets_take_arcs_from_rows():
    # ab, then bc: after a no b; bc never follows a, as a has taken its b before
    automaton = TokenizationAutomaton(3, [(0, 1, 3), (1, 2, 4)])
    after = lambda t: automaton.rows[automaton.state_of[t]]
    assert not automaton.arc(after(0), 1) and not automaton.arc(after(0), 4) and automaton.arc(after(3), 2) and not automaton.arc(after(1), 2)


def test_bpe_operator(odd, odd_rows, none):
    lib = library()
    got = bpe.bpe_encode(odd).collect()
    want = Counter((i, sha(np.array(e.ids, "<u4").tobytes()), sha(lib.decode(e.ids, skip_special_tokens=False))) for (i, t, *_), e in ((r, lib.encode(r[1] or "", add_special_tokens=False)) for r in odd_rows))
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) and sha(r.decoded) == r.decoded_sha256 for r in got) and bpe.bpe_encode(none).count() == 0


def test_bpe_query(spark):
    lib = library()
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = bpe.op5_bpe(spark, SF).collect()
    assert len(got) == len(rows) and all(r.ids_sha256 == sha(np.array(lib.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in got)


def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.VOCABULARY))


def test_token_counts_of_texts_and_prefixes():
    model, lib, texts = token_counts.Pieces(public_tokenizers.path(token_counts.VOCABULARY)), pieces(), some_texts()
    assert model.count(texts) == [len(x) for x in lib.encode(texts)]
    for t in texts[::9] + TEXTS:
        t = t[:300]
        assert model.prefix_counts(t) == [len(lib.encode(t[:i])) for i in range(len(t) + 1)]


def test_token_counts_operator(odd, odd_rows, none):
    lib = pieces()
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 100) for i, t, *_ in odd_rows)
    assert Counter(tuple(r) for r in token_counts.token_counts(odd, limit=100).collect()) == want
    assert token_counts.token_counts(none).count() == 0
    short = odd.where("length(text) < 400")
    fits = token_counts.fit_budget(token_counts.prefix_token_counts(short), 20).collect()
    by_id = {i: t for i, t, *_ in odd_rows}
    for r in fits:
        if r.doc_id is not None:
            t = by_id[r.doc_id]
            assert r.fit_chars == max(k for k in range(len(t) + 1) if len(lib.encode(t[:k])) <= 20)


def test_token_counts_query(spark):
    lib = pieces()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.op10_token_counts(spark, SF).collect()} == {i: (len(t.encode()), len(lib.encode(t))) for i, t in rows.items()}


def brute_quality(text):
    blanks = r"[\x20\x09-\x0D]+"
    words = [w for w in re.split(blanks, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def test_quality_counts(spark, odd, odd_rows, none):
    got = quality_rules.quality_rules(odd).collect()
    want = Counter((i, *brute_quality(t or "")) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and quality_rules.quality_rules(none).count() == 0


def test_quality_rejects_depleted_documents(spark):
    menu, own = "home about contact terms privacy help login cart search offers news blog", [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(60)]
    rows = [(i, f"{menu}\n{own[i]}" if i < 30 else "\n".join([menu] * 1 + ["a b c d e f g h i j k l"] + [f"only{i} one two"]), "h") for i in range(60)]
    out = {r.doc_id: (r.kept, r.n_boilerplate_words) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_docs=5).collect()}
    assert out[0] == (True, 12) and out[40] == (False, 24)


def brute_boilerplate(rows, min_docs, share):
    """(lost words, text left) of each row (id, text, host)."""
    blanks, key = " \t\n\x0b\x0c\r", lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    docs, lines = {}, {}
    for k, (i, text, host) in enumerate(rows):
        doc = i if i is not None else ("row", k)
        docs.setdefault(host, set()).add(doc)
        for x in (text or "").split("\n"):
            if key(x):
                lines.setdefault((host, key(x)), set()).add(doc)
    gone = {x for x, d in lines.items() if len(d) > min_docs and len(d) > share * len(docs[x[0]])}
    for i, text, host in rows:
        own = (text or "").split("\n")
        cut = [x for x in own if (host, key(x)) in gone]
        yield sum(len([w for w in re.split(f"[{blanks}]+", x) if w]) for x in cut), "\n".join(x for x in own if (host, key(x)) not in gone)


def test_quality_on_repeated_rows_and_null_ids(spark, odd, odd_rows):
    menu, rnd = "Home about contact terms privacy help login cart search offers news blog", random.Random(4)
    body = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    rows = [(i, f"{menu}\n{body()}", "h") for i in range(8)] + [(100, f"{menu} \n{body()}", "h")] * 3 + [(None, f"\t{menu.upper()}\n{body()}", "h") for _ in range(3)]
    rows += [(200, f"{menu}\nonly in copies", "g")] * 9 + [(300 + i, None, None) for i in range(9)] + [(400 + i, f"{menu}\n\n{menu}\n{body()}", None) for i in range(9)]
    for table, options in ((rows, dict(min_docs=5, min_share=0.01)), (rows, dict(min_docs=2, min_share=0.7)), ([(i, t, s) for i, t, _, s in odd_rows], dict(min_docs=4, min_share=0.05))):
        docs = spark.createDataFrame(table, "doc_id bigint, text string, source string").repartition(3)
        got = quality_rules.quality_rules(docs, keep_text=True, **options).collect()
        want = Counter((i, n, left) for (i, _, _), (n, left) in zip(table, brute_boilerplate(table, options["min_docs"], options["min_share"])))
        assert Counter((r.doc_id, r.n_boilerplate_words, r.kept_text) for r in got) == want
        assert all(r.kept == (not r.base_failed and r.n_words - r.n_boilerplate_words >= max(20, r.n_words / 2)) for r in got)


def test_language_id(spark, odd, odd_rows, none):
    model = language_id.train(odd)
    got = language_id.predict(odd, model).collect()
    known = {(i, t): lang for i, t, lang, _ in odd_rows if lang and t and i is not None and i < 150}
    right = [r.lang_pred == known[k] for r, k in ((r, next((k for k in known if k[0] == r.doc_id), None)) for r in got) if k]
    assert sum(right) / len(right) > 0.9
    assert all(r.lang_pred in ("und", "en", "de") and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (r.doc_id in (160, 161, 162) or r.doc_id is None and r.score == 0) for r in got)
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (160, 161, 162)").count() == 0 and kept.where("doc_id < 60").count() > 50


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert out.where(F.col("lang") == F.col("lang_pred")).count() / out.count() > 0.97


LICENSED = ["Some prose here. Licensed under the Apache License, Version 2.0. And on it goes.", "x\nReleased under the MIT License.\ny", "ALL RIGHTS RESERVED", "nothing of the kind", None, "", "licensed under the apache license " + "and then other words " * 9]


def brute_licenses(text):
    norm = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[^\w\s]+", "", t.lower())) if w]
    words = norm(text or "")
    for tid, name, body in license_scan.TEMPLATES:
        t = norm(body)
        k = min(5, len(t))
        want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        have = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        if len(want & have) >= 0.8 * len(want):
            yield tid


def test_license_scan(spark, none):
    filler = "other words that come before and after the notice " * 30
    texts = LICENSED + [filler + body + " " + filler for _, _, body in license_scan.TEMPLATES] + [body for _, _, body in license_scan.TEMPLATES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = license_scan.license_scan(docs).collect()
    assert sorted((r.doc_id, r.template_id) for r in got) == sorted((i, x) for i, t in enumerate(texts) for x in brute_licenses(t))
    assert license_scan.license_scan(none).count() == 0 and license_scan.license_scan(docs, []).count() == 0


def test_license_scan_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = license_scan.op7_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.template_id) for r in got) == sorted((r.doc_id, x) for r in rows for x in brute_licenses(r.text))


@pytest.mark.parametrize("jaccard, recall", [(0.2, 0.9999), (0.5, 0.99)])
def test_bands_keep_their_promise(jaccard, recall):
    b = license_scan.bands_for(jaccard, recall)
    assert 1 - (1 - jaccard) ** b >= recall > 1 - (1 - jaccard) ** (b - 1)
