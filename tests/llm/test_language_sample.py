import math
import random
import re
import zlib
from collections import Counter, defaultdict

from tripspark.llm import language_id

SCHEMA = "doc_id bigint, text string, lang string"


def words(seed, letters, n=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 8))) for _ in range(n)]


def rows(first, lang, n, own):
    rnd = random.Random(first)
    return [(first + i, " ".join(rnd.choice(own) for _ in range(30)), lang) for i in range(n)]


def predicted(spark, docs, seen, **how):
    model = language_id.train(spark.createDataFrame(docs, SCHEMA), **how)
    return {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(seen, SCHEMA), model).collect()}


def test_a_rare_language_is_learned_beside_large_ones(spark):
    ka = words(3, "აბგდევზთიკლმნოპ")
    docs = rows(0, "en", 3000, words(1, "abcdefgh")) + rows(10_000, "de", 3000, words(2, "ijklmnop")) + rows(20_000, "ka", 12, ka)
    got = predicted(spark, docs, rows(30_000, None, 20, ka), max_train=60)
    assert all(lang == "ka" and score > 0.99 for lang, score in got.values())


def test_any_number_of_languages_is_learned(spark):
    letters = [chr(0x4E00 + k) for k in range(80 * 10)]
    own = {f"l{k:02}": words(k, letters[10 * k : 10 * k + 10]) for k in range(80)}
    docs = [r for k, lang in enumerate(own) for r in rows(100 * k, lang, 12, own[lang])]
    got = predicted(spark, docs, [(100_000 + k, " ".join(own[lang][:20]), None) for k, lang in enumerate(own)], max_train=200)
    assert {i: lang for i, (lang, _) in got.items()} == {100_000 + k: lang for k, lang in enumerate(own)}
    few = predicted(spark, docs, [(100_000 + k, " ".join(own[lang]), None) for k, lang in enumerate(own)], max_train=1)
    assert {lang for lang, _ in few.values()} == set(own)


def test_quota():
    assert language_id.quota([5, 100, 1000], 300) == 195 and language_id.quota([5, 10_000, 10_000], 105) == 50 and language_id.quota([3, 4], 100) == 4


def brute_predictions(docs, seen):
    """Every word of every text looked up by itself, in plain dictionaries."""
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in docs:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            words[lang].update(letters(text))
    langs = sorted(words)
    for lang in langs:
        for w, n in words[lang].items():
            f = f"^{w}$"
            for k in range(1, min(4, len(f)) + 1):
                for a in range(len(f) - k + 1):
                    grams[lang][f[a : a + k]] += n

    def gains(counts):
        total = {lang: max(sum(counts[lang].values()), 1) for lang in langs}
        floor = 0.5 / max(total.values(), default=1)
        return lambda item: [math.log1p(counts[lang][item] / total[lang] / floor) if counts[lang][item] else 0.0 for lang in langs]

    of_word, of_gram = gains(words), gains(grams)
    for i, text in seen:
        own, total = letters(text), [0.0] * len(langs)
        for w in own:
            gain = of_word(w)
            if not any(gain):
                f = f"^{w}$"
                for k in range(min(4, len(f)), 0, -1):
                    known = [g for g in (of_gram(f[a : a + k]) for a in range(len(f) - k + 1)) if any(g)]
                    if known:
                        gain = [sum(x) / len(known) for x in zip(*known)]
                        break
            total = [a + b for a, b in zip(total, gain)]
        yield i, langs[total.index(max(total))] if own else "und", 1 / sum(math.exp(x - max(total)) for x in total) if own else 0.0


def test_predictions_by_brute_force(spark, odd, odd_rows):
    rnd = random.Random(9)
    docs = [(i, t, lang) for i, t, lang, _ in odd_rows]
    model = language_id.train(odd, max_train=10**9, max_words=10**6, max_grams=10**6)
    seen = [(k, "".join(rnd.choice("the of dieundrs xqzé .\n") for _ in range(rnd.randint(0, 30)))) for k in range(300)] + [(900, None), (901, ""), (902, "123 !"), (903, "the the DIE"), (903, "haus")]
    got = language_id.predict(spark.createDataFrame(seen, "doc_id bigint, text string"), model).collect()
    want = list(brute_predictions(docs, seen))
    for r, (i, lang, score) in zip(sorted(got, key=lambda r: (r.doc_id, -r.score)), sorted(want, key=lambda x: (x[0], -x[2]))):
        assert r.doc_id == i and abs(r.score - score) < 1e-9 and (r.lang_pred == lang or abs(score - 0.5) < 1e-9), (r, lang, score)


def test_ties_at_the_limit_keep_about_as_many_as_there_is_room_for(spark):
    rows_ = [(k, f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{'x' * (k // 676)}", "en") for k in range(2000) if zlib.crc32(str(k).encode()) % 4 != 2]
    model = language_id.train(spark.createDataFrame(rows_, SCHEMA), max_words=400, max_grams=50)
    assert 300 < len(model.word_row) < 500 and 20 < len(model.gram_row) < 90


def test_null_and_repeated_ids_do_not_break_the_bound(spark):
    en, de = words(1, "abcdefgh"), words(2, "ijklmnop")
    docs = [(None, t, lang) for _, t, lang in rows(0, "en", 40_000, en)] + [(7, t, lang) for _, t, lang in rows(50_000, "de", 3000, de)] + [(8, "one row again and again", "de")] * 500
    model = language_id.train(spark.createDataFrame(docs, SCHEMA).repartition(8), max_train=200, max_words=10**6, max_grams=10**6)
    # about a hundred rows of thirty words teach each language, from all over its rows
    assert {k: 0.4 < v / 3000 < 1.6 for k, v in model.taught.items()} == {"en": True, "de": True}
