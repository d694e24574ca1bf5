import random

import pytest

LANGS = {"en": "the of and to house river stone light".split(), "de": "der die und haus fluss stein licht ist".split()}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, id bigint, digest string, words string, chunk bigint, h1 bigint, slot bigint, tiles string, group string"


def text_of(rnd, lang, n):
    return " ".join(rnd.choice(LANGS[lang]) + rnd.choice(["", "", "s", "en", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, shared passages."""
    rnd = random.Random(11)
    base = {k: text_of(rnd, k, 120) for k in LANGS}
    rows = [(i, text_of(rnd, lang, rnd.randint(1, 80)), lang, f"s{i % 3}") for i, lang in zip(range(60), ["en", "de"] * 30)]
    words = base["en"].split()
    rows += [(100 + i, base["en"], "en", "s0") for i in range(12)]
    rows += [(120 + i, " ".join(words[: 60 + i] + ["changed"] + words[61 + i :]), "en", "s1") for i in range(8)]
    rows += [(140 + i, text_of(rnd, "de", 20) + "\n" + base["de"][:200] + "\n" + text_of(rnd, "de", 5), "de", None) for i in range(11)]
    rows += [(160, None, "en", "s0"), (161, "", None, "s0"), (162, "   \n\t ", "en", None), (163, "Only", None, "s2"), (None, "No id here at all", "en", "s1"), (None, None, None, None)]
    rows += [(170, "long " * 40_000, "en", "s2"), (171, base["en"].upper(), "en", "s2"), (5, rows[5][1], "de", "s2"), (172, "é ÀÉÎ ß 日本語 " * 4, "de", "s1"), (173, "x" * 3000, None, "s1"), (174, "a\nA \n\na", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    full = [(*r, None, True, 7, "digest", "words", 3, 4, 5, "tiles", "group") for r in odd_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
