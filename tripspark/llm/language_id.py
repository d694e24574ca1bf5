"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored
by its longest n-grams that are known: of 4 characters, else 3, 2, 1. The model
is fitted by Spark on a sample of labelled rows of bounded size (``max_train``),
dealt evenly over all languages however rare they are, and keeps at most
``max_words`` words and ``max_grams`` n-grams of each language, so that it can be
broadcast at any input size. It holds only what a language has, so any number of
languages is learned. Prediction works row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.arrays import ragged
from tripspark.llm.common import cut, documents, free_memory, hold, small_batches

LONGEST = 4
#: Values of a row of training is picked by: a hash of the id, below this.
PICKS = 1 << 30
#: Cells of a worker's dense table of new words by languages.
CELLS = 1 << 22
#: Unseen words kept in a task's table before it is begun anew.
KEPT_WORDS = 60_000


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _most_frequent(counts: DataFrame, item: str, most: int) -> DataFrame:
    """Of each language the ``most`` items of the highest counts; of those that tie at the limit so many as there is room for, about, picked by a hash. No ordering of all items is needed."""
    spread = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("items")).collect()  # one row per language and distinct count
    tiers: dict[str, list[tuple[int, int]]] = {}
    for r in spread:
        tiers.setdefault(r.lang, []).append((r.n, r["items"]))
    least: list[tuple[str, int, int]] = []
    for lang, found in tiers.items():
        room, limit, part = most, 0, PICKS
        for n, size in sorted(found, reverse=True):
            if size > room:
                limit, part = n, PICKS * room // size
                break
            room -= size
        least.append((lang, limit, part))
    lowest = counts.sparkSession.createDataFrame(least, "lang string, least bigint, part bigint")  # one row per language
    picked = F.pmod(F.xxhash64(F.lit(3), item), F.lit(PICKS)) < F.col("part")
    return counts.join(F.broadcast(lowest), "lang").where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & picked)).select("lang", item, "n")


class Table:
    """Rows of (language, gain), each row only with the languages that have something."""

    def __init__(self, size: np.ndarray, lang: np.ndarray, gain: np.ndarray):
        self.begin = np.append(0, np.cumsum(size)).astype(np.int64)
        self.lang, self.gain = lang, gain

    def sums(self, rows: np.ndarray, into: np.ndarray, n: int, langs: int) -> np.ndarray:
        """The gains of the rows, added up in row ``into`` of a table of n rows and all languages."""
        size = self.begin[rows + 1] - self.begin[rows]
        cells = ragged(self.begin[rows], size)
        return np.bincount(np.repeat(into, size) * langs + self.lang[cells], self.gain[cells], n * langs).reshape(n, langs)

    def extended(self, dense: np.ndarray) -> Table:
        row, lang = np.nonzero(dense)
        size = np.append(np.diff(self.begin), np.bincount(row, minlength=len(dense)))
        return Table(size, np.append(self.lang, lang), np.append(self.gain, dense[row, lang]))


class Model:
    """Of words and n-grams how far the log frequency in a language is above the floor; the floor is the same for all, so it takes no part in a comparison."""

    def __init__(self, langs: list[str], words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = langs
        at = {lang: k for k, lang in enumerate(langs)}
        self.word_row, self.words = self._table(words, at)
        self.gram_row, self.grams = self._table(grams, at)
        #: Words that taught each language.
        self.taught = dict.fromkeys(langs, 0)
        for lang, _, n in words:
            self.taught[lang] += n

    def _table(self, counts: list[tuple[str, str, int]], at: dict[str, int]) -> tuple[dict[str, int], Table]:
        items = sorted({w for _, w, _ in counts})
        row = {w: k for k, w in enumerate(items)}
        rows, lang, n = (np.array([f(x) for x in counts], kind) for f, kind in ((lambda x: row[x[1]], np.int64), (lambda x: at[x[0]], np.int64), (lambda x: x[2], np.float64)))
        total = np.maximum(np.bincount(lang, n, len(at)), 1.0)
        order = np.lexsort((lang, rows))
        # one floor for all languages: else what is unseen would count for the language with the least data
        floor = 0.5 / total.max(initial=1.0)
        return row, Table(np.bincount(rows, minlength=len(items)), lang[order], np.log1p(n / total[lang] / floor)[order])


class Scorer:
    """A worker's view of the model, with a table of the unseen words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self._begin()
        self.letters = regex.compile(r"\p{L}+").findall

    def _begin(self) -> None:
        nothing = np.zeros(0, np.int64)
        self.row, self.unseen = {}, Table(nothing, nothing, np.zeros(0))

    def _unseen(self, words: list[str]) -> np.ndarray:
        grams, into, size = [], [], np.ones(len(words))
        rows = self.model.gram_row
        for k, word in enumerate(words):
            framed = f"^{word}$"
            for n in range(min(LONGEST, len(framed)), 0, -1):
                known = [rows[g] for g in (framed[i : i + n] for i in range(len(framed) - n + 1)) if g in rows]
                if known:
                    grams += known
                    into += [k] * len(known)
                    size[k] = len(known)
                    break
        return self.model.grams.sums(np.array(grams, np.int64), np.array(into, np.int64), len(words), len(self.model.langs)) / size[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [self.letters(t.lower()) if t else [] for t in texts]
        if not self.model.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.row) > KEPT_WORDS:
            self._begin()
        new = list({w for words in split for w in words} - self.model.word_row.keys() - self.row.keys())
        most = max(1, CELLS // len(self.model.langs))
        for lo in range(0, len(new), most):
            part = new[lo : lo + most]
            self.row.update(zip(part, range(len(self.row), len(self.row) + len(part))))
            self.unseen = self.unseen.extended(self._unseen(part))
        size = [len(words) for words in split]
        into, many, langs = np.repeat(np.arange(len(split)), size), len(split), len(self.model.langs)
        flat = [w for words in split for w in words]
        rows = np.fromiter(map(self.model.word_row.get, flat, repeat(-1)), np.int64, len(flat))
        known, other = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        rows[other] = np.fromiter((self.row[flat[k]] for k in other.tolist()), np.int64, len(other))
        total = self.model.words.sums(rows[known], into[known], many, langs) + self.unseen.sums(rows[other], into[other], many, langs)
        best = total.argmax(axis=1)  # of equal ones the first in alphabetical order
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [self.model.langs[k] if n else "und" for k, n in zip(best.tolist(), size)]
        return langs, [s if n else 0.0 for s, n in zip(score.tolist(), size)]


def quota(counts: list[int], most: int) -> float:
    """So many rows of each language that about ``most`` are taken: equal parts, and what languages with fewer rows leave goes to the others."""
    room = most
    for k, n in enumerate(sorted(counts)):
        part = room / (len(counts) - k)
        if n > part:
            return part
        room -= n
    return max(counts, default=0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 10_000, max_words: int = 20_000, max_grams: int = 20_000) -> Model:
    """Fit on rows with a language that are not held out: about ``max_train`` of them, picked by a hash of id and text.

    Null and empty texts teach nothing; rows with a null or repeated id are rows like
    others; rows that repeat id and text teach once. Without such rows, or from an empty table, the model knows no language.
    Other columns are not read. Every language is learned, from an equal part of them, or from all its rows if it
    has fewer. Of more languages than ``max_train`` each still gives a row.
    """
    pick = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(PICKS))
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(pick.alias("pick"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # a row per language
    by_lang = known.groupBy("lang").agg(F.approx_count_distinct("pick", 0.02).alias("n"), F.min("pick").alias("least")).collect()
    langs = sorted(r.lang for r in by_lang)
    if not langs:
        return Model([], [], [])
    each = quota([r.n for r in by_lang], max_train)
    below = [(r.lang, max(r.least + 1, PICKS if each >= r.n else int(each / r.n * PICKS))) for r in by_lang]
    rates = docs.sparkSession.createDataFrame(below, "lang string, below bigint")
    # rows that repeat id and text have one pick and come in once
    sample = known.join(F.broadcast(rates), "lang").where("pick < below").groupBy("lang", "pick").agg(F.min("text").alias("text"))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+", -1)).alias("word")).where("word <> ''")
    words = cut(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    framed = F.concat(F.lit("^"), "word", F.lit("$"))
    sizes = F.expr(f"sequence(1, least({LONGEST}, char_length(word) + 2))")
    all_grams = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.char_length(framed) - k + 1), lambda i: F.substring(framed, i, k))))
    grams = words.select("lang", "n", F.explode(all_grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = cut(grams)
    # bounded by the parameters times the languages
    best_words = [tuple(r) for r in _most_frequent(words, "word", max_words).collect()]
    best_grams = [tuple(r) for r in _most_frequent(grams, "gram", max_grams).collect()]
    return Model(langs, best_words, best_grams)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of the predicted language).

    A null text, one without letters, and any text where no language was learned
    get ``und`` with score 0. Texts count whole at any length. Null and repeated
    ids stay as they are. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("language",))
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                langs, scores = scorer.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        del scorer
        free_memory()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_share: float = 4 / 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language cannot be told (``und``, or a score under ``min_share`` times the score of a mere guess, which is one part of as many as there are languages; of one language no score is under it).

    All columns stay as they are, whatever their names. Null texts and texts without
    letters go; repeated rows are judged alike; an empty table gives no rows.
    """
    model = train(docs, id_col, text_col, lang_col)
    min_score = min(1.0, min_share / max(1, len(model.langs)))
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("language",))
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                langs, scores = scorer.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != "und" and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))
        del scorer
        free_memory()

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))
