"""Spelling variants: words at one inserted, deleted or replaced code point, by pairs of trie nodes.

Words in order form a trie: a node is a prefix, numbered where it first comes
up. Reversed words give the nodes of suffixes. A word then is a row of pairs:
(node of the prefix before a position, node of the suffix after it) for each
position skipped, and (prefix, suffix) for each place between positions. Two
words that skip to the same pair differ by a replacement; a word that skips to
another's unskipped pair has one code point more. Pairs are integers, equal
exactly if the strings are, so there is nothing to verify.

A pair is met by at most one word unskipped, and by one word for each code point
that may be skipped. What a word needs of its group is a count and the best
other word, so no pairs of words are written out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import ascii_lower, cut, documents

RUN = "[a-zÀ-ÿ]+"
LOCAL = 40  # bits of a node's number within its part of the words


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: runs of Latin letters of whole texts, A-Z lower-cased, that have at least min_chars code points and come up min_count times.

    Of the runs whose crc32 of ``<id>:<run>`` is divisible by ``every`` one code point
    (crc32 modulo length) is left out. Null texts have no words; a null id is the
    empty string. Counts are summed before the shuffle, so a frequent word is no heavy key.
    """
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_chars).withColumn("h", F.crc32(F.concat("key", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


class TrieNumbers:
    """Numbers of the trie's nodes for words that come in order, a part of all words at a time.

    ``firsts`` are the first words of all parts. A prefix that words of several parts
    share is a prefix of one of them, so those are numbered beforehand, in the same way
    everywhere; all others belong to one part.
    """

    def __init__(self, firsts: list[str]) -> None:
        self.firsts, self.paths, number = firsts, [], len(firsts) << LOCAL
        before, path = "", [number]
        for word in firsts:
            same = common_prefix(before, word)
            path = path[: same + 1] + list(range(number + 1, number + 1 + len(word) - same))
            number += len(word) - same
            before = word
            self.paths.append(path)
        self.before, self.path, self.next = None, None, None

    def nodes(self, word: str) -> list[int]:
        """The nodes of all prefixes of the word, the empty one first."""
        if self.before is None:
            part = bisect_right(self.firsts, word) - 1
            self.before, self.path, self.next, self.ahead = self.firsts[part], self.paths[part], part << LOCAL, part + 1
        same, path = common_prefix(self.before, word), self.path
        if self.ahead < len(self.firsts):
            shared = common_prefix(self.firsts[self.ahead], word)
            if shared > same:
                same, path = shared, self.paths[self.ahead]
        new = len(word) - same
        self.path = path[: same + 1] + list(range(self.next, self.next + new))
        self.before, self.next = word, self.next + new
        return self.path


def numbered(words: DataFrame) -> DataFrame:
    """wid, nodes (of all prefixes), fresh (per code point: it differs from the one before) for the column ``word``, which lies in order, part by part."""
    firsts = sorted(r.first for r in words.groupBy(F.spark_partition_id().alias("part")).agg(F.min("word").alias("first")).collect())  # a word per partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TrieNumbers(firsts)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column("word").to_pylist()
                nodes = [numbers.nodes(w) for w in texts]
                fresh = [[k == 0 or w[k - 1] != c for k, c in enumerate(w)] for w in texts]
                yield pa.RecordBatch.from_arrays([part.column("wid"), pa.array(nodes, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))], names=["wid", "nodes", "fresh"])

    return words.select("wid", "word").mapInArrow(run, "wid bigint, nodes array<bigint>, fresh array<boolean>")


def in_order(words: DataFrame) -> DataFrame:
    """Sorted over all partitions and written, so that the parts stay as they are."""
    return words.repartitionByRange("word").sortWithinPartitions("word")


def met_words(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """wid, near, n and back (of the best near word, 0 if there is none) from whole groups of pairs in order."""
    new = np.flatnonzero(np.concatenate([[True], (c["p"][1:] != c["p"][:-1]) | (c["s"][1:] != c["s"][:-1])]))
    size = np.diff(np.append(new, len(c["p"])))
    many = np.repeat(size > 1, size)
    c, size = {k: v[many] for k, v in c.items()}, size[size > 1]
    at, g, rows = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), np.arange(size.sum())
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["wid", "near", "n", "back"])
    skip, fresh, n, wid = c["skip"], c["fresh"], c["n"], c["wid"]
    m, m_fresh = np.add.reduceat(skip.astype(np.int64), at), np.add.reduceat(fresh.astype(np.int64), at)
    last = at + size - 1
    whole = ~skip[last]
    first_fresh = np.minimum.reduceat(np.where(fresh, rows, len(rows) - 1), at)
    # a run of equal code points gives the same shorter word from each: only its first counts
    longer = fresh & whole[g]
    near = np.where(skip, m[g] - 1 + longer, m_fresh[g])
    one = np.where(skip, at[g], first_fresh[g])
    told = np.where(skip, one != rows, m_fresh[g] > 0)
    best_n, best_wid = np.where(told, n[one], 0), np.where(told, wid[one], 0)
    other_n, other_wid = n[last][g], wid[last][g]
    better = longer & ((other_n > best_n) | ((other_n == best_n) & (other_wid < best_wid)))
    best_n, best_wid = np.where(better, other_n, best_n), np.where(better, other_wid, best_wid)
    some = near > 0
    return pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (wid, near, best_n, -best_wid)], names=["wid", "near", "n", "back"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """met_words over batches; a group that goes on waits for its end (it has a row for each code point that may be skipped)."""
    rest = None
    for batch in batches:
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
        c = c if rest is None else {k: np.concatenate([rest[k], v]) for k, v in c.items()}
        if len(c["p"]):
            begins = int(np.flatnonzero(np.concatenate([[True], (c["p"][1:] != c["p"][:-1]) | (c["s"][1:] != c["s"][:-1])]))[-1])
            rest = {k: v[begins:] for k, v in c.items()}
            if begins:
                yield met_words({k: v[:begins] for k, v in c.items()})
    if rest is not None:
        yield met_words(rest)


def near_words(words: DataFrame) -> DataFrame:
    """wid, n_near, best (n, back: minus its wid) of the words (wid, word, n) that have near ones; words lie in order.

    n_near counts the words at one inserted, deleted or replaced code point; best is the
    one of them with the largest n, of equals the one with the smallest wid (n and back are 0
    where none is as frequent as the word itself).
    """
    backward = cut(in_order(words.select("wid", F.reverse("word").alias("word"))))
    ahead, behind = numbered(words), numbered(backward).select("wid", F.col("nodes").alias("ends"))
    rows = ahead.join(behind, "wid").join(words.select("wid", "n"), "wid")
    size = "size(fresh)"
    skipped = f"transform(fresh, (x, i) -> struct(nodes[i] as p, ends[{size} - 1 - i] as s, true as skip, x as fresh))"
    whole = f"transform(nodes, (x, i) -> struct(x as p, ends[{size} - i] as s, false as skip, false as fresh))"
    pairs = rows.select("wid", "n", F.expr(f"inline(concat({skipped}, {whole}))"))
    # equal pairs side by side: first the words that skip, the most frequent first, last the one that does not
    pairs = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("skip"), F.desc("n"), "wid")
    met = pairs.mapInArrow(settle, "wid bigint, near bigint, n bigint, back bigint")
    return met.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max(F.struct("n", "back")).alias("best"))


def last_of(links: DataFrame) -> DataFrame:
    """wid, root: the end of each chain of links (wid, form). Links double in length a round; counts rise along them, so there are no circles."""
    links, moved = links.select("wid", F.col("form").alias("root")), True
    while moved:
        on = links.select(F.col("wid").alias("via"), F.col("root").alias("further"))
        links = cut(links.join(on, F.col("root") == F.col("via"), "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved")))
        moved = bool(links.agg(F.max("moved").alias("moved")).first().moved)
    return links.select("wid", "root")


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with counts (word, n).

    form: the near word with the largest n, if that is at least ``times`` (2 or more) the
    word's own; of equals the smallest in code-point order; else null. root: the end of
    the chain of forms, the word itself without one. Null words are passed over; a word
    may be of any length; an empty table gives no rows. Other columns are not read.
    """
    words = cut(words.where("word IS NOT NULL").select("word", "n"))
    words = cut(in_order(words).withColumn("wid", F.monotonically_increasing_id()))  # rises with the words
    found = near_words(words).select("wid", "n_near", "best")
    formed = F.col("best.n") >= times * F.col("n")
    stats = cut(words.select("wid", "n").join(found, "wid").select("wid", "n_near", F.when(formed, -F.col("best.back")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")))
    roots = last_of(stats.where("form IS NOT NULL")).withColumnRenamed("wid", "from")
    name = lambda wid, word: words.select(F.col("wid").alias(wid), F.col("word").alias(word))
    linked = stats.join(roots, F.col("wid") == F.col("from"), "left").join(name("_f", "form_word"), F.col("form") == F.col("_f"), "left").join(name("_r", "root_word"), F.col("root") == F.col("_r"), "left")
    linked = linked.select(F.col("wid").alias("of"), "n_near", "form_n", "form_word", "root_word")
    out = words.join(linked, F.col("wid") == F.col("of"), "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("form_n").cast("bigint").alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(documents(spark, sf_dir)))


#: crc32 by its table, worked out from the polynomial; near words by their strings.
ORACLE = r"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
dr AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 5 GROUP BY ALL),
hx AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM dr),
hs AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT) FOR j IN range(length(x) // 2)]), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM hx, tab),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hs),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
sk AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
near AS (SELECT a.word, b.word AS other, b.n FROM sk a JOIN sk b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT sk.word, v.word, v.n FROM sk JOIN v ON v.word = sk.p || sk.s UNION SELECT v.word, sk.word, sk.n FROM sk JOIN v ON v.word = sk.p || sk.s),
best AS (SELECT word, count(*) AS n_near, max(n) AS bn, first(other ORDER BY n DESC, other) AS bw FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * v.n THEN bw END AS form, CASE WHEN bn >= 2 * v.n THEN bn END AS form_n FROM v LEFT JOIN best USING (word)),
ch(word, last) AS (SELECT word, word FROM f UNION ALL SELECT ch.word, f.form FROM ch JOIN f ON f.word = ch.last WHERE f.form IS NOT NULL),
ro AS (SELECT ch.word, ch.last AS root FROM ch JOIN f ON f.word = ch.last WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ro USING (word)
"""
