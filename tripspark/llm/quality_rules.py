"""Quality rules: counts of each text, and how much of it is the boilerplate of its host.

A line that more than ``max(min_docs, min_share of the host's documents)``
documents of one host carry is boilerplate there. Documents whose boilerplate
leaves too few words are depleted and rejected. Only hashes of lines are
shuffled, summed before the exchange, so a host with a third of all rows is no
single task; the lines above a limit are few and joined adaptively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import ascii_lower, cut, documents
from tripspark.llm.line_dedup import key_of, lines_of

BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (a column ``text`` without nulls) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Eight-word windows are compared by 64-bit hash within a text. Only texts
    with a repeated window pay for the sort that finds its places.
    """
    out = docs.withColumn("words", words_of(F.col("text")))
    worded = F.filter(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = out.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint"),
        "worded": worded,
        "hw": F.transform("words", lambda w: F.xxhash64(w)),
    })
    window = ", ".join(f"get(hw, i + {k})" for k in range(1, 8))
    out = out.drop("words").withColumns({
        "n_dup_lines": (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint"),
        "windows": F.expr(f"CASE WHEN n_words < 8 THEN array() ELSE transform(slice(hw, 1, size(hw) - 7), (h, i) -> xxhash64(h, {window})) END"),
    })
    out = out.drop("worded", "hw").withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    out = out.withColumn("byhash", F.expr("CASE WHEN again THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END")).drop("windows")
    out = out.withColumn("at", F.expr("sort_array(transform(filter(byhash, (x, k) -> coalesce(x.h = get(byhash, k - 1).h, false) OR coalesce(x.h = get(byhash, k + 1).h, false)), x -> x.i))"))
    covered = F.expr("aggregate(transform(at, (p, k) -> least(8, coalesce(get(at, k + 1), p + 8) - p)), 0, (a, x) -> a + x)")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("byhash", "at", "again")


def host_lines(text: Column) -> Column:
    """Of each line with a word, in order: the hash of its key and its words."""
    keys = F.filter(F.transform(lines_of(ascii_lower(text)), key_of), lambda k: k != "")
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h"), F.size(F.split(k, BLANKS, -1)).alias("w")))


def frequent_host_lines(rows: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(on, h): the lines above their host's limit, for rows of host, document and lines.

    The pairs of a line and a document are made distinct first, spread by both; then a
    line's documents are summed before the exchange, however many they are.
    """
    lines = rows.select("host", "document", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count_distinct("document").alias("n")).where(F.col("n") > min_docs)
    hosts = rows.groupBy(F.col("host").alias("of")).agg((F.count_distinct("document") * F.lit(min_share)).alias("limit"))
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("limit"))
    return cut(above.select(F.col("host").alias("on"), "h"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30,
    min_docs: int = 20, min_share: float = 0.01, min_left: float = 0.5, keep_text: bool = False,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_boilerplate_words and (if keep_text) kept_text.

    Words are runs of non-blank characters (ASCII blanks). base_failed: fewer than
    ``min_words`` words, or over ``max_repeat_percent`` % of them in repeated
    eight-word windows. kept: not base_failed, and without the lines above the
    host's limit at least ``min_words`` words and ``min_left`` of all words are
    left. kept_text: the text without those lines. Lines are equal if they are without
    blanks at their ends and with A-Z lower-cased; they are told apart by a 64-bit hash.

    A null text has no words and fails. A null host is a host of its own. A host's
    documents are told apart by id: rows that repeat one are one document, each row
    with a null id is one of its own. Every row keeps its own counts, and its lost
    words are those of its own lines. An empty table gives no rows. Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(host_col).alias("host"))
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "lines": host_lines(F.col("text"))})
    counted = text_counts(rows)
    # each text is read once; numbers and hashes of lines go on, and the rows' numbers are settled
    counted = cut(counted if keep_text else counted.drop("text"))
    slim = counted.select("row", "host", "lines", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))).alias("document"))
    frequent = frequent_host_lines(slim, min_docs, min_share)
    each = slim.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    hit = each.host.eqNullSafe(frequent["on"]) & (each.h == frequent.h)
    lost = each.join(frequent, hit, "left_semi").groupBy(F.col("row").alias("of_row")).agg(F.sum("w").alias("lost"), *([F.collect_set("h").alias("gone")] if keep_text else []))
    out = counted.join(lost, F.col("row") == F.col("of_row"), "left")
    lost_words = F.coalesce("lost", F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - lost_words
    stays = F.filter(lines_of(F.col("text")), lambda x: ~F.array_contains("gone", F.xxhash64(key_of(ascii_lower(x)))))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
        lost_words.alias("n_boilerplate_words"),
        *([F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept_text")] if keep_text else []),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, text FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, source, i, l, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
       FROM (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS l FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i))),
wl AS (SELECT *, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ln WHERE t <> ''),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n FROM wl GROUP BY doc_id),
hosts AS (SELECT source, count(*) * 0.01 AS lim FROM d GROUP BY source),
freq AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM wl GROUP BY source, k) JOIN hosts USING (source) WHERE n > 20 AND n > lim),
lost AS (SELECT doc_id, sum(len(regexp_split_to_array(k, '[\x20\x09-\x0D]+')))::BIGINT AS n FROM wl JOIN freq USING (source, k) GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_boilerplate_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_boilerplate_words >= 20 AND n_words - n_boilerplate_words >= 0.5 * n_words AS kept
FROM r
"""
