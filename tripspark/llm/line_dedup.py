"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n, seen): the 128-bit hash of a line's key and the
number of a batch's documents that carry it, in buckets of the hash, sorted in each.
Each batch of documents is merge-anti-joined with the runs: what no run holds is new
and makes the batch's own run (``seen`` false); what one holds adds to its count
(``seen`` true). So a line is new in one run only. When a level holds ``fanout`` runs they
are merged into one run of the next level, so that a hash is rewritten once per
level and never more. All runs share one bucketing, so matching, merging and
counting them shuffles nothing but the new batch. Runs hold some 25 bytes a distinct
line, no text.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm.common import WS, ascii_lower, checkpoint_folder, cut, documents

HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """Expects a line with A-Z lower-cased."""
    return F.btrim(line, F.lit(WS))


def keys_of(text: Column, min_chars: int) -> Column:
    """Distinct keys of a text's lines, short ones left out."""
    keys = F.transform(lines_of(ascii_lower(F.coalesce(text, F.lit("")))), key_of)
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))


def hashes(key: str = "key") -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(11), F.col(key)).alias("h2")]


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2) of the distinct lines of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(keys_of(F.col(text_col), min_chars)).alias("key"))
    return rows.select("doc_id", *hashes())


class LineRuns:
    """The levelled runs of one corpus: bucketed tables in the cluster's shared folder, dropped by ``close``.

    Batches may be empty; null texts have no lines. Rows that repeat an id are
    documents of their own.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 1):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{checkpoint_folder(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.written}"
        self.written += 1
        run.select(*HASH, "n", "seen").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            # a line that is new in one of these runs is new in the merged one
            self._write(self._merged(merged), level + 1)
            for old in merged:
                self._drop(old)

    def _union(self, names: list[str]) -> DataFrame:
        """The runs bucket by bucket. Spark 4.1 keeps the buckets of a union together only if rows, not columns, come in: hence the filter, which all rows pass."""
        return reduce(DataFrame.unionByName, (self.spark.table(name).where("n > 0") for name in names))

    def _merged(self, names: list[str]) -> DataFrame:
        return self._union(names).groupBy(*HASH).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(f"{self.folder}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def keys(self) -> DataFrame | None:
        """(h1, h2) of every line that a run holds, each once; None without runs."""
        return self._union(self.names()).where("NOT seen").select(*HASH) if self.names() else None

    def all(self) -> DataFrame:
        """(h1, h2, n) over all runs; no rows if there are no runs."""
        return self._merged(self.names()).drop("seen") if self.names() else self.spark.createDataFrame([], "h1 bigint, h2 bigint, n bigint")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add the batch's lines, counted once a document, as a run."""
        self.add_lines(line_hashes(batch, self.min_chars, id_col, text_col))

    def add_lines(self, lines: DataFrame) -> None:
        """The merge-anti-join: lines that no run holds are the new run, the others add to the count of theirs."""
        counts = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"))
        held = self.keys()
        if held is None:
            return self._write(counts.withColumn("seen", F.lit(False)), 0)
        # both answers of the anti-join at once: the partner is there or not
        matched = counts.join(held.withColumn("held", F.lit(True)).hint("merge"), HASH, "left")
        self._write(matched.withColumn("seen", F.col("held").isNotNull()), 0)

    def unseen(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, h1, h2) of the batch's lines that no run holds, for incremental loads."""
        lines, held = line_hashes(batch, self.min_chars, id_col, text_col), self.keys()
        return lines if held is None else lines.join(held.hint("merge"), HASH, "left_anti")

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2) of the lines found in at least min_docs documents, cut off from the runs."""
        return cut(self.all().where(F.col("n") >= min_docs).select(*HASH))

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self._delete(self.folder)


def remove_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: every line whose key is in ``frequent`` (h1, h2) is gone.

    A null or empty text is one empty line; rows with a null or repeated id lose the
    lines of all rows of that id that are in ``frequent``, which are the same. An empty
    table gives no rows. Other columns are not read.
    The join with ``frequent`` and the way back to the documents are left to
    adaptive execution: it broadcasts what it has measured to be small, else
    merges and splits skewed partitions (a line may be in a third of the rows).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = line_hashes(docs, min_chars, id_col, text_col)
    hits = lines.join(frequent, HASH, "left_semi").groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set("h1").alias("gone"))
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select("doc_id", "text", "gone", lines_of(F.col("text")).alias("lines"))

    def stays(line: Column) -> Column:
        key = key_of(ascii_lower(line))
        return ~(F.array_contains("gone", F.xxhash64(key)) & (F.char_length(key) >= min_chars))

    kept = joined.select("*", F.when(F.col("gone").isNotNull(), F.filter("lines", stays)).alias("kept_lines"))
    n = F.size("lines").cast("bigint")
    return kept.select(
        "doc_id",
        n.alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n - F.size("kept_lines")).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("kept_lines", "\n")).alias("kept_text"),
    )


def line_dedup(docs: DataFrame | list[DataFrame], min_docs: int = 10, min_chars: int = 1, fanout: int = 3, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of all rows.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` characters in at least
    ``min_docs`` documents lose all their lines; a line counts once a document.
    ``docs``: the batches in the order they came in, or one table, whose lines are
    dealt into so many ``batches`` by a hash of the id, however many files it has.
    A null or empty text is one empty line and stays so. Every row is a document
    of its own, also if its id is null or repeated. No batches are an error; empty
    ones give no rows. Other columns are not read.
    """
    parts = docs if isinstance(docs, list) else [docs]
    runs = LineRuns(parts[0].sparkSession, fanout, min_chars)
    try:
        if isinstance(docs, list):
            for part in parts:
                runs.add(part, id_col, text_col)
        else:
            dealt = f"{runs.folder}/lines"
            lines = line_hashes(docs, min_chars, id_col, text_col)
            lines.select(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(batches)).cast("int").alias("batch"), *HASH).write.partitionBy("batch").parquet(dealt)
            read = docs.sparkSession.read.schema("h1 bigint, h2 bigint, batch int").parquet(dealt)
            for k in range(batches):
                runs.add_lines(read.where(F.col("batch") == k).select(*HASH))
        frequent = runs.frequent(min_docs)
    finally:
        runs.close()
    return remove_lines(reduce(DataFrame.unionByName, parts), frequent, min_chars, id_col, text_col)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
gone AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone g USING (k) GROUP BY doc_id
"""
