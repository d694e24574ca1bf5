"""Exact dedup: frequent digests are split off by a Misra-Gries summary.

One text in a third of all rows would send a third of all rows to one task of a
plain ``groupBy(digest)``. So a summary of bounded size (``approx_top_k``, the
mergeable form of Misra-Gries) names every digest that can be frequent, an exact
count verifies those, and the winners, at most ``tracked // 2`` rows of about
100 bytes, are broadcast: their rows are settled where they are, without a
shuffle. The rest is shuffled by digest as usual; its groups are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.common import ascii_lower, cut, documents, free_name


def digest_of(text: Column) -> Column:
    """SHA-256 of the text, A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def frequent_digests(rows: DataFrame, tracked: int, hot_min: int) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that occur at least hot_min times and that the summary names.

    The summary misses no digest in more than about ``4 / tracked`` of the rows.
    """
    named = rows.agg(F.expr(f"approx_top_k(digest, {tracked // 2}, {tracked})").alias("top")).select(F.explode("top.item").alias("digest"))
    named = cut(named)  # at most tracked // 2 rows
    exact = rows.join(F.broadcast(named), "digest", "left_semi").groupBy("digest")
    return exact.agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= hot_min)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 8192, hot_min: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; the row with the largest
    id of each group stays. A null text equals the empty one. Null ids are
    smaller than all others. Rows that repeat id and text stay or go together.
    An empty table gives no rows. Other columns are not read.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")))
    winners = cut(frequent_digests(rows, tracked, hot_min))
    tagged = rows.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    cold = tagged.where(F.col("group_size").isNull()).select("id", "digest", F.max("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    both = tagged.where(F.col("group_size").isNotNull()).select("id", "digest", "keep_id", "group_size").unionByName(cold)
    return both.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay as they are, whatever their names.

    Null texts and ids, ties and repeated rows as in exact_dedup: of rows that repeat
    both id and text all stay if one does. An empty table gives no rows.
    """
    gone_id, digest = free_name(docs, "gone_id"), free_name(docs, "gone_digest")
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(digest))
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (digest_of(F.col(text_col)) == F.col(digest))
    return docs.join(gone, same, "left_anti")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, d AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS d FROM documents)
WINDOW g AS (PARTITION BY d)
"""
