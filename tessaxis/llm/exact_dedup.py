"""Exact deduplication with a split for heavy hitters; DataFrame functions only.

A Misra-Gries summary (approx_top_k, merged over all partitions) names digests that may be frequent. Their exact counts
and first rows are then verified in one pass, and the verified ones, at most `tracked` rows, are broadcast: rows with
such a digest are decided where they lie. All other rows are dealt out by digest as usual; the summary bounds how many
of them can share one.

Texts are equal when identical after replacing each run of ASCII white space (0x09-0x0D, 0x20) by one space; null counts
as empty. Of equal texts the row with the smallest doc_id stays (null ids last); of rows that share this too, one of
them. Columns of the input named like an output column are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaxis.llm.common import written

TRACKED = 1024


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; single spaces need no replacing."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: str) -> Column:
    return F.sha2(normalised(text), 256)


def heavy_digests(digests: DataFrame, column: str, tracked: int = TRACKED) -> DataFrame:
    """The digests that the summary names: at most `tracked`, among them each that over 4/tracked of the rows have."""
    named = digests.agg(F.expr(f"approx_top_k({column}, {tracked // 2}, {tracked})").alias("named"))
    return named.select(F.explode("named.item").alias(column))


def label_copies(df: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, text_sha256."""
    rows = written(df.select(F.col(key).alias(key), digest(text).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    rank = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_row").alias("r"))
    named = F.broadcast(heavy_digests(rows, "text_sha256", tracked))
    winners = written(rows.join(named, "text_sha256").groupBy("text_sha256").agg(F.min(rank).alias("_first"), F.count("*").alias("group_size")))
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    group = Window.partitionBy("text_sha256")
    rest = marked.where(F.col("group_size").isNull()).withColumns({"_first": F.min(rank).over(group), "group_size": F.count("*").over(group)})
    return (
        marked.where(F.col("group_size").isNotNull())
        .unionByName(rest)
        .select(key, F.col("_first.k").alias("keep_id"), "group_size", (F.col("_first.r") == F.col("_row")).alias("kept"), "text_sha256")
    )


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows of df that stay, with all their columns."""
    digests = written(df.select(F.col(key).alias("_key"), digest(text).alias("_digest")))
    rank = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"))
    named = F.broadcast(heavy_digests(digests, "_digest", tracked))
    winners = written(digests.join(named, "_digest").groupBy("_digest").agg(F.min(rank).alias("_first")))
    rows = df.select(F.struct(*df.columns).alias("_doc"), F.col(key).alias("_key"), digest(text).alias("_digest"))
    marked = rows.join(F.broadcast(winners), "_digest", "left")
    may_stay = marked.where(F.col("_first").isNull() | F.col("_first.k").eqNullSafe(F.col("_key")))
    order = Window.partitionBy("_digest").orderBy(F.col("_key").asc_nulls_last())
    return may_stay.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("_doc.*")
