"""Small shared helpers: safe column access, row counts for sizing, joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of one Arrow batch; texts are long, and a Python worker holds a batch or two.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that long texts do not add up in Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty.

    Other columns, whatever their names, can't clash with an operator's own.
    """
    short_batches(docs.sparkSession)
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def parts_for(total: int, per_part: int, least: int = 1) -> int:
    """Number of parts that keeps each at about ``per_part``, however large the total."""
    return max(least, -(-int(total) // per_part))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, to size partitions by; one scan, one row per task to the driver."""
    return docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0


#: Share of all rows from which a key is hot; at most 1/HOT_SHARE keys are, whatever the table's size.
HOT_SHARE = 0.001
#: Rows below which no key is hot.
HOT_LEAST = 1000


def hot_floor(total: int, share: float = HOT_SHARE, least: int = HOT_LEAST) -> int:
    """Rows from which a key of a table of ``total`` rows is hot."""
    return max(least, int(total * share))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], floor: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per key and how many of ``rows`` have it as ``n``.

    Keys of at least ``floor`` rows are broadcast, so that none is dealt to one
    task; there are at most ``rows / floor`` of them. The others meet by key.
    ``how`` is inner, left or left_semi. Keys hold no nulls in ``groups``; rows without a key
    count as rows without a group.
    """
    is_hot = F.col("n") >= floor
    hot, usual = groups.filter(is_hot).drop("n"), groups.filter(~is_hot).drop("n")
    marked = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(usual, keys, how)
    return marked.unionByName(rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner"))
