"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Equal texts are combined three times: within each task (the partial aggregate),
within each salt of a digest, and over the salts. Every one of these aggregates
is keyed by the text itself next to its digest, so rows meet only if their full
contents are equal; the digest decides where they meet. Only digests that hold
a sizeable share of all rows are salted, and their number is bounded by that
share, so all other texts cross the network once.

Defined cases: a null text counts as empty; a null id is smaller than any id;
rows that repeat both id and text are all marked as kept by ``exact_groups`` and
become one row in ``distinct_rows``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import col
from tallyforge.session import settle

HOT_SHARE = 0.001
SALTS = 32


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def hot_digests(digests: DataFrame, share: float = HOT_SHARE, least: int = 1000) -> list[str]:
    """Digests with at least ``share`` of all rows: at most 1/share of them, whatever the table's size."""
    floor = max(least, int(digests.count() * share))
    return [r[0] for r in digests.groupBy("digest").count().filter(F.col("count") >= floor).select("digest").collect()]


def _combined(keyed: DataFrame, hot: list[str], salts: int, local: list[Column], merged: list[Column]) -> DataFrame:
    """One row per distinct text: task, then salt, then global aggregate, each over the full content."""
    salt = F.when(F.col("digest").isin(hot), F.pmod(F.xxhash64("row_id"), F.lit(salts))) if hot else F.lit(None)
    # the salt is null for all but the hot digests
    by_salt = (keyed.withColumn("salt", salt.cast("long"))
               .groupBy("digest", "salt", "text").agg(*local).drop("salt"))
    if not hot:
        return by_salt
    is_hot = F.col("digest").isin(hot)
    # winners of the salts: at most salts rows per hot text
    return by_salt.filter(~is_hot).unionByName(by_salt.filter(is_hot).groupBy("digest", "text").agg(*merged))


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(col(id_col).alias("row_id"), text.alias("text"), digest(text).alias("digest"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256_hex, share: float = HOT_SHARE, salts: int = SALTS,
                 least: int = 1000) -> DataFrame:
    """Per input row: row_id, keep_id, group_size, kept, digest.

    ``keep_id`` is the largest id among the rows with the same text. A digest
    that several different texts share is resolved by comparing texts.
    """
    keyed = _keyed(docs, id_col, text_col, digest)
    rows = keyed.select("row_id", "digest")
    hot = hot_digests(rows, share, least)
    combined = _combined(
        keyed, hot, salts,
        [F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")],
        [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")])
    # texts leave the plan here; what is written grows with the number of texts, not with their length
    classes = settle(combined.select("digest", "keep_id", "group_size", F.xxhash64("text").alias("variant"),
                                     F.length("text").alias("n_chars")), "exact-classes")
    shared = (classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                                            F.max("group_size").alias("group_size")))
    repeated = shared.filter("texts = 1 and group_size > 1").select("digest", "keep_id", "group_size")
    mixed = shared.filter("texts > 1").select("digest")

    found = _attached(rows, repeated, hot)
    if not mixed.isEmpty():
        # several texts under one digest: only these rows compare their contents again
        exact = _combined(
            keyed.join(mixed, "digest", "left_semi"), hot, salts,
            [F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")],
            [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")])
        by_text = (keyed.join(mixed, "digest", "left_semi").join(exact, ["digest", "text"])
                   .select("row_id", "digest", "keep_id", "group_size"))
        found = found.join(mixed, "digest", "left_anti").select(by_text.columns).unionByName(by_text)
    return found.select("row_id", "keep_id", "group_size", F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "digest")


def _attached(rows: DataFrame, repeated: DataFrame, hot: list[str]) -> DataFrame:
    """Group columns for every row; hot digests, a bounded number, are broadcast so that none is dealt to one task."""
    single = [F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("row_id"))).alias("keep_id"),
              F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")]
    shape = ["row_id", "digest", *single]
    if not hot:
        return rows.join(repeated, "digest", "left").select(*shape)
    is_hot = F.col("digest").isin(hot)
    usual = rows.filter(~is_hot).join(repeated.filter(~is_hot), "digest", "left").select(*shape)
    return usual.unionByName(
        rows.filter(is_hot).join(F.broadcast(repeated.filter(is_hot)), "digest", "left").select(*shape))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  digest: Callable[[Column], Column] = sha256_hex, share: float = HOT_SHARE, salts: int = SALTS,
                  least: int = 1000) -> DataFrame:
    """One whole row per distinct text, the one with the largest id, in the input's columns.

    The row travels as the aggregate's payload, so no join brings it back; of
    rows with equal ids the one with the larger other columns stays.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(col(text_col), F.lit(""))
    row = F.struct(col(id_col).alias("row_id"), col(text_col).isNotNull().alias("has_text"),
                   *[col(c).alias(f"c{i}") for i, c in enumerate(others)])
    keyed = docs.select(text.alias("text"), digest(text).alias("digest"), row.alias("row"), col(id_col).alias("row_id"))
    hot = hot_digests(keyed.select("digest"), share, least)
    best = [F.max("row").alias("row")]
    kept = _combined(keyed, hot, salts, best, best)
    names = {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    names[id_col] = F.col("row.row_id")
    names[text_col] = F.when(F.col("row.has_text"), F.col("text"))
    return kept.select([names[c].alias(c) for c in docs.columns])
