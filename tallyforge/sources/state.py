"""State kept between runs: keyed tables in buckets, and the result tables of single runs.

A state table holds one row per key, once. It is bucketed by the key and
partitioned by a natural date of its rows. A save writes the changed rows as
a table with the same buckets, joins the two bucket by bucket without an
exchange, and Spark's dynamic partition overwrite replaces the partitions that
the changes touch; the others are neither read nor listed. Saving the same rows
again, as a replayed micro-batch does, changes nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import session_conf

_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
_OWN = T.StructType([T.StructField("state_key", T.StringType()), T.StructField("removed", T.BooleanType()),
                     T.StructField("part", T.StringType())])


@dataclass(frozen=True)
class StateTable:
    """A keyed state below ``path``.

    ``part`` is SQL over the columns for the partition a row belongs to; rows of
    one key must always be in the same. ``buckets`` is fixed when the table is
    first written, by the rows of its largest partition.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    part: str
    buckets: int = 4


def _declared(spark: SparkSession, path: str, columns: T.StructType, partitioned: str, buckets: int) -> str:
    """The bucketed table over ``path``, known to this session under a name derived from it."""
    name = f"state_{hashlib.sha256(path.encode()).hexdigest()[:20]}"
    if not spark.catalog.tableExists(name):
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet {partitioned} "
                  f"CLUSTERED BY (state_key) SORTED BY (state_key) INTO {buckets} BUCKETS LOCATION '{path}'")
        if partitioned:
            spark.createDataFrame([], columns).write.mode("append").partitionBy("part").parquet(path)   # the folder exists
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.catalog.refreshTable(name)
    return name


def _full(state: StateTable) -> T.StructType:
    return T.StructType([*state.schema.fields, *_OWN.fields])


def _rows(spark: SparkSession, state: StateTable) -> str:
    return _declared(spark, f"{state.path}/rows", _full(state), "PARTITIONED BY (part)", state.buckets)


def _changes(spark: SparkSession, state: StateTable) -> str:
    return _declared(spark, f"{state.path}/changes", _full(state), "", state.buckets)


def _keyed(df: DataFrame, state: StateTable, removed: Column) -> DataFrame:
    """Rows in the table's columns; the key as text, so that null parts of a key are equal to each other."""
    key = F.to_json(F.struct(*state.keys), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return df.select(*state.schema.names, key.alias("state_key"), removed.alias("removed"),
                     F.coalesce(F.expr(state.part).cast("string"), F.lit("none")).alias("part"))


def save_state(df: DataFrame, state: StateTable, removed: Column | None = None) -> None:
    """Bring the rows of ``df``, one per key, into the table; those where ``removed`` holds leave it."""
    spark = df.sparkSession
    changes = _changes(spark, state)
    keyed = _keyed(df, state, F.lit(False) if removed is None else F.coalesce(removed, F.lit(False)))
    keyed.repartition(state.buckets, "state_key").write.mode("overwrite").insertInto(changes)
    spark.catalog.refreshTable(changes)
    touched = [r["part"] for r in spark.table(changes).select("part").distinct().collect()]   # dates, not rows
    if touched:
        with session_conf(spark, _OVERWRITE, "dynamic"):
            updated(spark, state, touched).write.mode("overwrite").insertInto(_rows(spark, state))


def updated(spark: SparkSession, state: StateTable, parts: list[str]) -> DataFrame:
    """The partitions ``parts`` with the last changes in: both sides lie in the same buckets, so nothing is exchanged.

    A removal is kept as a mark until its partition is written again.
    """
    before = spark.table(_rows(spark, state)).where(F.col("part").isin(parts) & ~F.col("removed"))
    after = spark.table(_changes(spark, state))
    columns = before.columns
    pack = lambda df, name: df.select("state_key", F.struct(*columns).alias(name))
    both = pack(before, "_before").join(pack(after, "_after"), "state_key", "full_outer")
    return both.select(F.coalesce("_after", "_before").alias("_row")).select("_row.*")


def load_state(spark: SparkSession, state: StateTable, defaults: dict[str, object] | None = None,
               parts: list[str] | None = None) -> DataFrame:
    """The state's rows, of the partitions ``parts`` if given, with defaults for missing values; empty when nothing was saved yet."""
    rows = spark.table(_rows(spark, state)).where(~F.col("removed"))
    if parts is not None:
        rows = rows.where(F.col("part").isin(parts))
    rows = rows.select(*state.schema.names)
    return rows.fillna(defaults) if defaults else rows


# --- result tables of runs ----------------------------------------------------------

def save_run(df: DataFrame, path: str, run: int) -> DataFrame:
    """The rows of one run in a folder of their own, and read back; saving a run again replaces it."""
    place = f"{path}/version={run}"
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def read_run(spark: SparkSession, path: str, run: int, schema: T.StructType) -> DataFrame:
    """The rows of one run; other runs' folders are not listed."""
    return spark.read.schema(schema).parquet(f"{path}/version={run}")


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all runs below ``path`` with their ``version``; empty when there was none."""
    full = T.StructType(schema.fields + [T.StructField("version", T.LongType())])
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


# --- documents ------------------------------------------------------------------------

def upgrade_budget_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Old and new budget documents in one shape, each parsed once.

    Oldest documents are the bare map of interval -> cost; ``messages`` was
    added before ``budget``. Adds ``amounts``, ``messages`` and ``budget``
    (NULL where the document has none). What is no document has none of the three.
    """
    part = lambda path, kind: F.try_variant_get("_doc", path, kind)
    is_new = part("$.messages", "variant").isNotNull()
    amounts, texts = "map<string,double>", "map<string,string>"
    # a generator is not repeated where its column is used, so a filter on what comes out parses nothing again
    parsed = docs.select(*docs.columns, F.inline_outer(F.array(F.struct(F.try_parse_json(doc).alias("_doc")))))
    return parsed.select(
        *[c for c in docs.columns if c != doc],
        F.when(is_new, part("$.amounts", amounts)).otherwise(part("$", amounts)).alias("amounts"),
        F.when(is_new, part("$.messages", texts)).when(F.col("_doc").isNotNull(), F.create_map().cast(texts)).alias("messages"),
        F.when(is_new, part("$.budget", "double")).alias("budget"),
    )


def budget_amounts(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Budget documents as rows (project_id, budget, interval_start, cost)."""
    return upgrade_budget_documents(docs, doc).select(
        "project_id", "budget", F.explode("amounts").alias("interval_start", "cost"))
