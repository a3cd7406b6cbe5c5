"""Session setup and the shared folder that small settled tables go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for local runs. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tallyforge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a scratch folder of its own; a
    cluster without it is an error, because a machine-local folder would not
    survive the loss of that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="tallyforge-")
    return _LOCAL_FALLBACK[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's own part of the shared folder.

    Everything an application settles is under one folder named after it, so
    what a finished one left can be removed as a whole.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tallyforge-{app}/{name}-{uuid.uuid4().hex}"


#: Folders that a task has open at once; rows of any further ones are sorted and written after them.
OPEN_FOLDERS = 64
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def session_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_folders(df: DataFrame, path: str, by: tuple[str, ...], mode: str = "errorifexists") -> None:
    """Write ``df`` in folders by the columns ``by``, each task what it reads, with a file open per folder.

    For few folders of many rows, such as dates: nothing is exchanged, and no task sorts its rows or gets a whole folder.
    """
    with session_conf(df.sparkSession, _WRITERS, str(OPEN_FOLDERS)):
        df.write.mode(mode).partitionBy(*by).parquet(path)


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt by the column ``by`` to as many tasks as there are cores, or as read it if those are more.

    For rows that take long in a table of few row groups, which as few tasks would work on otherwise.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), by)


def settle(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the columns ``by``, and read it back.

    The table that comes back has a known file size, so Catalyst broadcasts it
    while it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it
    beyond; its lineage is cut without depending on any executor's memory.
    """
    path = scratch_path(df.sparkSession, name)
    write_folders(df, path, by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
