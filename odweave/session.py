"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes (written out as text) of a stored side of a join that is sent whole to the tasks of the other side.
_SENT_BYTES = 32 << 20
#: Shuffle files go when the action that wrote them ends; what is run again writes them again.
_FREED_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "odweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; every value can be overridden by the caller or spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by the cluster. Only a local master may do without: it gets one of its own."""
    named = spark.conf.get(_CHECKPOINT_KEY, None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="odweave-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df: DataFrame) -> DataFrame:
    """Compute a table once: write it to the shared folder and go on from there.

    Later passes read only the columns they need, its row count comes from the file footers, and a lost executor
    costs a re-read instead of the lineage. The files live under the application's id until ``drop_stored``.
    """
    path = scratch_path(df.sparkSession, f"stored/{uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs in here deletes its shuffle files as soon as its result is there, not when the driver collects its garbage."""
    before = spark.conf.get(_FREED_KEY, None)
    spark.conf.set(_FREED_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED_KEY)
        else:
            spark.conf.set(_FREED_KEY, before)


def materialize_in_parts(df: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    """``materialize`` in steps, each for the rows of one part of the keys ``by``: only one step's shuffle files are there at a time.

    Every row is in one part, also one with a missing key; ``df`` must have the same rows whenever it is computed. If it is grouped
    or joined by the keys, Spark picks a step's rows where the sources are read. So the sources are read in every step, but each
    row is shuffled in one.
    """
    part = F.pmod(F.xxhash64(*by), F.lit(parts))
    return materialize_each(df.filter(part == i) for i in range(parts))


def materialize_each(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of one table or more with the same columns, stored one after another: the shuffle files of each go before the next begins."""
    path = None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or scratch_path(spark, f"stored/{uuid4().hex}")
        with shuffles_freed(spark):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for one application's intermediate table; a rerun in the same application overwrites it."""
    return f"{shared_dir(spark)}/odweave/{spark.sparkContext.applicationId}/{name}"


def drop_stored(spark: SparkSession) -> None:
    """Delete what ``materialize`` has stored for this application; results that were not written yet are lost with it."""
    fs, path = pafs.FileSystem.from_uri(scratch_path(spark, "stored"))
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def fits_broadcast(df: DataFrame) -> bool:
    """Is the table's estimated size under the session's broadcast threshold?"""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= threshold


def whole_if_small(side: DataFrame) -> DataFrame:
    """A stored side of a join: sent whole if it was measured to be small, then the other side is not shuffled to meet it."""
    size = side.agg(F.sum(F.octet_length(F.struct("*").cast("string")))).first()[0] or 0
    return F.broadcast(side) if size <= _SENT_BYTES else side
