"""Text and columnar tables in and out."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from uuid import uuid4

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions.semantics import na_text


def read_text_table(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    n_max: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Headed (gz) CSV with every column as text, so area codes keep their leading zeros; "" and ``NA`` are missing.

    ``path`` may be a file, a folder, a glob or a list. ``columns`` names all columns in file order and is checked
    against the header. A gz file is read by one task: ``partitions`` spreads its rows for what follows.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA").option("enforceSchema", False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path if isinstance(path, str) else list(path))
    if n_max is not None:
        df = df.limit(n_max)
    df = df.select(*[na_text(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.repartition(partitions) if partitions else df


def read_table(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A table with declared types, or a Parquet table with its own."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA").option("enforceSchema", False)
    return reader.format(fmt).load(path if isinstance(path, str) else list(path))


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (),
    compression: str | None = None,
) -> None:
    """Write a headed CSV or a Parquet table, one file per task. ``overwrite`` replaces earlier output."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_failures(bad: DataFrame, path: str) -> None:
    """Dead-letter file of failed keys."""
    write_table(bad, path, fmt="csv", mode="overwrite")


def write_flow_bundle(path: str, properties: DataFrame, locations: DataFrame, flows: DataFrame, fmt: str = "csv") -> str:
    """The three tables of a flow map, as one commit: properties, locations, flows. Gives the name of the version.

    Each call writes a folder of its own and, when all three tables are there, a manifest that names it. Readers follow the
    newest manifest, so that a write that breaks off leaves the bundle before it readable and whole.
    """
    version = f"{time.time_ns():020d}-{uuid4().hex}"
    tables = {"properties": properties, "locations": locations, "flows": flows}
    for name, df in tables.items():
        write_table(df, f"{path}/{version}/{name}", fmt=fmt)
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{folder}/manifests", recursive=True)
    hidden = f"{folder}/manifests/.{version}"
    with fs.open_output_stream(hidden) as out:
        out.write(json.dumps({"version": version, "format": fmt, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}}).encode())
    fs.move(hidden, f"{folder}/manifests/{version}.json")
    return version


def read_flow_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the bundle that was committed last."""
    fs, folder = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(pafs.FileSelector(f"{folder}/manifests", allow_not_found=True))
    manifests = sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    if not manifests:
        raise FileNotFoundError(f"no flow map was committed in {path}")
    with fs.open_input_stream(manifests[-1]) as stream:
        told = json.loads(stream.read())
    return read_table(spark, f"{path}/{told['version']}/{name}", T.StructType.fromJson(told["tables"][name]), told["format"])
