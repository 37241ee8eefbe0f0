"""Row by row enrichment with a user function, failures kept as data, and the retry that follows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from odweave.functions.semantics import single_value, strict_sum
from odweave.functions.text import patch_value, str_detect
from odweave.operators.joins import join
from odweave.operators.reshape import flags_to_rows
from odweave.session import materialize


def map_column(df: DataFrame, fn: Callable[[Any], Any], col: str, to: T.DataType | str, out: str | None = None) -> DataFrame:
    """Apply a Python function to each value of a column, in Arrow batches."""

    arrow = to_arrow_type(T._parse_datatype_string(to) if isinstance(to, str) else to)

    @F.arrow_udf(to)
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([fn(v) for v in values.to_pylist()], arrow)

    return df.withColumn(out or col, apply(F.col(col)))


def _attempt(make: Callable[[], Any]) -> tuple[Any, str | None]:
    try:
        return make(), None
    except Exception as exc:  # the point of this operator: no row may stop the job
        return None, f"{type(exc).__name__}: {exc}"


def call_rows(fn: Callable[..., Any], rows: Iterable[tuple], arrow: pa.DataType) -> tuple[pa.Array, list[str | None]]:
    """Results and errors of ``fn`` on rows of arguments. They are converted at once; only where that fails, each one alone."""
    called = [_attempt(lambda: fn(*args)) for args in rows]
    results, errors = [c[0] for c in called], [c[1] for c in called]
    try:
        return pa.array(results, arrow), errors
    except Exception:
        for i, result in enumerate(results):
            misfit = _attempt(lambda: pa.array([result], arrow))[1]
            if misfit:
                results[i], errors[i] = None, misfit
        return pa.array(results, arrow), errors


def possibly(
    df: DataFrame, fn: Callable[..., Any], inputs: Sequence[str], to: T.DataType, out: str, tasks: int | None = None
) -> DataFrame:
    """Call ``fn`` on every row; an exception gives NULL with ``status`` = "failed" and the message in ``error``.

    A result that does not fit the declared type counts as a failure too. Rows stream through in Arrow batches, their
    own columns untouched; the function gets plain Python values, a missing one as None. ``tasks`` spreads slow calls
    evenly, whatever the keys look like.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(out, to), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
    )
    names, arrow = list(inputs), to_arrow_type(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, errors = call_rows(fn, zip(*[batch.column(n).to_pylist() for n in names]), arrow)
            status = pa.array(["ok" if e is None else "failed" for e in errors], pa.string())
            columns = [*batch.columns, value, status, pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out, "status", "error"])

    return (df.repartition(tasks) if tasks else df).mapInArrow(run, schema)


def map_rows(
    df: DataFrame, fn: Callable[..., list[dict] | None], inputs: Sequence[str], item: T.StructType, out: str = "steps"
) -> DataFrame:
    """A function of several columns that returns a small table per row, kept as an array of structs."""
    return possibly(df, fn, inputs, T.ArrayType(item), out)


def split_failures(df: DataFrame, ok_col: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that have a result, keys of the rows that do not)."""
    return df.filter(F.col(ok_col).isNotNull()), df.filter(F.col(ok_col).isNull()).select(*keys)


def failure_report(df: DataFrame, ok_col: str, weight: str) -> DataFrame:
    """Weight lost to failed rows."""
    return df.filter(F.col(ok_col).isNull()).agg(strict_sum(weight).alias(weight))


def retry_inputs(
    failed: DataFrame, places: DataFrame, flows: DataFrame, origin: str, dest: str, key: str, geometry: str
) -> DataFrame:
    """Failed pairs with the positions of both ends and, by natural join, their flow attributes."""
    for end in (origin, dest):
        ends = places.select(F.col(key).alias(end), F.col(geometry).alias(f"{end}_geo"))
        failed = join(failed, ends, by=end, na_matches="never")
    return join(failed, flows, na_matches="never")


def enrich(
    df: DataFrame,
    fn: Callable[..., Any],
    inputs: Sequence[str],
    to: T.DataType,
    out: str = "steps",
    patches: Mapping[str, Mapping[object, object]] | None = None,
    retries: int = 1,
    tasks: int | None = None,
    log: str | None = None,
) -> DataFrame:
    """Enrich every row, then patch the inputs of the failed ones, retry them and put them in the place of the failures.

    ``patches`` maps an input column to ``{bad value: replacement}``. Each round is written to the shared checkpoint
    folder, so that no row is sent to the function again when its result is read. ``source_file`` tells the round. With a folder
    ``log`` every round keeps an attempt log there (see ``logged``), and a run that broke off goes on where it stopped.
    """

    def ask(rows: DataFrame, name: str) -> DataFrame:
        called = logged(rows, fn, inputs, to, out, f"{log}/{name}") if log else possibly(rows, fn, inputs, to, out, tasks)
        return materialize(called.withColumn("source_file", F.lit("main" if name == "main" else "retried")))

    done = ask(df, "main")
    for round_no in range(1, retries + 1):
        again = done.filter(F.col(out).isNull()).select(*df.columns)
        for col, values in (patches or {}).items():
            for bad, good in values.items():
                again = again.withColumn(col, patch_value(col, bad, col, good))
        redone = ask(again, f"retry-{round_no}")
        done = done.filter(F.col(out).isNotNull()).unionByName(redone)
    return done


def logged(
    df: DataFrame, fn: Callable[..., Any], inputs: Sequence[str], to: T.DataType, out: str, log: str, batches: int = 64
) -> DataFrame:
    """``possibly`` with an attempt log below the shared folder ``log``: what was answered once is not asked again.

    Each different combination of inputs is asked once. Combinations are dealt by hash into ``batches``; the answers of a batch,
    failures too, are written to a file of the batch's name, under another name first, so that a file is whole or not there. A lost
    task, a broken run or a later run on more rows reads the files and asks only for what they lack. A batch is held in memory:
    choose ``batches`` with the number of combinations. ``fn`` must depend on its inputs alone.
    """
    names = list(inputs)
    item = T.StructType([*(df.schema[n] for n in names), T.StructField(out, to), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(item)
    asked = df.select(*names).distinct().withColumn("__batch", F.pmod(F.xxhash64(*names), F.lit(batches)).cast("int"))

    def batch_file(key: int) -> tuple[pafs.FileSystem, str]:
        fs, folder = pafs.FileSystem.from_uri(log)
        fs.create_dir(folder, recursive=True)
        return fs, f"{folder}/batch-{key:06d}.parquet"

    def answer(key: int, rows: list[tuple]) -> pa.Table:
        fs, path = batch_file(key)
        known = pq.read_table(path, filesystem=fs).cast(arrow) if fs.get_file_info(path).type == pafs.FileType.File else arrow.empty_table()
        had = set(zip(*[known[n].to_pylist() for n in names]))
        new = [r for r in rows if r not in had]
        if new:
            called, errors = call_rows(fn, new, to_arrow_type(to))
            columns = [*(pa.array(list(c), arrow.field(n).type) for c, n in zip(zip(*new), names)), called, pa.array(["ok" if e is None else "failed" for e in errors], pa.string()), pa.array(errors, pa.string())]
            known = pa.concat_tables([known, pa.Table.from_arrays(columns, schema=arrow)])
            written = f"{path}.{uuid4().hex}"
            pq.write_table(known, written, filesystem=fs)
            fs.move(written, path)
        wanted = set(rows)
        return known.filter(pa.array([r in wanted for r in zip(*[known[n].to_pylist() for n in names])], pa.bool_()))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in found:
            for key, *row in zip(*[batch.column(n).to_pylist() for n in ["__batch", *names]]):
                if held and key != last:
                    yield from answer(last, held).to_batches()
                    held = []
                held.append(tuple(row))
                last = key
        if held:
            yield from answer(last, held).to_batches()

    dealt = asked.repartition("__batch").sortWithinPartitions("__batch")
    return join(df, materialize(dealt.mapInArrow(run, item)), by=names)


def routes_using(
    steps: DataFrame,
    patterns: Mapping[str, str],
    keys: Sequence[str] = ("h_tract", "w_tract"),
    instructions: str = "instructions",
    commuters: str = "commuters",
) -> DataFrame:
    """Which routes use which named road: one row per (pair, road) whose step text matches, with its commuters.

    Flags are reduced to one row per pair before they become rows, so the shuffle carries pairs, not steps.
    """
    flags = {name: str_detect(instructions, pattern) for name, pattern in patterns.items()}
    per_pair = steps.groupBy(*keys).agg(
        single_value(commuters).alias(commuters), *[F.bool_or(cond).alias(name) for name, cond in flags.items()]
    )
    return flags_to_rows(per_pair, list(flags), [*keys, commuters], names_to="intersects").drop("value")


