"""Audit of how filters interact: what each one removes in every order that they can be applied in.

Per part of the corpus, Spark counts documents by which filters they fail. These counts are a tensor with one axis per
filter (passed, failed); every figure of every step of every order is a contraction of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.session import materialize

_GAP = r"[\x20\x09-\x0D]+"
# What a contraction selects along an axis.
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
#: Parts whose figures are worked out at once.
_AT_ONCE = 64
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_words(text: Column) -> Column:
    """The words of a text, as an array: what stands between white space."""
    return F.array_remove(F.split(text, _GAP), "")


def text_filters() -> dict[str, Column]:
    """Failure conditions on the columns ``text`` and ``words``: short, repetitive, loud, and with symbols."""
    n, length = F.size("words"), F.length("text")
    capitals = length - F.length(F.regexp_replace("text", "[A-Z]", ""))
    return {
        "A": n < 200, "B": 100 * F.size(F.array_distinct("words")).cast("bigint") < 50 * n.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 2 * length.cast("bigint"), "D": F.col("text").rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, key: str, text: str, part: str, filters: Mapping[str, Column], copies: str) -> DataFrame:
    """Per key, part and set of failed filters: how many rows (n). Bit i of ``fails`` is filter i; ``copies`` is the last one.

    A text fails ``copies`` where a row with a smaller key has the same one. The smallest key of each text meets the rows on
    text and key together, so the rows of a text that very many documents share spread over all tasks.
    """
    rows = docs.select(
        docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text")
    ).withColumn("words", text_words(F.col("text")))
    bits = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(filters.values())), F.lit(0))
    rows = rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("fails"))
    rows = materialize(rows.groupBy("digest", "key", "part", "fails").agg(F.count(F.lit(1)).alias("n")))
    first = rows.filter(F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("key"))
    met = rows.join(first.withColumn("first", F.lit(True)), ["digest", "key"], "left")
    copied = F.col("key").isNotNull() & F.col("first").isNull()
    return met.select("key", "part", (F.col("fails") + copied.cast("int") * (1 << len(filters))).alias("fails"), "n")


def selections(names: str) -> dict[str, np.ndarray]:
    """For each kind of figure: what every step of every order selects along each axis, [order and step, axis, passed or failed]."""
    kinds: dict[str, list] = {"kept": [], "removed": [], "fails": [], "unique": []}
    for order in permutations(range(len(names))):
        for step, this in enumerate(order):
            before = order[:step]
            kinds["kept"].append([_PASS if f in before or f == this else _ALL for f in range(len(names))])
            kinds["removed"].append([_PASS if f in before else _FAIL if f == this else _ALL for f in range(len(names))])
            kinds["fails"].append([_FAIL if f == this else _ALL for f in range(len(names))])
            kinds["unique"].append([_FAIL if f == this else _PASS for f in range(len(names))])
    return {kind: np.array(chosen, dtype=np.int64) for kind, chosen in kinds.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Counts [part, axis..., measure] summed as ``chosen`` selects: [part, order and step, measure]."""
    axes = tensor.ndim - 2
    operands: list = [tensor, [0, *range(2, 2 + axes), 2 + axes]]
    for axis in range(axes):
        operands += [chosen[:, axis], [1, 2 + axis]]
    return np.einsum(*operands, [0, 1, 2 + axes], optimize="greedy")


def figures(tensor: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """All figures of parts' tensors of (documents, good, toxic) counts: [part, order and step]."""
    got = {kind: contract(tensor, chosen) for kind, chosen in selections(names).items()}
    removed = got["removed"][..., 0]
    this = np.array([f for order in permutations(range(len(names))) for f in order])
    shapley = np.zeros_like(removed)
    for f in range(len(names)):
        shapley[:, this == f] = removed[:, this == f].sum(axis=1, keepdims=True)
    return {
        "kept": got["kept"][..., 0], "removed": removed, "redundant": got["fails"][..., 0] - removed, "unique_fails": got["unique"][..., 0],
        "good_lost": got["removed"][..., 1], "toxic_lost": got["removed"][..., 2], "shapley": shapley,
    }


def audit(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str = "E",
    key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters`` are failure conditions by letter, on ``text`` (missing: empty) and its ``words``; ``copies`` names the last
    one, a text that a smaller key has anywhere in the table. Every order of all of them is audited, each part has all
    rows, zeros included. A document is good or toxic where any label of its key says so.

    A missing part is the empty string. A row without key has no label, is no copy and makes none. Rows that repeat a key
    count one by one and are no copies of each other. Empty texts are equal texts. An empty table gives no rows; other
    columns are not read. A part is 32 counts when it comes together, however many documents it has.
    """
    filters = dict(filters or text_filters())
    names = "".join([*filters, copies])
    failed = failures(docs, key, text, part, filters, copies)
    told = labels.groupBy(labels[key].alias("key")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"), F.max((labels["toxic"] == 1).cast("int")).alias("toxic")
    )
    measures = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(m, F.lit(0))).alias(m) for m in ("good", "toxic"))]
    counts = failed.join(told.filter("key is not null and (good = 1 or toxic = 1)"), "key", "left").groupBy("part", "fails").agg(*measures)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = ["".join(names[f] for f in order) for order in permutations(range(len(names)))]
        for batch in batches:
            for start in range(0, batch.num_rows, _AT_ONCE):
                some = batch.slice(start, _AT_ONCE)
                flat = np.zeros((some.num_rows, 1 << len(names), 3), dtype=np.int64)
                for p, entries in enumerate(some.column(1).to_pylist()):
                    for e in entries:
                        flat[p, e["fails"]] = e["n"], e["good"], e["toxic"]
                # The first filter is the lowest bit, so the last axis of the reshaped tensor: turned round, axis i is filter i.
                tensor = flat.reshape(some.num_rows, *[2] * len(names), 3).transpose(0, *range(len(names), 0, -1), len(names) + 1)
                got = figures(tensor, names)
                steps = len(orders) * len(names)
                columns = {
                    "part": some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), steps))),
                    "filter_order": pa.array([order for order in orders for _ in names] * some.num_rows, pa.string()),
                    "step": pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders) * some.num_rows)),
                } | {name: pa.array(got[name].ravel()) for name in _COUNTS}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS))
