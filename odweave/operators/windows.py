"""Running totals, row ids and ranks over a whole table without a single-task window.

``in_order`` deals the rows out by ranges of the complete sort key (value, row hash, salt), so that many rows with one
value, or one dominant group, still spread over all ranges, and stores them with the number of their range. ``prefix_scan``
scans each range on its own and shifts it by the totals of the ranges before it. There is one plan for all sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.functions.semantics import sort_keys, strict_sum, whole
from odweave.operators.exact import grids
from odweave.operators.joins import join
from odweave.operators.verbs import arrange
from odweave.session import materialize

_RANGE, _TIE, _SALT = "__range", "__tie", "__salt"


def in_order(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` stored in ranges of (``partition_by``, ``order_by``, row hash), each row with the number of its range.

    The row hash decides ties, so the order does not depend on the partitioning; copies of one row, which it cannot tell
    apart, are separated by a salt that is stored with them. ``partitions`` defaults to the session's shuffle partitions.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tagged = df.withColumns({_TIE: F.xxhash64(*hashable), _SALT: F.rand(seed=7)})
    keys = sort_keys([*partition_by, *order_by, _TIE, _SALT])
    ranged = tagged.repartitionByRange(partitions, *keys) if partitions else tagged.repartitionByRange(*keys)
    return materialize(ranged.withColumn(_RANGE, F.spark_partition_id()))


def scan_stored(
    stored: DataFrame, order_by: Sequence[str], totals: Mapping[str, str], row_id: str | None, partition_by: Sequence[str]
) -> DataFrame:
    """Running sums and row numbers over a table from ``in_order`` with the same keys.

    Floating point columns are summed as whole digits, so their running sums do not depend on the ranges either.
    """
    found = grids(stored, totals.values())
    digits = {out: [f"__d_{out}_{k}" for k in range(len(found[src]))] for out, src in totals.items() if src in found}
    for out, names in digits.items():
        stored = stored.withColumns(dict(zip(names, found[totals[out]].digits(F.col(totals[out])), strict=True)))
    summed = {out: src for out, src in totals.items() if out not in digits} | {f"{d}_run": d for names in digits.values() for d in names}
    parts = list(partition_by)
    within = Window.partitionBy(_RANGE, *parts).orderBy(*sort_keys([*order_by, _TIE, _SALT]))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {out: F.sum(src).over(upto) for out, src in summed.items()}
    if row_id:
        new[row_id] = F.row_number().over(within).cast("bigint")
    local = stored.withColumns(new)
    shifts = _shifts(stored, parts, summed)
    cond = reduce(lambda a, b: a & b, [local[c].eqNullSafe(shifts[f"__s_{c}"]) for c in [_RANGE, *parts]])
    # a range continues at most one group of the ranges before it: no more rows than ranges, so the hint is safe
    joined = local.join(F.broadcast(shifts), cond, "left")

    def shifted(n: str) -> Column:
        before = F.col("__o_rows" if n == row_id else f"__o_{n}")
        # NULL + 0 happens when every value so far is missing; a plain window gives NULL there as well
        moved = F.when(F.col(n).isNull(), before).otherwise(F.col(n) + F.coalesce(before, F.lit(0)))
        return moved.cast(local.schema[n].dataType).alias(n)

    hidden = {_RANGE, _TIE, _SALT, *(d for names in digits.values() for d in names)}
    keep = [c for c in stored.columns if c not in hidden]
    moved = joined.select(*keep, *[shifted(n) for n in new])
    whole_sums = {out: found[totals[out]].value([F.col(f"{d}_run") for d in names]) for out, names in digits.items()}
    return moved.select(*keep, *[whole_sums[n].alias(n) if n in digits else n for n in [*totals, *([row_id] if row_id else [])]])


def _shifts(stored: DataFrame, parts: list[str], totals: Mapping[str, str]) -> DataFrame:
    """Sums and counts of everything before each range (before each range within its group), where there is anything."""
    keys = [_RANGE, *parts]
    per = stored.groupBy(*keys).agg(*[F.sum(src).alias(out) for out, src in totals.items()], F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*parts).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    found = per.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        *[F.sum(n).over(before).alias(f"__o_{n}") for n in totals],
        F.sum("__rows").over(before).alias("__o_rows"),
    )
    return found.filter(F.col("__o_rows").isNotNull())


def prefix_scan(
    df: DataFrame,
    order_by: Sequence[str],
    totals: Mapping[str, str] | None = None,
    row_id: str | None = None,
    partition_by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add running sums ``{new column: summed column}`` and / or a row number in the order ``order_by``.

    ``-name`` sorts descending; missing values sort last; ties go by a hash of the row. With ``partition_by`` the scan
    restarts per group. Sums are exact: those of floating point columns are rounded once, after the last addition.
    """
    stored = in_order(df, order_by, partition_by, partitions)
    return scan_stored(stored, order_by, dict(totals or {}), row_id, partition_by)


def add_row_id(df: DataFrame, order_by: Sequence[str], out: str = "id", **scan) -> DataFrame:
    """Dense id 1..n in a global order."""
    return prefix_scan(df, order_by, row_id=out, **scan)


def add_step_id(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "id", **scan) -> DataFrame:
    """Number of a step within its origin-destination pair."""
    return prefix_scan(df, order_by, row_id=out, partition_by=keys, **scan)


def cumulative_share(df: DataFrame, col: str, tiebreak: Sequence[str], out_id: str = "id", **scan) -> DataFrame:
    """Row id, share and running share of ``col``, largest first. One missing value makes all shares missing."""
    order = [f"-{col}", *tiebreak]
    stored = in_order(df, order, **scan)
    grand = stored.agg(_strict_total(stored, col)).scalar()
    scanned = scan_stored(stored, order, {"__run": col}, out_id, ())
    return scanned.withColumns(
        {f"pct_{col}": F.try_divide(F.col(col), grand), f"cumulative_pct_{col}": F.try_divide(F.col("__run"), grand)}
    ).drop("__run")


def _strict_total(df: DataFrame, col: str) -> Column:
    """``strict_sum``; of a floating point column the sum that its running sum ends with."""
    found = grids(df, [col])
    return F.when(F.count(col) == F.count(F.lit(1)), found[col].total(F.col(col))) if found else strict_sum(col)


def top_share(df: DataFrame, col: str, share: float, tiebreak: Sequence[str], **scan) -> DataFrame:
    """The largest rows that together carry at most ``share`` of the total."""
    ranked = cumulative_share(df, col, tiebreak, **scan)
    return ranked.filter(F.col(f"cumulative_pct_{col}") <= share).select(*df.columns)


def share_buckets(
    df: DataFrame, col: str, cut: float, labels: tuple[str, str], tiebreak: Sequence[str], out: str = "flag", **scan
) -> DataFrame:
    """Sum of ``col`` inside and outside the top share; ``labels`` are (inside, outside)."""
    ranked = cumulative_share(df, col, tiebreak, **scan)
    inside = F.col(f"cumulative_pct_{col}") <= cut
    flag = F.when(inside, F.lit(labels[0])).when(~inside, F.lit(labels[1]))
    return ranked.groupBy(flag.alias(out)).agg(_strict_total(ranked, col).alias(col))


def add_percent_rank(df: DataFrame, col: str, out: str = "percentile", **scan) -> DataFrame:
    """(rank - 1) / (n - 1) among the non-missing values; a single value gives 0, a missing one NULL.

    Only the distinct values are scanned; their ranks are joined back.
    """
    counts = in_order(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n")), [col], **scan)
    ranks = scan_stored(counts, [col], {"__upto": "__n"}, None, ())
    others = counts.agg(F.sum("__n")).scalar() - 1
    below = F.col("__upto") - F.col("__n")
    ranks = ranks.select(col, F.when(others > 0, below / others).otherwise(F.lit(0.0)).alias(out))
    return join(df, ranks, by=col, na_matches="never")


def add_count(df: DataFrame, keys: Sequence[str], out: str = "n", sort: bool = False) -> DataFrame:
    """Group size on every row. Counted with map-side combine and joined back, so no group is gathered in a task."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    counted = join(df, sizes, by=list(keys))
    return arrange(counted, f"-{out}", *keys) if sort else counted


#: Frames of one block of ``cumulative_frames``.
_BLOCK = 4096


def cumulative_frames(df: DataFrame, frame: str, measures: Sequence[str], **scan) -> DataFrame:
    """Totals over all rows whose frame id is at most each frame's: summed per frame, then a running sum.

    Sums of floating point measures are exact until the last rounding. Whole frame ids are scanned in blocks of ids, without
    sorting or storing the table of frames; any other id (also a missing one, which comes last) takes the scan by ranges.
    """
    found = grids(df, measures)
    digits = {m: [f"__d_{m}_{k}" for k in range(len(found[m]))] if m in found else [m] for m in measures}
    aggs = [F.sum(d).alias(n) for m in measures for d, n in zip(found[m].digits(F.col(m)) if m in found else [F.col(m)], digits[m], strict=True)]
    sums = [*(n for m in measures for n in digits[m]), "rows"]
    per = df.groupBy(frame).agg(*aggs, F.count(F.lit(1)).alias("rows"))
    if isinstance(df.schema[frame].dataType, T.IntegralType) and not scan:
        scanned = _blockwise(per, frame, sums)
    else:
        scanned = prefix_scan(per, [frame], {f"__c_{n}": n for n in sums}, **scan)
    values = {m: found[m].value([F.col(f"__c_{n}") for n in digits[m]]) if m in found else F.col(f"__c_{m}") for m in measures}
    return scanned.select(frame, *[v.alias(f"cumulative_{m}") for m, v in values.items()], F.col("__c_rows").alias("cumulative_rows"))


def _blockwise(per: DataFrame, frame: str, sums: Sequence[str]) -> DataFrame:
    """Running sums in the order of a whole number: inside blocks of ids, and over the blocks' own sums."""
    block = F.floor(F.col(frame) / _BLOCK)
    blocked = per.withColumn("__block", F.coalesce(block, F.lit((1 << 62))))
    inside = Window.partitionBy("__block").orderBy(F.col(frame).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.groupBy("__block").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("__block").alias("__b"), *[F.sum(n).over(before).alias(f"__o_{n}") for n in sums])
    local = blocked.withColumns({f"__c_{n}": F.sum(n).over(inside) for n in sums})
    joined = local.join(shifts, local["__block"] == shifts["__b"])

    def shifted(n: str) -> Column:
        kind, own, moved = per.schema[n].dataType, F.col(f"__c_{n}"), F.col(f"__o_{n}")
        return F.when(own.isNull(), moved).otherwise(own + F.coalesce(moved, F.lit(0))).cast(kind).alias(f"__c_{n}")

    return joined.select(frame, *[shifted(n) for n in sums])


def weighted_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    weight: str | None = None,
    by: Sequence[str] = (),
    out: Sequence[str] | None = None,
    **scan,
) -> DataFrame:
    """Exact quantiles with linear interpolation, every row counted ``weight`` times (once without a weight).

    Works on distinct values and their counts: no rows are repeated and no group is gathered. Rows with a missing
    value or a missing or zero weight do not count; a weight that is no whole number is an error.
    """
    by = list(by)
    names = list(out or [f"q{p:g}" for p in probs])
    w = whole(weight) if weight else F.lit(1).cast("bigint")
    counts = (
        df.select(*by, F.col(col).cast("double").alias("__x"), w.alias("__w"))
        .filter(F.col("__x").isNotNull() & (F.col("__w") > 0))
        .groupBy(*by, "__x")
        .agg(F.sum("__w").alias("__w"))
    )
    counts = in_order(counts, ["__x"], by, **scan)
    upto = scan_stored(counts, ["__x"], {"__upto": "__w"}, None, by)
    if by:
        sizes = counts.groupBy(*by).agg(F.sum("__w").alias("__n"))
        upto = join(upto, sizes, by=by)
    else:
        upto = upto.withColumn("__n", counts.agg(F.sum("__w")).scalar())

    def at(position: Column) -> Column:
        """Value at a zero-based position of the repeated, sorted rows."""
        return F.min(F.when(F.col("__upto") > position, F.col("__x")))

    aggs = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        frac = F.max(pos - F.floor(pos))
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return upto.groupBy(*by).agg(*aggs)


def weighted_median(df: DataFrame, col: str, weight: str, out: str = "median", **scan) -> DataFrame:
    return weighted_quantiles(df, col, [0.5], weight, out=[out], **scan)
