"""The tables behind charts: histograms, densities, rescaled weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odweave.operators.joins import join
from odweave.operators.windows import weighted_quantiles
from odweave.session import materialize


def _range(df: DataFrame, col: str):
    r = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    return r.getField("lo"), r.getField("hi")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins, closed on the right, whose centres lie on multiples of the width.

    Only the bin number is shuffled. Empty bins are listed with 0.
    """
    lo, hi = _range(df, col)
    width = (hi - lo) / max(bins - 1, 1)
    origin = width / 2 + F.floor((lo - width / 2) / width) * width
    x = F.col(col).cast("double")
    bin_no = F.when(lo == hi, F.lit(0)).otherwise(F.greatest(F.ceil(F.try_divide(x - origin, width)) - 1, F.lit(0)))
    counts = df.filter(x.isNotNull()).select(bin_no.cast("bigint").alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count")
    )
    # the range is one subquery, worked out once for both parts
    edges = df.sparkSession.range(1).select(F.struct(lo.alias("lo"), hi.alias("hi")).alias("r"))
    w = (F.col("r.hi") - F.col("r.lo")) / max(bins - 1, 1)
    o = w / 2 + F.floor(F.try_divide(F.col("r.lo") - w / 2, w)) * w
    one = F.when(F.col("r.lo") == F.col("r.hi"), F.lit(0)).otherwise(F.lit(bins - 1))
    frame = edges.filter("r.lo is not null").select(
        F.col("r.lo").alias("__lo"), w.alias("__w"), o.alias("__o"), F.explode(F.sequence(F.lit(0), one)).alias("bin")
    )
    frame = frame.select(
        F.col("bin").cast("bigint").alias("bin"),
        F.coalesce(F.col("__o") + F.col("bin") * F.col("__w"), F.col("__lo")).alias("xmin"),
        F.coalesce(F.col("__o") + (F.col("bin") + 1) * F.col("__w"), F.col("__lo")).alias("xmax"),
    )
    return join(frame, counts, by="bin", na_matches="never").fillna({"count": 0})


def _rule_of_thumb(sd: Column, n: Column, low: Column, q1: Column, q3: Column) -> Column:
    """Without any spread the size of the one value stands in, and 1 where that is 0."""
    least = F.least(sd, (q3 - q1) / 1.34)
    spread = F.when(least > 0, least).when(sd > 0, sd).when(low != 0, F.abs(low)).otherwise(F.lit(1.0))
    return spread * 0.9 * F.pow(n, F.lit(-0.2))


def bandwidth(df: DataFrame, col: str, by: Sequence[str] = (), **scan) -> DataFrame:
    """Rule-of-thumb bandwidth 0.9 min(sd, IQR / 1.34) n^(-1/5) of each group, as column ``bw``."""
    by = list(by)
    stats = df.groupBy(*by).agg(F.stddev_samp(col).alias("__sd"), F.count(col).alias("__n"), F.min(col).alias("__low"))
    q = weighted_quantiles(df, col, [0.25, 0.75], by=by, out=["__q1", "__q3"], **scan)
    if by:
        joined = join(stats, q, by=by)
        return joined.select(*by, _rule_of_thumb(*[F.col(c) for c in ("__sd", "__n", "__low", "__q1", "__q3")]).alias("bw"))
    q1, q3 = (q.select(c).scalar() for c in ("__q1", "__q3"))
    return stats.select(_rule_of_thumb(F.col("__sd"), F.col("__n"), F.col("__low"), q1, q3).alias("bw"))


def density(
    df: DataFrame, col: str, grid: int = 512, weight: str | None = None, by: Sequence[str] = (), bins: int = 1024,
    bw: float | None = None, **scan,
) -> DataFrame:
    """Gaussian kernel density at ``grid`` points over the range of the data, optionally weighted and per group.

    Each group has its own bandwidth unless ``bw`` is given. Rows are first spread linearly over ``bins`` + 1 fixed
    points, so the kernel sums cost bins x grid per group whatever the row count.
    """
    by = list(by)
    lo, hi = _range(df, col)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    step = (hi - lo) / bins
    pos = F.coalesce(F.try_divide(F.col("__x") - lo, step), F.lit(0.0))
    rows = df.select(*by, F.col(col).cast("double").alias("__x"), w.alias("__w")).filter("__x is not null and __w > 0")
    rows = rows.withColumn("__pos", pos).withColumn("__left", F.least(F.floor("__pos"), F.lit(bins - 1)).cast("bigint"))
    right_part = F.col("__pos") - F.col("__left")
    parts = rows.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("__left").alias("__bin"), (F.col("__w") * (1 - right_part)).alias("__w")),
                F.struct((F.col("__left") + 1).alias("__bin"), (F.col("__w") * right_part).alias("__w")),
            )
        ),
    )
    binned = parts.groupBy(*by, "__bin").agg(F.sum("__w").alias("__w"))
    if bw is not None:
        points = binned.withColumn("bw", F.lit(float(bw)))
    elif by:
        points = join(binned, bandwidth(df, col, by, **scan), by=by)
    else:
        # one row of constants in one pass, then flat scalar subqueries: one inside another is more than the optimizer takes
        one = df.agg(F.struct(F.stddev_samp(col).alias("sd"), F.count(col).alias("n"), F.min(col).alias("low"))).scalar()
        q = materialize(weighted_quantiles(df, col, [0.25, 0.75], out=["q1", "q3"], **scan))
        points = binned.withColumn("bw", _rule_of_thumb(one["sd"], one["n"], one["low"], q.select("q1").scalar(), q.select("q3").scalar()))
    points = points.withColumns({"__c": lo + F.col("__bin") * step, "__lo": lo, "__hi": hi})
    points = points.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    x = F.col("__lo") + F.col("__i") * (F.col("__hi") - F.col("__lo")) / max(grid - 1, 1)
    z = (F.col("__gx") - F.col("__c")) / F.col("bw")
    kernel = F.exp(-z * z / 2) / (F.col("bw") * F.sqrt(2 * F.pi()))
    sums = points.withColumn("__gx", x).groupBy(*by, F.col("__i").alias("i")).agg(
        F.min("__gx").alias("x"), F.sum(F.col("__w") * kernel).alias("__k"), F.sum("__w").alias("__n")
    )
    return sums.select(*by, "i", "x", (F.col("__k") / F.col("__n")).alias("density"))


def rescale_range(
    df: DataFrame, col: str, lo: float, hi: float, method: str = "linear", out: str | None = None
) -> DataFrame:
    """Map a weight to [lo, hi]; ``area`` rescales the square root, as size scales do. A constant maps to the middle."""
    least, most = _range(df, col)
    unit = F.when(least == most, F.lit(0.5)).otherwise(F.try_divide(F.col(col) - least, most - least))
    if method == "area":
        unit = F.sqrt(unit)
    return df.withColumn(out or f"{col}_scaled", unit * (hi - lo) + lo)


def scale_rms(df: DataFrame, col: str, factor: float = 1.0, out: str | None = None) -> DataFrame:
    """Divide by the root mean square sqrt(sum(x^2) / (n - 1)), then multiply by ``factor``."""
    x = F.col(col).cast("double")
    rms = df.agg(F.sqrt(F.sum(x * x) / F.greatest(F.count(x) - 1, F.lit(1)))).scalar()
    return df.withColumn(out or f"{col}_scaled", F.try_divide(x, rms) * factor)
