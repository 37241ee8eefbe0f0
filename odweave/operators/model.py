"""Least squares for route durations: split, folds, recipe, fit, cross-validation, residuals.

The single fit is a Spark ML pipeline. Cross-validation needs one pass instead of one per resample: the sums of
products per fold are enough for every fit, and the training part of a resample is the total minus its fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odweave.operators.aggregates import mean_by
from odweave.operators.joins import join
from odweave.session import materialize


def _bucket(key: Sequence[str], salt: str, n: int) -> Column:
    """Stable bucket 0..n-1 of a row key: the same on every run, partitioning and engine."""
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def split(df: DataFrame, key: Sequence[str], prop: float = 0.75, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """(training, testing). A row's side depends only on its key and the seed."""
    training = _bucket(key, f"split-{seed}", 10_000) < int(round(prop * 10_000))
    return df.filter(training), df.filter(~training)


def folds(df: DataFrame, key: Sequence[str], v: int = 10, repeats: int = 2, seed: int = 1234) -> DataFrame:
    """Long form: one row per repeat with the fold that holds the row out."""
    per = [
        F.struct(F.lit(r).alias("repeat"), _bucket(key, f"fold-{seed}-{r}", v).cast("int").alias("fold"))
        for r in range(1, repeats + 1)
    ]
    return df.select("*", F.inline(F.array(*per)))


def feature_spec(df: DataFrame, label: str, ids: Sequence[str] = (), drop: Sequence[str] = ()) -> list[str]:
    """Predictors of ``label ~ .``: every column but the label, the ids and the dropped ones."""
    return [c for c in df.columns if c != label and c not in ids and c not in drop]


def drop_constant(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Predictors with more than one value, decided in one aggregate row."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def normalize(df: DataFrame, training: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and scale with the training mean and standard deviation."""
    stats = training.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols])
    ).scalar()
    scaled = {
        c: F.try_divide(F.col(c) - stats.getField(c).getField("m"), stats.getField(c).getField("s")) for c in cols
    }
    return df.withColumns(scaled)


def lm_pipeline(label: str, features: Sequence[str], scaled: Sequence[str] = ()) -> Pipeline:
    """Recipe and least squares: centre and scale ``scaled``, drop constant predictors, fit.

    A row with a missing predictor gets a missing prediction.
    """
    rest = [c for c in features if c not in scaled]
    stages = []
    inputs = []
    if scaled:
        stages += [
            VectorAssembler(inputCols=list(scaled), outputCol="__num", handleInvalid="keep"),
            StandardScaler(inputCol="__num", outputCol="__std", withMean=True, withStd=True),
        ]
        inputs.append("__std")
    stages += [
        VectorAssembler(inputCols=[*inputs, *rest], outputCol="__all", handleInvalid="keep"),
        VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="__all", outputCol="features"),
        LinearRegression(labelCol=label, featuresCol="features", predictionCol="pred", solver="normal"),
    ]
    return Pipeline(stages=stages)


def fit(df: DataFrame, label: str, features: Sequence[str], scaled: Sequence[str] = (), stored: bool = False) -> PipelineModel:
    """Fit the pipeline on the rows without missing values. Each stage is a pass, so the model columns are stored once, unless
    ``df`` comes from a table that is ``stored``."""
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in [label, *features]]).dropna("any")
    return lm_pipeline(label, features, scaled).fit(numeric if stored else materialize(numeric))


def tidy(model: PipelineModel, df: DataFrame, features: Sequence[str], scaled: Sequence[str] = ()) -> DataFrame:
    """Term / estimate table without the intercept, largest estimate first."""
    names = [*scaled, *[c for c in features if c not in scaled]]
    selected = model.stages[-2].selectedFeatures
    rows = [(names[i], float(b)) for i, b in zip(selected, model.stages[-1].coefficients)]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("estimate").desc(), "term")


def score(model: PipelineModel, df: DataFrame, label: str, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Predictions of all rows next to their identifying columns; NULL where a predictor is missing."""
    inputs = df.withColumns({f"__keep_{c}": F.col(c) for c in keep}).withColumns(
        {c: F.col(c).cast("double") for c in features}
    )
    return model.transform(inputs).select(*[F.col(f"__keep_{c}").alias(c) for c in keep], F.nanvl("pred", F.lit(None).cast("double")).alias(".pred"))


def residuals(df: DataFrame, label: str, pred: str = ".pred", out: str = ".resid") -> DataFrame:
    return df.withColumn(out, F.col(label) - F.col(f"`{pred}`"))


def residual_by(df: DataFrame, areas: DataFrame, area: str, resid: str = ".resid", key: str = "GEOID") -> DataFrame:
    """Mean residual per area, largest first; areas without routes are kept with a missing mean."""
    means = mean_by(df.withColumnRenamed(resid, "__r"), [area], "__r", out="avg_resid")
    return join(means, areas, by={area: key}, how="full", na_matches="never").orderBy(
        F.col("avg_resid").desc_nulls_last(), F.col(area).asc_nulls_last()
    )


# --- cross-validation from sums of products -------------------------------------------------------------------

def _solve(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of the last variable on the others; constant predictors get 0."""
    p = len(sums) - 1
    cov = products - np.outer(sums, sums) / n
    var = np.diag(cov)[:p]
    keep = np.flatnonzero(var > 1e-12 * np.maximum(np.diag(products)[:p], 1e-300))
    beta = np.zeros(p)
    if len(keep):
        beta[keep] = np.linalg.lstsq(cov[np.ix_(keep, keep)], cov[keep, p], rcond=None)[0]
    return np.concatenate([[(sums[p] - beta @ sums[:p]) / n], beta])


def cross_validate(
    df: DataFrame, label: str, features: Sequence[str], key: Sequence[str], v: int = 10, repeats: int = 2, seed: int = 1234, stored: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions). Metrics hold rmse and rsq (squared correlation) per repeat and fold; predictions hold
    the held-out prediction of every row per repeat. The driver sees one row of sums per resample. The model columns are
    stored once, unless ``df`` comes from a table that is ``stored``."""
    spark = df.sparkSession
    names = [*features, label]
    rows = df.select(*key, *[F.col(c).cast("double").alias(c) for c in names]).dropna("any", subset=names)
    rows = rows if stored else materialize(rows)
    centre = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    held = folds(rows, key, v, repeats, seed)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    d = [F.col(c) - F.lit(centre[c]) for c in names]
    sums: list[Row] = (
        held.groupBy("repeat", "fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(x).alias(f"s{i}") for i, x in enumerate(d)],
            *[F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    )

    def unpack(r: Row) -> tuple[float, np.ndarray, np.ndarray]:
        products = np.zeros((len(names), len(names)))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        return float(r["n"]), np.array([r[f"s{i}"] for i in range(len(names))]), products

    models = []
    for repeat in sorted({r["repeat"] for r in sums}):
        parts = {r["fold"]: unpack(r) for r in sums if r["repeat"] == repeat}
        n, s, p = (sum(part[i] for part in parts.values()) for i in range(3))
        for fold, (fn, fs, fp) in parts.items():
            if n > fn:
                models.append((repeat, fold, [float(b) for b in _solve(n - fn, s - fs, p - fp)]))
    fitted = spark.createDataFrame(models, "repeat int, fold int, beta array<double>")
    scored = join(held, fitted, by=["repeat", "fold"], how="inner", na_matches="never")
    pred = F.get("beta", F.lit(0)) + F.lit(centre[label])
    for i, c in enumerate(features):
        pred = pred + F.get("beta", F.lit(i + 1)) * (F.col(c) - F.lit(centre[c]))
    predictions = scored.select(*key, "repeat", "fold", label, pred.alias(".pred"))
    error = F.col(label) - F.col("`.pred`")
    per = predictions.groupBy("repeat", "fold").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.pow(F.corr(label, "`.pred`"), F.lit(2.0)).alias("rsq")
    )
    return per.unpivot(["repeat", "fold"], ["rmse", "rsq"], "metric", "estimate"), predictions


def collect_metrics(metrics: DataFrame) -> DataFrame:
    """Mean, number and standard error of each metric over the resamples."""
    return metrics.groupBy("metric").agg(
        F.avg("estimate").alias("mean"),
        F.count("estimate").alias("n"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("estimate"))).alias("std_err"),
    )
