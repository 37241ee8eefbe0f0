"""Least squares on route durations. With two predictors the closed form can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.catalog.fixtures import Tables
from odweave.catalog.registry import query
from odweave.operators import model as m
from odweave.operators.reshape import unnest
from odweave.operators.verbs import arrange

_KEY = ["w_tract"]
_FEATURES = ["distance", "steps"]


def _hash(salt: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5('{salt}|' || CAST(w_tract AS VARCHAR)), 1, 8) AS BIGINT) % {n})"


_TRAIN = f"train AS (SELECT * FROM routes WHERE {_hash('split-1234', 10000)} < 7500)"
_MOMENTS = (
    "avg(distance) AS m1, avg(steps) AS m2, avg(duration) AS my, var_samp(distance) AS s11, var_samp(steps) AS s22,"
    " covar_samp(distance, steps) AS s12, covar_samp(distance, duration) AS s1y, covar_samp(steps, duration) AS s2y"
)
_BETA = (
    "(s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2"
)
_FIT = f"{_TRAIN}, fit AS (SELECT *, {_BETA} FROM (SELECT {_MOMENTS} FROM train) q)"
_PRED = "my + b1 * (distance - m1) + b2 * (steps - m2)"
_SCORED = f"{_FIT}, scored AS (SELECT h_tract, w_tract, duration, {_PRED} AS pred FROM routes, fit)"


def _routes(t: Tables) -> DataFrame:
    return t.routes.select(
        "h_tract", "w_tract", F.col("distance").cast("double").alias("distance"), "steps", "duration", "commuters"
    )


def _scored(t: Tables) -> DataFrame:
    training, _ = m.split(_routes(t), _KEY)
    fitted = m.fit(training, "duration", _FEATURES, _FEATURES)
    return m.score(fitted, _routes(t), "duration", _FEATURES, ["h_tract", "w_tract", "duration"])


@query(
    "ml_split",
    f"SELECT w_tract, CASE WHEN {_hash('split-1234', 10000)} < 7500 THEN 'training' ELSE 'testing' END AS part FROM routes",
)
def ml_split(t: Tables) -> DataFrame:
    training, testing = m.split(_routes(t).select("w_tract"), _KEY, 0.75, 1234)
    return training.withColumn("part", F.lit("training")).unionByName(testing.withColumn("part", F.lit("testing")))


@query("ml_features", "SELECT distance, steps FROM routes")
def ml_features(t: Tables) -> DataFrame:
    routes = _routes(t)
    return routes.select(*m.feature_spec(routes, "duration", ids=["w_tract"], drop=["h_tract", "commuters"]))


@query(
    "ml_normalize",
    f"WITH {_TRAIN} SELECT w_tract, round((distance - (SELECT avg(distance) FROM train)) / (SELECT stddev_samp(distance) FROM train), 8) AS distance,"
    " round((steps - (SELECT avg(steps) FROM train)) / (SELECT stddev_samp(steps) FROM train), 8) AS steps FROM routes",
)
def ml_normalize(t: Tables) -> DataFrame:
    training, _ = m.split(_routes(t), _KEY)
    out = m.normalize(_routes(t).select("w_tract", *_FEATURES), training, _FEATURES)
    return out.withColumns({c: F.round(c, 8) for c in _FEATURES})


@query("ml_zero_variance", "SELECT distance, steps FROM routes")
def ml_zero_variance(t: Tables) -> DataFrame:
    routes = _routes(t).withColumn("constant", F.lit(1))
    return routes.select(*m.drop_constant(routes, ["distance", "steps", "constant"]))


@query(
    "ml_folds",
    f"SELECT w_tract, CAST(1 AS INTEGER) AS repeat, CAST({_hash('fold-1234-1', 10)} AS INTEGER) AS fold FROM routes UNION ALL"
    f" SELECT w_tract, 2, CAST({_hash('fold-1234-2', 10)} AS INTEGER) FROM routes",
)
def ml_folds(t: Tables) -> DataFrame:
    return m.folds(_routes(t).select("w_tract"), _KEY)


@query(
    "ml_lm",
    f"WITH {_FIT} SELECT round(my, 5) AS intercept, round(b1, 9) AS b_distance, round(b2, 6) AS b_steps FROM"
    " (SELECT my - b1 * m1 - b2 * m2 AS my, b1, b2 FROM fit) q",
)
def ml_lm(t: Tables) -> DataFrame:
    training, _ = m.split(_routes(t), _KEY)
    lm = m.fit(training, "duration", _FEATURES).stages[-1]
    b = [float(x) for x in lm.coefficients]
    return t.spark.range(1).select(
        F.round(F.lit(float(lm.intercept)), 5).alias("intercept"), F.round(F.lit(b[0]), 9).alias("b_distance"),
        F.round(F.lit(b[1]), 6).alias("b_steps"),
    )


_HELD = (
    f"held AS (SELECT w_tract, distance, steps, duration, 1 AS rep, {_hash('fold-1234-1', 10)} AS fold FROM routes UNION ALL"
    f" SELECT w_tract, distance, steps, duration, 2, {_hash('fold-1234-2', 10)} FROM routes),"
    " combos AS (SELECT DISTINCT rep, fold FROM held),"
    f" fits AS (SELECT *, {_BETA} FROM (SELECT c.rep, c.fold, {_MOMENTS} FROM combos c JOIN held h ON h.rep = c.rep AND h.fold <> c.fold GROUP BY ALL) q),"
    f" preds AS (SELECT h.*, {_PRED} AS pred FROM held h JOIN fits f ON f.rep = h.rep AND f.fold = h.fold),"
    " per AS (SELECT rep, fold, sqrt(avg((duration - pred) * (duration - pred))) AS rmse, pow(corr(duration, pred), 2) AS rsq FROM preds GROUP BY ALL)"
)


@query(
    "ml_cv_metrics",
    f"WITH {_HELD} SELECT 'rmse' AS metric, round(avg(rmse), 6) AS mean, count(*) AS n, round(stddev_samp(rmse) / sqrt(count(*)), 6) AS std_err FROM per"
    " UNION ALL SELECT 'rsq', round(avg(rsq), 6), count(*), round(stddev_samp(rsq) / sqrt(count(*)), 6) FROM per",
)
def ml_cv_metrics(t: Tables) -> DataFrame:
    metrics, _ = m.cross_validate(_routes(t), "duration", _FEATURES, _KEY)
    return m.collect_metrics(metrics).withColumns({c: F.round(c, 6) for c in ("mean", "std_err")})


@query(
    "ml_resample_metrics",
    f"WITH {_HELD} SELECT CAST(rep AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, 'rmse' AS metric, round(rmse, 6) AS estimate FROM per"
    " UNION ALL SELECT CAST(rep AS INTEGER), CAST(fold AS INTEGER), 'rsq', round(rsq, 6) FROM per",
)
def ml_resample_metrics(t: Tables) -> DataFrame:
    """The metrics of every resample: nested per resample, taken apart, worst first."""
    metrics, _ = m.cross_validate(_routes(t), "duration", _FEATURES, _KEY)
    nested = metrics.groupBy("repeat", "fold").agg(F.collect_list(F.struct("metric", "estimate")).alias("metrics"))
    rows = unnest(nested, "metrics").withColumn("estimate", F.round("estimate", 6))
    return arrange(rows, "metric", "-estimate")


@query(
    "ml_cv_predictions",
    f"WITH {_HELD} SELECT w_tract, CAST(rep AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, round(pred, 5) AS pred FROM preds",
)
def ml_cv_predictions(t: Tables) -> DataFrame:
    _, predictions = m.cross_validate(_routes(t), "duration", _FEATURES, _KEY)
    return predictions.select("w_tract", "repeat", "fold", F.round("`.pred`", 5).alias("pred"))


@query(
    "ml_coefficients",
    f"WITH {_FIT} SELECT 'distance' AS term, round(b1 * sqrt(s11), 6) AS estimate FROM fit UNION ALL SELECT 'steps', round(b2 * sqrt(s22), 6) FROM fit",
)
def ml_coefficients(t: Tables) -> DataFrame:
    training, _ = m.split(_routes(t), _KEY)
    fitted = m.fit(training, "duration", _FEATURES, _FEATURES)
    return m.tidy(fitted, training, _FEATURES, _FEATURES).withColumn("estimate", F.round("estimate", 6))


_GAPPY = _SCORED.replace(f"{_PRED} AS pred FROM routes, fit", f"CASE WHEN steps <> 3 THEN {_PRED} END AS pred FROM routes, fit")


@query("ml_predict_gaps", f"WITH {_GAPPY} SELECT h_tract, w_tract, duration, round(pred, 5) AS pred FROM scored")
def ml_predict_gaps(t: Tables) -> DataFrame:
    """Routes with a missing predictor are kept, with a missing prediction."""
    training, _ = m.split(_routes(t), _KEY)
    fitted = m.fit(training, "duration", _FEATURES, _FEATURES)
    gaps = _routes(t).withColumn("steps", F.nullif("steps", F.lit(3)))
    scored = m.score(fitted, gaps, "duration", _FEATURES, ["h_tract", "w_tract", "duration"])
    return scored.select("h_tract", "w_tract", "duration", F.round("`.pred`", 5).alias("pred"))


@query("ml_predict", f"WITH {_SCORED} SELECT h_tract, w_tract, duration, round(pred, 5) AS pred FROM scored")
def ml_predict(t: Tables) -> DataFrame:
    return _scored(t).select("h_tract", "w_tract", "duration", F.round("`.pred`", 5).alias("pred"))


@query("ml_residuals", f"WITH {_SCORED} SELECT w_tract, round(duration - pred, 5) AS resid FROM scored")
def ml_residuals(t: Tables) -> DataFrame:
    return m.residuals(_scored(t), "duration").select("w_tract", F.round("`.resid`", 5).alias("resid"))


@query(
    "ml_residual_by_area",
    f"WITH {_SCORED} SELECT coalesce(h_tract, GEOID) AS h_tract, round(r, 5) AS avg_resid, NAME, segment FROM"
    " (SELECT h_tract, avg(duration - pred) AS r FROM scored GROUP BY 1) q FULL JOIN blocks ON h_tract = GEOID",
)
def ml_residual_by_area(t: Tables) -> DataFrame:
    out = m.residual_by(m.residuals(_scored(t), "duration"), t.blocks, "h_tract")
    return out.withColumn("avg_resid", F.round("avg_resid", 5))
