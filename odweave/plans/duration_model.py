"""How long should a route take, and where does it take longer?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from odweave.operators.model import collect_metrics, cross_validate, fit, residual_by, residuals, score, split, tidy
from odweave.operators.reshape import role_panel


@dataclass(frozen=True)
class DurationModel:
    model: PipelineModel
    coefficients: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    by_origin: DataFrame
    by_destination: DataFrame
    panel: DataFrame


def duration_model(
    routes: DataFrame,
    areas: DataFrame,
    features: Sequence[str] = ("distance", "steps"),
    scaled: Sequence[str] = ("distance", "steps"),
    label: str = "duration",
    origin: str = "h_tract",
    dest: str = "w_tract",
    key: Sequence[str] = ("h_tract", "w_tract"),
    seed: int = 1234,
    stored: bool = False,
) -> DurationModel:
    """Cross-validate on the training part, fit it, score all routes and average the residuals per area.

    Routes that are ``stored`` already are read in each pass and not written again.
    """
    training, _ = split(routes, key, 0.75, seed)
    metrics, _ = cross_validate(training, label, features, key, seed=seed, stored=stored)
    model = fit(training, label, features, scaled, stored)
    keep = list(dict.fromkeys([*key, origin, dest, *features, label]))
    predictions = residuals(score(model, routes, label, features, keep), label)
    return DurationModel(
        model=model,
        coefficients=tidy(model, routes, features, scaled),
        metrics=collect_metrics(metrics),
        predictions=predictions,
        by_origin=residual_by(predictions, areas, origin),
        by_destination=residual_by(predictions, areas, dest),
        panel=role_panel(areas, predictions.withColumnRenamed(".resid", "resid"), origin, dest, "resid"),
    )
