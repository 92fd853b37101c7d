"""Least squares, its metrics and cross-validation. Data is reduced to sums by Spark; only these reach the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import fold_of


@dataclass(frozen=True)
class LinearModel:
    """Intercept and coefficients of named features."""

    intercept: float
    coefficients: tuple[float, ...]
    features: tuple[str, ...]

    def predict(self, features: Sequence[Column] | None = None) -> Column:
        """The prediction as a Column: a sum that stays in generated code."""
        given = [F.col(c) for c in self.features] if features is None else list(features)
        if len(given) != len(self.coefficients):
            raise ValueError(f"the model has {len(self.coefficients)} features, {len(given)} given")
        total = F.lit(self.intercept)
        for c, x in zip(self.coefficients, given, strict=True):
            total = total + F.lit(c) * x.cast("double")
        return total


@dataclass(frozen=True)
class Moments:
    """Rows, means, and sums of products of deviations from the means, of features and label (last)."""

    rows: int
    means: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        """Those of both tables together."""
        if not self.rows or not other.rows:
            return self if self.rows else other
        rows = self.rows + other.rows
        apart = other.means - self.means
        products = self.products + other.products + np.outer(apart, apart) * (self.rows * other.rows / rows)
        return Moments(rows, self.means + apart * (other.rows / rows), products)


def _moment_columns(features: Sequence[str], label: str) -> list[Column]:
    """Aggregates for ``_moments``. Each deviates from its own mean and is merged so, hence features far from zero lose no
    digits, as sums of their squares would."""
    values = [*(F.col(c).cast("double") for c in features), F.col(label).cast("double")]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    return [
        F.count(F.lit(1)).alias("rows"), *(F.avg(v).alias(f"mean_{i}") for i, v in enumerate(values)),
        *(F.covar_pop(values[i], values[j]).alias(f"covar_{i}_{j}") for i, j in pairs),
    ]


def _moments(row: Mapping[str, object], many: int) -> Moments:
    products = np.zeros((many, many))
    for i in range(many):
        for j in range(i, many):
            products[i, j] = products[j, i] = (row[f"covar_{i}_{j}"] or 0.0) * row["rows"]
    return Moments(row["rows"], np.array([row[f"mean_{i}"] or 0.0 for i in range(many)], float), products)


def _solve(found: Moments, features: Sequence[str]) -> LinearModel:
    if not found.rows:
        raise ValueError("no rows to fit")
    scale = np.sqrt(np.maximum(np.diag(found.products)[:-1], 0.0))
    scale[scale == 0] = 1.0
    scaled = found.products[:-1, :-1] / np.outer(scale, scale)
    slopes = np.linalg.lstsq(scaled, found.products[:-1, -1] / scale, rcond=1e-12)[0] / scale
    intercept = found.means[-1] - float(found.means[:-1] @ slopes)
    return LinearModel(float(intercept), tuple(map(float, slopes)), tuple(features))


def least_squares(frame: DataFrame, features: Sequence[str], label: str) -> LinearModel:
    """Ordinary least squares with an intercept, from one aggregate; rows with a null are left out."""
    complete = frame.dropna(subset=[*features, label])
    row = complete.agg(*_moment_columns(features, label)).first().asDict()
    return _solve(_moments(row, len(features) + 1), features)


def gradient_descent(
    frame: DataFrame, features: Sequence[str], label: str, epochs: int = 100, rate: float = 0.5, least_change: float = 1e-9
) -> LinearModel:
    """Least squares by gradient descent over standardised features: each epoch sums the gradient of all rows in one
    aggregate and moves against it. It ends early once no weight moves by ``least_change``. Rows with a null are left out.

    Where the rows fit one machine an online method takes one row at a time; here the rows of an epoch are taken together,
    so the result depends neither on their order nor on the partitions. It comes near ``least_squares``, which needs no
    epochs.
    """
    complete = frame.dropna(subset=[*features, label])
    names = [*features, label]
    row = complete.agg(
        F.count(F.lit(1)).alias("rows"), *(F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(names)),
        *(F.stddev_pop(F.col(c).cast("double")).alias(f"deviation_{i}") for i, c in enumerate(names)),
    ).first()
    if not row["rows"]:
        raise ValueError("no rows to fit")
    means, deviations = (np.array([row[f"{x}_{i}"] for i in range(len(names))], float) for x in ("mean", "deviation"))
    deviations[deviations == 0] = 1.0
    scaled = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(d)) for c, m, d in zip(names, means, deviations, strict=True)]
    weights = np.zeros(len(features))
    step = rate / max(1, len(features))
    for _ in range(epochs):
        error = reduce(add, (F.lit(float(w)) * x for w, x in zip(weights, scaled, strict=False)), F.lit(0.0)) - scaled[-1]
        gradient = complete.agg(*(F.avg(error * x).alias(f"g_{i}") for i, x in enumerate(scaled[:-1]))).first()
        move = step * np.array(gradient, float)
        weights -= move
        if np.abs(move).max(initial=0.0) < least_change:
            break
    slopes = weights * deviations[-1] / deviations[:-1]
    intercept = means[-1] - float(means[:-1] @ slopes)
    return LinearModel(float(intercept), tuple(map(float, slopes)), tuple(features))


def metric_columns(actual: Column, predicted: Column, mean: float) -> list[Column]:
    """Aggregates: r2_score, squared_correlation, mean_absolute_error, max_error, root_mean_squared_error."""
    error = actual - predicted
    total = F.sum((actual - F.lit(mean)) * (actual - F.lit(mean)))
    return [
        (F.lit(1.0) - F.try_divide(F.sum(error * error), total)).alias("r2_score"),
        F.pow(F.corr(actual, predicted), 2).alias("squared_correlation"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.max(F.abs(error)).alias("max_error"),
        F.sqrt(F.avg(error * error)).alias("root_mean_squared_error"),
    ]


def evaluate(frame: DataFrame, model: LinearModel, label: str) -> DataFrame:
    """One row of metrics of the model's predictions."""
    scored = frame.select(F.col(label).cast("double").alias("y"), model.predict().alias("p")).dropna()
    mean = scored.agg(F.avg("y")).first()[0]
    if mean is None:
        raise ValueError("no rows to evaluate")
    return scored.agg(*metric_columns(F.col("y"), F.col("p"), mean))


def cross_validate(frame: DataFrame, key: str, features: Sequence[str], label: str, folds: int, seed: int) -> DataFrame:
    """Metrics of each fold (``fold`` from 0), its model fitted on the other folds.

    One pass takes the moments by fold; a fold's model comes from those of the other folds together. A second pass scores
    every row with its fold's model.
    """
    if not 2 <= folds <= 100:
        raise ValueError("folds must be from 2 to 100")
    parted = frame.dropna(subset=[*features, label]).withColumn("fold", fold_of(seed, F.col(key), folds))
    rows = parted.groupBy("fold").agg(*_moment_columns(features, label)).collect()
    found = {r["fold"]: _moments(r.asDict(), len(features) + 1) for r in sorted(rows, key=lambda r: r["fold"])}
    none = Moments(0, np.zeros(len(features) + 1), np.zeros((len(features) + 1,) * 2))
    prediction, mean = F.lit(None).cast("double"), F.lit(None).cast("double")
    for fold, own in found.items():
        model = _solve(reduce(add, (m for f, m in found.items() if f != fold), none), features)
        prediction = F.when(F.col("fold") == fold, model.predict()).otherwise(prediction)
        mean = F.when(F.col("fold") == fold, F.lit(float(own.means[-1]))).otherwise(mean)
    scored = parted.select("fold", F.col(label).cast("double").alias("y"), prediction.alias("p"), mean.alias("m"))
    error, spread = F.col("y") - F.col("p"), F.col("y") - F.col("m")
    return scored.groupBy("fold").agg(
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.sum(spread * spread))).alias("r2_score"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.sqrt(F.avg(error * error)).alias("root_mean_squared_error"),
        F.avg(error * error).alias("loss_function_value"),
    )


def summarize_folds(metrics: DataFrame, reference_r2: float | None = None) -> DataFrame:
    """One row: mean, population deviation, least and largest R² of the folds, their number, the distance from a reference,
    and the folds themselves as an array."""
    reference = F.lit(reference_r2).cast("double")
    return metrics.agg(
        F.sort_array(F.collect_list(F.struct(*metrics.columns))).alias("fold_metrics"),
        F.avg("r2_score").alias("mean_r2_score"),
        F.stddev_pop("r2_score").alias("std_dev_r2_score"),
        F.min("r2_score").alias("min_r2_score"),
        F.max("r2_score").alias("max_r2_score"),
        F.count(F.lit(1)).cast("int").alias("num_folds"),
    ).withColumns({"reference_r2_score": reference, "difference_from_reference": F.abs(F.col("mean_r2_score") - reference)})


def confusion_matrix(frame: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of the four cells, one row for each actual class 0 and 1 that occurs."""
    return frame.groupBy(F.col(actual).alias("actual")).agg(
        F.count_if(F.col(predicted) == 0).alias("predicted_0"), F.count_if(F.col(predicted) == 1).alias("predicted_1")
    )


def normal_curve(spark, mean: float, deviation: float, points: int, width: float = 4.0) -> DataFrame:  # noqa: ANN001
    """Evenly spaced points over mean ± width deviations, with the normal density."""
    from tessera.functions import normal_pdf

    low, step = mean - width * deviation, 2 * width * deviation / (points - 1)
    x = (F.lit(low) + F.col("id") * F.lit(step)).alias("x")
    return spark.range(points).select(F.col("id").alias("i"), x).withColumn("density", normal_pdf(F.col("x"), mean, deviation))
