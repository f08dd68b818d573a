"""Ridge regression for ranking: Spark sums the Gram matrix, the driver solves a system of a few dozen unknowns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ridge:
    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        parts = [(F.col(f) - m) / s * w for f, m, s, w in zip(self.features, self.mean, self.scale, self.weights)]
        return reduce(lambda a, b: a + b, parts, F.lit(self.intercept))


def gram(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: n, sums, and sums of products of features and label; rows with a missing value are left out."""
    names = [*features, label]
    d = df.dropna(subset=names)
    sums = [F.sum(a).alias(f"s_{a}") for a in names]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return d.agg(F.count("*").alias("n"), *sums, *products)


def fit(df: DataFrame, features: list[str], label: str, alpha: float = 10.0, min_rows: int = 24) -> Ridge:
    """Features standardized by their population deviation (1 where it is 0); the intercept is not penalised. Means come
    first, products of centred values in a second pass, so that large means cost no digits."""
    names = [*features, label]
    d = df.dropna(subset=names)
    first = d.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    n = first["n"]
    if n < min_rows:
        raise ValueError(f"{n} rows are too few")
    k = len(features)
    mean = np.array([first[c] for c in names])
    g = gram(d.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip(names, mean)]), features, label).first()
    cov = np.array([[g[f"p_{names[min(i, j)]}_{names[max(i, j)]}"] for j in range(k + 1)] for i in range(k + 1)]) / n
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale[scale == 0] = 1.0
    x = n * cov[:k, :k] / np.outer(scale, scale)
    y = n * cov[:k, k] / scale
    w = np.linalg.solve(x + alpha * np.eye(k), y)
    return Ridge(features, mean[:k].tolist(), scale.tolist(), w.tolist(), float(mean[k]))


def yearly_grams(df: DataFrame, features: list[str], label: str, day: str) -> DataFrame:
    """A row a year: y, n, sums and sums of products of features and label, from one pass over the samples."""
    names = [*features, label]
    d = df.dropna(subset=[*names, day])
    sums = [F.sum(a).alias(f"s_{a}") for a in names]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return d.groupBy(F.year(day).cast("long").alias("y")).agg(F.count("*").alias("n"), *sums, *products)


def expanding_fits(grams: DataFrame, features: list[str], label: str, first: int, years: list[int], alpha: float = 10.0, min_rows: int = 24) -> dict[int, Ridge]:
    """A model for each year, fitted on all years from `first` on that come before it: the years' matrices are added up, so the
    samples are read once for all windows. Years with too few rows before them have no model."""
    names = [*features, label]
    k = len(features)
    rows = {r.y: r for r in grams.where(F.col("y") >= first).collect()}  # a row a year
    out = {}
    for year in years:
        before = [r for y, r in rows.items() if y < year]
        n = sum(r["n"] for r in before)
        if n < min_rows:
            continue
        total = np.array([sum(r[f"s_{c}"] for r in before) for c in names])
        products = np.array([[sum(r[f"p_{names[min(i, j)]}_{names[max(i, j)]}"] for r in before) for j in range(k + 1)] for i in range(k + 1)])
        mean = total / n
        cov = products / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
        scale[scale == 0] = 1.0
        x = n * cov[:k, :k] / np.outer(scale, scale)
        w = np.linalg.solve(x + alpha * np.eye(k), n * cov[:k, k] / scale)
        out[year] = Ridge(features, mean[:k].tolist(), scale.tolist(), w.tolist(), float(mean[k]))
    return out


def score_by_year(df: DataFrame, models: dict[int, Ridge], day: str) -> DataFrame:
    """df of the years that have a model, with the score that the year's own model gives."""
    score = F.lit(None).cast("double")
    for year, model in models.items():
        score = F.when(F.year(day) == year, model.score()).otherwise(score)
    return df.where(F.year(day).isin(*models)).withColumn("score", score)
