"""A linear model of its own for every region, fitted in one pass over the rows whatever the number of regions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.plans.skew import salted_join


def gram_sums(rows: DataFrame, columns: Sequence[str], label: str, keys: Sequence[str] = ("region",)) -> tuple[DataFrame, list[float]]:
    """Sums of products of all columns and the label per key, and the values they were shifted by.

    The sums of a key are numbers that every task adds up for itself before anything moves, so a key with a third of all rows is
    as good as any other. Shifting by the overall means keeps digits; rows with a null are left out.
    """
    names = [*columns, label]
    rows = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).na.drop("any", subset=names)
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = [float(means[c] or 0.0) for c in names]
    z = [F.col(c) - F.lit(s) for c, s in zip(names, shift)]
    sums = [F.sum(x) for x in z] + [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.array(*sums).alias("sums")), shift


def solve(samples: np.ndarray, sums: np.ndarray, shift: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, intercepts, shares of the variance) of all keys at once, from the rows of :func:`gram_sums`.

    Columns are scaled to a deviation of 1 in their key, so ``ridge`` weighs alike on all; a constant column gets 0.
    """
    k = len(shift)
    n = samples[:, None].astype(float)
    mean = sums[:, :k] / n
    upper = np.triu_indices(k)
    square = np.zeros((len(sums), k, k))
    square[:, upper[0], upper[1]] = sums[:, k:] / n
    square = square + np.transpose(np.triu(square, 1), (0, 2, 1)) - mean[:, :, None] * mean[:, None, :]
    spread = np.sqrt(np.clip(np.einsum("rii->ri", square), 0, None))
    live = spread > 1e-9 * (np.abs(mean) + np.abs(shift) + 1e-300)
    scale = np.where(live, 1 / np.where(live, spread, 1), 0)
    x = square[:, :-1, :-1] * scale[:, :-1, None] * scale[:, None, :-1]
    y = square[:, :-1, -1] * scale[:, :-1]
    beta = np.einsum("rij,rj->ri", np.linalg.pinv(x + ridge * np.eye(k - 1), rcond=1e-12, hermitian=True), y)
    coefficients = beta * scale[:, :-1]
    intercepts = mean[:, -1] + shift[-1] - ((mean[:, :-1] + shift[:-1]) * coefficients).sum(1)
    left = square[:, -1, -1] - 2 * (beta * y).sum(1) + np.einsum("ri,rij,rj->r", beta, x, beta)
    total = square[:, -1, -1]
    return coefficients, intercepts, np.where(live[:, -1], 1 - left / np.where(live[:, -1], total, 1), np.nan)


def fit_regions(rows: DataFrame, columns: Sequence[str], label: str = "label", ridge: float = 0.0, minimum: int = 2,
                keys: Sequence[str] = ("region",)) -> DataFrame:
    """(keys, samples, intercept, coefficients, r2): least squares of ``label`` on ``columns`` for every key.

    Keys with fewer than ``minimum`` rows without nulls get no model. One job sums; the small systems are solved side by side where
    their sums are, so the driver sees none of them. ``r2`` is null where the label is constant.
    """
    keys = list(keys)
    summed, shift = gram_sums(rows, columns, label, keys)
    given = np.array(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            samples = batch.column("samples").to_numpy()
            sums = np.array(batch.column("sums").to_pylist(), float)
            coefficients, intercepts, r2 = solve(samples, sums, given, ridge)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), batch.column("samples"), pa.array(intercepts), pa.array(coefficients.tolist(), pa.list_(pa.float64())),
                 pa.array(r2, mask=np.isnan(r2))], names=[*keys, "samples", "intercept", "coefficients", "r2"],
            )

    kinds = ", ".join(f"{k} {summed.schema[k].dataType.simpleString()}" for k in keys)
    return summed.filter(F.col("samples") >= minimum).mapInArrow(
        run, f"{kinds}, samples bigint, intercept double, coefficients array<double>, r2 double",
    )


def linear_point(columns: Sequence[str]) -> Column:
    """Forecast of a row that has the ``intercept`` and ``coefficients`` of its region."""
    return sum((F.col(c).cast("double") * F.col("coefficients")[i] for i, c in enumerate(columns)), F.col("intercept"))


def forecast_regions(rows: DataFrame, models: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("region",), spread: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows with ``point``; rows of a key without a model are left out. The model of a key meets its rows by salts."""
    joined = salted_join(rows, models.select(*keys, "intercept", "coefficients"), list(keys), list(spread))
    return joined.withColumn("point", linear_point(columns)).drop("intercept", "coefficients")
