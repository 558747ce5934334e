"""Learners on windows: the last 96 rows of 13 features as one vector of small bin numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.config import STEP_MINUTES, WINDOW_ROWS
from loadspan.operators.features import reach
from loadspan.operators.models import ensemble_mean, members
from loadspan.plans.blocks import with_window_columns

BINS = 64


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int = BINS, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Different quantiles between the bins of each column, in one pass over ``rows``; the driver gets ``bins`` numbers a column.

    Take them from training rows. A column of one value, or none, has no edges or one.
    """
    if not 1 < bins <= 127:
        raise ValueError("a bin is a small number: 2 to 127 bins")
    cuts = [F.percentile_approx(F.col(c).cast("double"), [i / bins for i in range(1, bins)], accuracy).alias(c) for c in columns]
    found = rows.agg(*cuts).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def bin_of(column: str, edges: Sequence[float]) -> Column:
    """Number of the bin of a value: how many edges lie below it; a null is in the first."""
    below = F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < F.col(column).cast("double"))
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(below)).cast("tinyint")


def window_rows(features: DataFrame, edges: Mapping[str, Sequence[float]], steps: int, size: int = WINDOW_ROWS) -> DataFrame:
    """(region, ts, label, window): bins of the ``size`` rows before each row, oldest first, and the load ``steps`` after it.

    Every value becomes a byte before rows meet in windows, so a window of 96 x 13 values has 1,248 bytes instead of 9,984, and it is the only
    copy of them that is written. Rows without a whole window or without a label are left out.
    """
    small = features.select("region", "ts", "load", F.array(*[bin_of(c, e) for c, e in edges.items()]).alias("_b"))
    windowed = with_window_columns(
        small, ["region"], "ts", lambda w: {"window": F.collect_list("_b").over(w.rowsBetween(-size, -1))}, back=reach(size), days=7, full_width=True,
    ).filter(F.size("window") == size)
    ahead = features.select("region", (F.col("ts") - F.expr(f"INTERVAL {steps * STEP_MINUTES} MINUTES")).alias("ts"), F.col("load").alias("label"))
    return windowed.select("region", "ts", F.flatten("window").alias("window")).join(ahead, ["region", "ts"]).select("region", "ts", "label", "window")


def as_vector(window: str = "window") -> Column:
    return array_to_vector(F.col(window).cast("array<double>"))


def fit_windows(rows: DataFrame, algorithms: Sequence[str] = ("boosted", "forest", "linear"), label: str = "label", **settings) -> dict[str, Model]:
    """Members of :func:`models.members` fitted on staged :func:`window_rows`, with as many columns as a window has values.

    Vectors are made where a member reads them and not kept. Tree members keep a number for each value (5 kB a row of 1,248) for the time of
    their fit and split between bins, so they lose nothing by the binning; the linear member sums a matrix of columns x columns in each task (12 MB).
    """
    vectors = rows.select(as_vector().alias("features"), label)
    return {name: estimator.fit(vectors) for name, estimator in members(label, **settings).items() if name in algorithms}


def score_windows(rows: DataFrame, fitted: Mapping[str, Model], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Rows with ``point``, the mean of the members."""
    out = rows.withColumn("features", as_vector())
    for model in fitted.values():
        out = model.transform(out)
    return ensemble_mean(out, list(fitted), weights).drop("features", *[f"p_{m}" for m in fitted])
