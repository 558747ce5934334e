"""Fitted ensembles rolled forward: trees as flat arrays, evaluated step by step for many regions at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import FeatureHasher, OneHotEncoderModel, StandardScalerModel, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.config import CALENDAR_COLUMNS, LAG_STEPS
from loadspan.functions.time import calendar, steps_after
from loadspan.operators.models import Ensemble, member_weights
from loadspan.sources.stage import staging

#: Rows for which all trees are walked at a time; bounds memory at rows x trees numbers.
WALKED = 2048


@dataclass
class Trees:
    """Nodes of all trees of a member, one after the other. A leaf has feature -1; ``left`` is taken up to the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def predict(self, x: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Weighted sum of the leaves that rows end in. Features beyond the columns of ``x`` are 1 at place ``hot`` and 0 elsewhere."""
        return np.concatenate([np.zeros(0), *(self._walk(x[i:i + WALKED], hot[i:i + WALKED]) for i in range(0, len(x), WALKED))])

    def _walk(self, x: np.ndarray, hot: np.ndarray) -> np.ndarray:
        wide, rows = x.shape[1], np.arange(len(x))[:, None]
        node = np.tile(self.roots, (len(x), 1))
        for _ in range(self.depth):
            feature = self.feature[node]
            known = x[rows, np.clip(feature, 0, wide - 1)]
            value = np.where(feature < wide, known, hot[:, None] == feature - wide)
            after = np.where(value <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(feature < 0, node, after)
        return self.value[node] @ self.weights


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray, hot: np.ndarray) -> np.ndarray:
        rest = np.append(self.weights[x.shape[1]:], 0.0)
        place = np.where((hot >= 0) & (hot < len(rest) - 1), hot, len(rest) - 1)
        return x @ self.weights[:x.shape[1]] + rest[place] + self.intercept


@dataclass
class FlatEnsemble:
    """Scaling and members of an ensemble as arrays; its size depends on the members, not on rows."""

    mean: np.ndarray
    scale: np.ndarray
    members: dict[str, Trees | Linear] = field(default_factory=dict)

    def predict(self, raw: np.ndarray, hot: np.ndarray, weights: Mapping[str, float] | None = None) -> np.ndarray:
        x = (raw - self.mean) * self.scale
        share = member_weights(list(self.members), weights)
        return sum(m.predict(x, hot) * share[name] for name, m in self.members.items())


def flat_trees(nodes: DataFrame, weights: Sequence[float]) -> Trees:
    """Trees from the table that a model saves; the driver gets a row for each node, as many as the settings allow."""
    rows = nodes.select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("cut"), "nodeData.split.numCategories",
    ).orderBy("treeID", "id").collect()
    place = {(r.treeID, r.id): i for i, r in enumerate(rows)}
    feature, threshold = np.full(len(rows), -1), np.zeros(len(rows))
    left, right = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    level = np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        if r.leftChild < 0:
            continue
        feature[i], left[i], right[i] = r.featureIndex, place[r.treeID, r.leftChild], place[r.treeID, r.rightChild]
        level[left[i]] = level[right[i]] = level[i] + 1
        if r.numCategories < 0:
            threshold[i] = r.cut[0]
        elif set(r.cut) == {0.0}:
            threshold[i] = 0.5
        elif set(r.cut) == {1.0}:
            threshold[i], left[i], right[i] = 0.5, right[i], left[i]
        else:
            raise ValueError("only columns of 0 and 1 can be categories")
    roots = np.array([place[t, 0] for t in sorted({r.treeID for r in rows})])
    return Trees(feature, threshold, left, right, np.array([r.prediction for r in rows]), roots, np.array(weights, float), int(level.max(initial=0)))


def flatten(ensemble: Ensemble, rows: DataFrame) -> FlatEnsemble:
    """The ensemble as arrays, its trees read from what MLlib saves; ``rows`` gives the session."""
    scaler = next(s for s in ensemble.prepared.stages if isinstance(s, StandardScalerModel))
    std = scaler.std.toArray()
    flat = FlatEnsemble(scaler.mean.toArray(), np.divide(1.0, std, out=np.zeros_like(std), where=std > 0))
    spark = rows.sparkSession
    for name, model in ensemble.fitted.items():
        if not hasattr(model, "treeWeights"):
            flat.members[name] = Linear(model.coefficients.toArray(), float(model.intercept))
            continue
        weights = list(model.treeWeights)
        if type(model).__name__.startswith("RandomForest"):
            weights = [w / sum(weights) for w in weights]
        with staging("trees") as keep:
            path = keep.folder(spark)
            model.write().save(path)
            flat.members[name] = flat_trees(spark.read.parquet(f"{path}/data"), weights)
    return flat


def region_place(ensemble: Ensemble, rows: DataFrame) -> DataFrame:
    """Adds ``hot``: the place of the region among the columns that encode it, -1 if it has none."""
    encoded = rows
    for stage in ensemble.prepared.stages:
        if isinstance(stage, (StringIndexerModel, OneHotEncoderModel, FeatureHasher)):
            encoded = stage.transform(encoded)
    if "region_hot" not in encoded.columns:
        return rows.withColumn("hot", F.lit(-1))
    place = F.array_position(vector_to_array("region_hot"), F.lit(1.0)) - 1
    return encoded.withColumn("hot", place.cast("int")).select(*rows.columns, "hot")


def roll_states(series: DataFrame, held: Sequence[str], steps: int, depth: int) -> DataFrame:
    """(region, end, loads, held, days): what a roll needs of each region, however long its history.

    The last ``depth`` + 1 loads, the newest values of the columns that are held, and the calendar of each step's start.
    """
    newest = series.agg(F.max("ts").alias("v")).scalar()
    tail = series.filter(F.col("ts") >= steps_after(newest, -depth))
    now = [F.max_by(c, "ts").cast("double").alias(c) for c in held]
    state = tail.groupBy("region").agg(
        F.array_sort(F.collect_list(F.struct("ts", "load")))["load"].alias("loads"), F.max("ts").alias("end"), *now,
    ).filter(F.size("loads") == depth + 1)
    at = lambda i: F.struct(*[v.cast("double").alias(k) for k, v in calendar(steps_after("end", i)).items()])
    days = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), at)
    flat = F.flatten(F.transform(days, lambda d: F.array(*[d[c] for c in CALENDAR_COLUMNS])))
    return state.select("region", "end", "loads", F.array(*[F.col(c) for c in held]).cast("array<double>").alias("held"), flat.alias("days"))


def roll_forward(series: DataFrame, ensemble: Ensemble, columns: Sequence[str], steps: int = 192, weights: Mapping[str, float] | None = None,
                 lags: Mapping[str, int] = LAG_STEPS) -> DataFrame:
    """(region, step, ts, point): a fitted next-step ensemble rolled ``steps`` ahead, each prediction fed back.

    ``columns`` are those the ensemble was fitted on: calendar columns, lags, ``load``, and others, which keep their newest value. A region
    needs the longest lag of history without gaps and a newest row at the end of the table; others get no rows.
    All regions of a batch are rolled together, step by step; the state of a region is its last ``max(lags)`` + 1 loads, so a
    task's memory is that of a batch. Members are sent as arrays whose size is set by the fit.
    """
    held = [c for c in columns if c not in CALENDAR_COLUMNS and c not in lags and c != "load"]
    depth = max(lags.values())
    states = region_place(ensemble, roll_states(series, held, steps, depth))
    flat = flatten(ensemble, series)
    order = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            past = np.array(batch.column("loads").to_pylist(), float).reshape(n, depth + 1)
            still = np.array(batch.column("held").to_pylist(), float).reshape(n, len(held))
            days = np.array(batch.column("days").to_pylist(), float).reshape(n, steps, len(CALENDAR_COLUMNS))
            hot = batch.column("hot").to_numpy()
            loads = np.concatenate([past, np.zeros((n, steps))], axis=1)
            for step in range(steps):
                at = depth + step
                known = dict(zip(held, still.T)) | dict(zip(CALENDAR_COLUMNS, days[:, step].T)) | {"load": loads[:, at]}
                known |= {name: loads[:, at - back] for name, back in lags.items()}
                loads[:, at + 1] = flat.predict(np.column_stack([known[c] for c in order]), hot, weights)
            whole = np.isfinite(loads).all(1) & np.isfinite(still).all(1)
            kept = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column("region").take(pa.array(np.repeat(kept, steps))), batch.column("end").take(pa.array(np.repeat(kept, steps))),
                 pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(kept))), pa.array(loads[kept, depth + 1:].ravel())],
                names=["region", "end", "step", "point"],
            )

    rolled = states.mapInArrow(run, "region string, end timestamp_ntz, step int, point double")
    return rolled.select("region", "step", steps_after("end", F.col("step")).alias("ts"), "point")
