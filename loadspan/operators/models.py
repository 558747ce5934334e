"""Model operators on MLlib: scaling, ensembles, conformal calibration, direct forecasts.

One pooled model serves all regions: the region enters as one-hot columns, so the number of fits
does not grow with the regions and one region with a third of the rows is trained by all tasks.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadspan.config import FEATURE_COLUMNS
from loadspan.operators.forecast import horizon_of, residual_quantile, with_horizons
from loadspan.operators.reshape import chrono_split
from loadspan.plans.skew import salted_join
from loadspan.session import shuffle_width

SEED = 42

# Width of the vector that hashed region names share.
HASHED_WIDTH = 1024

# Rows that a task of a fit passes over at least.
ROWS_A_TASK = 20_000

# Rows up to which members are fitted side by side. Each fit keeps its own binned copy of the rows, a forest about 500 bytes a row.
ROWS_SIDE_BY_SIDE = 2_000_000

log = logging.getLogger(__name__)


def min_sample_guard(rows: DataFrame, minimum: int = 200, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Rows of the series that have at least ``minimum`` samples."""
    keys = list(keys)
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select(*keys)
    return salted_join(rows, enough, keys, ["ts"], "left_semi")


def feature_select(features: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, name: str = "raw") -> DataFrame:
    """Ordered feature columns as one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(features)


def scaler(columns: Sequence[str] = FEATURE_COLUMNS) -> Pipeline:
    """Assemble and standardise; fit on training rows, apply to others."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
    ])


def members(label: str = "label", seed: int = SEED, rounds: int = 200, depth: int = 6, rate: float = 0.05,
            trees: int = 100) -> dict[str, object]:
    """The three regressors of the ensemble. A short run passes fewer ``rounds`` and ``trees``."""
    common = {"featuresCol": "features", "labelCol": label}
    return {
        "boosted": GBTRegressor(**common, predictionCol="p_boosted", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed),
        "forest": RandomForestRegressor(**common, predictionCol="p_forest", numTrees=trees, maxDepth=depth, seed=seed),
        "linear": LinearRegression(**common, predictionCol="p_linear", regParam=0.01),
    }


def preparation(columns: Sequence[str], regions: str | None = "one-hot") -> list:
    """Standardised features next to the region, one-hot or hashed into a fixed width."""
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
    ]
    inputs = ["scaled"]
    if regions == "one-hot":
        stages = [
            StringIndexer(inputCol="region", outputCol="region_index", handleInvalid="keep"),
            OneHotEncoder(inputCol="region_index", outputCol="region_hot", handleInvalid="keep"),
            *stages,
        ]
        inputs.append("region_hot")
    elif regions == "hashed":
        stages = [FeatureHasher(inputCols=["region"], outputCol="region_hot", numFeatures=HASHED_WIDTH), *stages]
        inputs.append("region_hot")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


class Ensemble:
    """Fitted members after one shared preparation; the forecast is their mean."""

    def __init__(self, prepared: PipelineModel, fitted: Mapping[str, Model], failed: Mapping[str, str] | None = None):
        self.prepared = prepared
        self.fitted = dict(fitted)
        self.failed = dict(failed or {})

    @property
    def region_labels(self) -> list[str]:
        """Names behind the one-hot columns, in their order."""
        return next((list(s.labels) for s in self.prepared.stages if hasattr(s, "labels")), [])

    def transform(self, rows: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
        out = self.prepared.transform(rows)
        for model in self.fitted.values():
            out = model.transform(out)
        return ensemble_mean(out, list(self.fitted), weights).drop(
            "region_index", "region_hot", "raw", "scaled", "features", *[f"p_{m}" for m in self.fitted]
        )


def member_weights(names: Sequence[str], weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Share of each member: equal unless weights are given, of which a member without one has 0.

    Weights of members that are not there (they failed, or were never asked for) are an error, as are weights that sum to 0.
    """
    if weights is None:
        return dict.fromkeys(names, 1.0 / len(names))
    if unknown := sorted(set(weights) - set(names)):
        raise ValueError(f"weights of members that are not fitted: {', '.join(unknown)}")
    total = sum(weights.values())
    if not total:
        raise ValueError("the weights sum to 0")
    return {n: weights.get(n, 0.0) / total for n in names}


def ensemble_mean(predicted: DataFrame, names: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Mean of the member columns ``p_<name>`` with the shares of :func:`member_weights`."""
    share = member_weights(names, weights)
    mean = sum((F.col(f"p_{n}") * share[n] for n in names if share[n]), F.lit(0.0))
    return predicted.withColumn("point", mean)


def fit_ensemble(train: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, label: str = "label",
                 algorithms: Sequence[str] = ("boosted", "forest", "linear"), regions: str | None = "one-hot",
                 **settings) -> Ensemble:
    """Fit the named members on the pooled rows, with ``settings`` of :func:`members`.

    ``regions`` is the encoding of the region, chosen by the caller: ``"one-hot"``, ``"hashed"`` into a fixed
    width for very many regions, or None. A member that fails is logged, named in ``failed`` and left out; none left is an error.

    Prepared rows are kept between the fits, spilling to disk, because each fit passes over them
    many times: a tree level is a job. Few rows are kept in few partitions, as such jobs are mostly the start of their tasks,
    and members are fitted side by side on them, as one fit's jobs leave tasks free between them.
    """
    prepared = Pipeline(stages=preparation(columns, regions)).fit(train)
    rows = prepared.transform(train).select("features", label)
    count = train.count()
    tasks = max(1, -(-count // ROWS_A_TASK))
    rows = (rows.coalesce(tasks) if tasks < shuffle_width(train.sparkSession) else rows).persist()
    fitted, failures = {}, {}
    wanted = {name: estimator for name, estimator in members(label, **settings).items() if name in algorithms}
    at_once = max(1, len(wanted)) if count <= ROWS_SIDE_BY_SIDE else 1
    try:
        with ThreadPoolExecutor(at_once) as pool:
            fit = inheritable_thread_target(train.sparkSession)
            fits = {name: pool.submit(fit(estimator.fit), rows) for name, estimator in wanted.items()}
        for name, run in fits.items():
            try:
                fitted[name] = run.result()
            except Exception as error:  # noqa: BLE001  one failing member must not lose the others
                failures[name] = f"{type(error).__name__}: {error}"
                log.error("ensemble member %s could not be fitted: %s", name, error)
    finally:
        rows.unpersist()
    if not fitted:
        raise RuntimeError(f"no member could be fitted: {failures}")
    return Ensemble(prepared, fitted, failures)


def next_step_rows(features: DataFrame, steps: int = 1) -> DataFrame:
    """Features with the load ``steps`` ahead as label, found by its time; rows without one are dropped."""
    target = features.select("region", (F.col("ts") - F.expr(f"INTERVAL {steps * 15} MINUTES")).alias("ts"), F.col("load").alias("label"))
    return features.join(target, ["region", "ts"])


def direct_rows(features: DataFrame) -> DataFrame:
    """One row per horizon with the load that many steps ahead as label and ``steps`` as a feature.

    Each load goes to the rows it is the label of, as few narrow columns; the labels of a row are gathered and joined to its
    features once, and only the joined rows are multiplied.
    """
    origin = F.col("ts") - F.make_dt_interval(mins=F.col("steps") * F.col("cadence_minutes"))
    label = F.struct("horizon", "steps", "cadence_minutes", F.col("ts").alias("target_ts"), F.col("load").alias("label"))
    labels = with_horizons(features.select("region", "ts", "load")).select("region", origin.alias("ts"), label.alias("_l"))
    gathered = labels.groupBy("region", "ts").agg(F.collect_list("_l").alias("_labels"))
    joined = features.join(gathered, ["region", "ts"])
    return joined.select(*features.columns, F.explode("_labels").alias("_l")).select(*features.columns, "_l.*")


def direct_scoring_rows(features: DataFrame, steps: int = 192) -> DataFrame:
    """The newest feature row of each region, once for each step ahead, with the horizon the step falls in."""
    newest = features.groupBy("region").agg(F.max_by(F.struct(*[c for c in features.columns if c != "region"]), "ts").alias("_r"))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("steps")
    return newest.select("region", "_r.*", ahead).withColumn("horizon", horizon_of("steps"))


def conformal_calibrate(residuals: DataFrame, level: float = 0.95, share: float = 0.9,
                        keys: Sequence[str] = ("region",)) -> DataFrame:
    """Quantile of absolute errors over the last tenth of each series."""
    last = chrono_split(residuals, share, share, keys).filter(F.col("part") == "test")
    return residual_quantile(last, level, keys).withColumn("alpha", F.lit(round(1 - level, 6)))


def feature_importance(ensemble: Ensemble, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Importance of each feature in the tree members, averaged over them.

    The vector of importances is as long as the feature vector, whatever the rows.
    """
    spark = scored.sparkSession
    labels = ensemble.region_labels
    trees = [m for m in ensemble.fitted.values() if hasattr(m, "featureImportances")]
    if not trees:
        raise ValueError("no tree member has importances")
    size = trees[0].featureImportances.size
    names = [*columns, *[f"region={labels[i]}" if i < len(labels) else f"region#{i}" for i in range(size - len(columns))]]
    mean = [float(sum(t.featureImportances[i] for t in trees) / len(trees)) for i in range(size)]
    return spark.createDataFrame(list(zip(names, mean)), "feature string, importance double")


def top_importances(importances: DataFrame, n: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest importances per group; ties go by name. A group is one model's features."""
    order = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
