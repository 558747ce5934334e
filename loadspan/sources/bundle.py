"""A stored forecaster as one unit: members, preparation, quantiles, importances and a manifest that is written last."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from loadspan.operators.models import Ensemble
from loadspan.sources.versions import _folder, new_version, remove, versions

MANIFEST = "manifest"


@dataclass
class Forecaster:
    """What a forecast needs: the ensemble, the columns it was fitted on, error quantiles, importances and free remarks."""

    ensemble: Ensemble
    columns: list[str]
    quantiles: DataFrame | None = None
    importances: DataFrame | None = None
    remarks: dict[str, str] = field(default_factory=dict)


def save(forecaster: Forecaster, spark: SparkSession, path: str, keep: int = 2) -> str:
    """Write all parts into a new version folder, the manifest last; then remove all finished versions but the newest ``keep``.

    Readers take the newest version that has a manifest, so a writer that dies between the parts leaves the version before.
    """
    made = new_version(path)
    ensemble = forecaster.ensemble
    ensemble.prepared.write().save(f"{made}/preparation")
    names = list(ensemble.fitted)
    PipelineModel([ensemble.fitted[n] for n in names]).write().save(f"{made}/members")
    tables = {"quantiles": forecaster.quantiles, "importances": forecaster.importances}
    for name, table in tables.items():
        if table is not None:
            table.write.parquet(f"{made}/{name}")
    manifest = {
        "members": names, "failed": ensemble.failed, "labels": ensemble.region_labels, "columns": list(forecaster.columns),
        "tables": {n: t.schema.json() for n, t in tables.items() if t is not None}, "remarks": forecaster.remarks,
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{made}/{MANIFEST}")
    remove(spark, finished(spark, path)[:-keep])
    return made


def finished(spark: SparkSession, path: str) -> list[str]:
    """Paths of the versions that have a manifest, oldest first."""
    return versions(spark, path, f"{MANIFEST}/_SUCCESS")


def load(spark: SparkSession, path: str) -> Forecaster:
    """The newest finished version of a stored forecaster."""
    from pyspark.sql.types import StructType

    found = finished(spark, path)
    if not found:
        raise FileNotFoundError(f"no finished version in {path}")
    made = found[-1]
    manifest = json.loads(spark.read.text(f"{made}/{MANIFEST}").first().value)
    members = PipelineModel.load(f"{made}/members").stages
    ensemble = Ensemble(
        PipelineModel.load(f"{made}/preparation"), dict(zip(manifest["members"], members, strict=True)), manifest["failed"],
    )
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{made}/{n}") for n, s in manifest["tables"].items()}
    return Forecaster(ensemble, manifest["columns"], tables.get("quantiles"), tables.get("importances"), manifest["remarks"])


def parts(spark: SparkSession, version: str) -> Sequence[str]:
    """Names of the parts that a version has, finished or not."""
    files, place = _folder(spark, version)
    return sorted(s.getPath().getName() for s in files.listStatus(place))
