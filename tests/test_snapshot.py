import json

import pytest
from pyspark.sql import functions as F

from loadspan.operators.anomaly import FINDING
from loadspan.sources import snapshot, versions

GOOD = {
    "schema_version": "1.2.0", "timestamp": "2024-01-01T00:00:00", "current_load": {"region_1": 1.5, "region_2": 3},
    "predictions": {"region_1": {"1h": 2.5, "24h": 1}},
    "intervals": {"region_1": {"1h": {"lower": 1, "upper": 2.5}, "6h": [1, 2]}},
    "forecast_paths": {"region_1": {"1h": [1, 2.5, 3e4]}},
    "interval_paths": {"region_1": {"1h": {"lower": [1], "upper": [2]}}},
    "feature_importances": {"region_1": {"1h": {"hour": 0.5}}},
    "anomalies": [{"region": "region_1", "severity": "high", "timestamp": "x"}], "weather": {"temperature": 1},
}


def changed(**parts):
    return {**GOOD, **parts}


CASES = {
    "good": (GOOD, []),
    "text forecast": (changed(predictions={"region_1": {"1h": "2.5"}}), [("not_a_number", "predictions.region_1.1h")]),
    "unknown horizon": (changed(predictions={"region_1": {"25h": 1}}), [("unknown_horizon", "predictions.region_1.25h")]),
    "horizon outside": (changed(predictions={"1h": {"region_1": 1}}), [("unknown_region", "predictions.1h"), ("unknown_horizon", "predictions.1h.region_1")]),
    "unknown region": (changed(current_load={"x": 1}), [("unknown_region", "current_load.x")]),
    "one bound": (changed(intervals={"region_1": {"1h": {"upper": 2}}}), [("missing_bound", "intervals.region_1.1h.lower")]),
    "one value": (changed(intervals={"region_1": {"1h": [1]}}), [("not_a_pair", "intervals.region_1.1h")]),
    "text in path": (changed(forecast_paths={"region_1": {"1h": [1, "q"]}}), [("not_numbers", "forecast_paths.region_1.1h")]),
    "no severity": (changed(anomalies=[{"region": "a", "timestamp": "x"}]), [("missing_finding_key", "anomalies.severity")]),
    "anomalies object": (changed(anomalies={}), [("not_an_array", "anomalies")]),
    "loads text": (changed(current_load="none"), [("not_an_object", "current_load")]),
    "weather text": (changed(weather={"humidity": "wet"}), [("not_a_number", "weather.humidity")]),
    "empty": ({}, [("missing_key", k) for k in snapshot.REQUIRED_KEYS]),
    "foreign": ({"kind": ["ledger", "v7"], "rows": 3}, [("missing_key", k) for k in snapshot.REQUIRED_KEYS]),
}


def test_validation(spark):
    rows = [(name, json.dumps(doc)) for name, (doc, _) in CASES.items()] + [("broken", '{"a":')]
    got = {}
    for r in snapshot.validate(spark.createDataFrame(rows, "doc_id string, body string")).collect():
        got.setdefault(r.doc_id, set()).add((r["rule"], r.path))
    for name, (_, want) in CASES.items():
        assert got.get(name, set()) == set(want), name
    assert ("not_json", "$") in got["broken"]


def parsed(spark, *docs):
    rows = spark.createDataFrame([(json.dumps(d),) for d in docs], "body string")
    return rows.select(F.from_json("body", snapshot.snapshot_schema()).alias("s")).select("s.*")


def test_migration_of_the_first_version(spark):
    got = snapshot.migrate(parsed(spark, {"schema_version": "1.0.0", "predictions": {}})).first()
    assert got.schema_version == "1.2.0" and got.forecast_paths == {} and got.interval_paths == {}
    assert got.weather.asDict() == {"temperature": 20.0, "humidity": 0.5, "solar_irradiance": 500.0}


def test_migration_keeps_what_is_there(spark):
    weather = {"temperature": 1.0, "humidity": 2.0, "solar_irradiance": 3.0}
    rows = snapshot.migrate(parsed(spark, {"schema_version": "1.1.0", "weather": weather}, {"schema_version": "1.2.0"}, {"predictions": {}})).collect()
    assert rows[0].weather.asDict() == weather and rows[0].forecast_paths is None
    assert rows[1].weather is None
    assert rows[2].schema_version == "1.2.0" and rows[2].forecast_paths == {}


def test_missing_file_and_broken_lines(spark, tmp_path):
    assert snapshot.read_snapshot(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "s").mkdir()
    wrong = changed(predictions={"region_1": {"1h": "much"}})
    lines = [changed(intervals={}), wrong, {"predictions": {}, "anomalies": []}]
    (tmp_path / "s" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    rows = {bool(r._corrupt_record): r for r in snapshot.read_snapshot(spark, str(tmp_path / "s")).orderBy(F.size("issues").desc()).collect()}
    broken = rows[True]
    assert broken._corrupt_record == "not json" and broken.schema_version is None and broken.weather is None and broken.forecast_paths is None
    assert ("not_json", "$") in {(i["rule"], i.path) for i in broken.issues}
    whole = snapshot.read_snapshot(spark, str(tmp_path / "s")).where("_corrupt_record IS NULL").collect()
    found = sorted(sorted((i["rule"], i.path) for i in r.issues) for r in whole)
    assert found[0] == [] and [("not_a_number", "predictions.region_1.1h")] in found
    assert all(r.schema_version == "1.2.0" for r in whole)
    assert not any(path == "schema_version" for issues in found for _, path in issues)


def inputs(spark, regions=2):
    names = [f"region_{i + 1}" for i in range(regions)]
    latest = spark.createDataFrame([(r, 5.0) for r in names], "region string, load double")
    steps = [(r, s, float(s), s - 1.0, s + 1.0) for r in names for s in range(1, 193)]
    forecast = spark.createDataFrame(steps, "region string, step int, point double, lower double, upper double")
    ddl = ", ".join(f"{n} {k}" for n, k in FINDING.items())
    row = {n: None for n in FINDING}
    found = [tuple({**row, "rule": "r", "region": r, "severity": "high"}.values()) for r in ("region_1", "TOTAL")]
    findings = spark.createDataFrame(found, ddl).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    weather = spark.createDataFrame([(1.0, 2.0, 3.0)], "temperature double, humidity double, solar_irradiance double")
    return latest, forecast, findings, weather


def test_write_and_read_back(spark, tmp_path):
    path = str(tmp_path / "snap")
    importances = spark.createDataFrame([("region_1", "1h", "hour", 0.5)], "region string, horizon string, feature string, importance double")
    snapshot.write_snapshot(snapshot.build_snapshot(*inputs(spark), importances), path)
    docs = snapshot.read_snapshot(spark, path).collect()
    by_region = {next(iter(d.current_load), "TOTAL"): d for d in docs}
    assert set(by_region) == {"region_1", "region_2", "TOTAL"} and not any(d.issues for d in docs)
    doc = by_region["region_1"]
    assert doc.schema_version == snapshot.SCHEMA_VERSION and doc.current_load == {"region_1": 5}
    assert by_region["region_2"].predictions["region_2"] == {"15min": 1, "1h": 4, "6h": 24, "12h": 48, "24h": 96, "48h": 192}
    assert doc.forecast_paths["region_1"]["1h"] == [1, 2, 3, 4]
    assert doc.interval_paths["region_1"]["1h"].upper == [2, 3, 4, 5]
    assert doc.intervals["region_1"]["15min"].lower == 0
    assert [a.region for a in doc.anomalies] == ["region_1"]
    assert [a.region for a in by_region["TOTAL"].anomalies] == ["TOTAL"] and by_region["TOTAL"].predictions == {}
    assert doc.feature_importances == {"region_1": {"1h": {"hour": 0.5}}}


@pytest.mark.parametrize("regions", [1, 30])
def test_a_document_for_each_region_however_many(spark, regions):
    docs = snapshot.build_snapshot(*inputs(spark, regions)).collect()
    assert len(docs) == regions + 1
    for d in docs:
        assert set(d.current_load) == set(d.predictions) == set(d.forecast_paths) and len(d.current_load) <= 1
    assert sum(a.region == "TOTAL" for d in docs for a in d.anomalies) == 1


def test_readers_see_the_newest_finished_version(spark, tmp_path):
    path = str(tmp_path / "v")
    for _ in range(3):
        snapshot.write_snapshot(snapshot.build_snapshot(*inputs(spark, 1)), path)
    kept = versions.versions(spark, path)
    assert len(kept) == 2
    torn = tmp_path / "v" / "version=99999999999999999999-x"
    torn.mkdir()
    (torn / "part.json").write_text("half")
    assert versions.newest(spark, path) == kept[-1]
    assert snapshot.read_snapshot(spark, path).where("_corrupt_record IS NOT NULL").count() == 0


def test_an_invalid_snapshot_is_not_written(spark, tmp_path):
    docs = snapshot.build_snapshot(*inputs(spark))
    with pytest.raises(ValueError, match="unknown_region"):
        snapshot.write_snapshot(docs, str(tmp_path / "bad"), region_pattern="^other$")
    assert snapshot.read_snapshot(spark, str(tmp_path / "bad")) is None
