"""Versioned JSON snapshots: schema, assembly, writing, reading, migration, validation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadspan.config import HORIZON_STEPS
from loadspan.operators.anomaly import FINDING
from loadspan.operators.forecast import map_by, nest_long, path_arrays
from loadspan.sources.stage import staging
from loadspan.sources.versions import newest, write_version

# Fixed values of the document format: its version, region names, keys and key types.
SCHEMA_VERSION = "1.2.0"
REGION_PATTERN = "^region_[0-9]+$"
TOTAL = "TOTAL"

# Keys every document must have, and the weather given to documents from before 1.2.0.
REQUIRED_KEYS = ["schema_version", "timestamp", "current_load", "predictions", "intervals", "anomalies"]
MIGRATION_WEATHER = {"temperature": 20.0, "humidity": 0.5, "solar_irradiance": 500.0}

_FINDING_TYPE = "STRUCT<" + ", ".join(
    f"{name}: {'STRING' if kind == 'timestamp_ntz' else kind}" for name, kind in FINDING.items()
) + ">"

# Key names and types.
SNAPSHOT_DDL = f"""
schema_version STRING, timestamp STRING,
current_load MAP<STRING, DOUBLE>,
predictions MAP<STRING, MAP<STRING, DOUBLE>>,
intervals MAP<STRING, MAP<STRING, STRUCT<lower: DOUBLE, upper: DOUBLE>>>,
forecast_paths MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>,
interval_paths MAP<STRING, MAP<STRING, STRUCT<lower: ARRAY<DOUBLE>, upper: ARRAY<DOUBLE>>>>,
feature_importances MAP<STRING, MAP<STRING, MAP<STRING, DOUBLE>>>,
anomalies ARRAY<{_FINDING_TYPE}>,
weather STRUCT<temperature: DOUBLE, humidity: DOUBLE, solar_irradiance: DOUBLE>
"""


def snapshot_schema(corrupt: bool = False) -> T.StructType:
    schema = T.StructType.fromDDL(SNAPSHOT_DDL)
    return schema.add("_corrupt_record", "string") if corrupt else schema


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def json_shape(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as JSON text with timestamps in ISO form; arrays and maps nest as they are."""
    kinds = dict(df.dtypes)
    fields = [
        iso(F.col(c)).alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in columns or df.columns
    ]
    return F.to_json(F.struct(*fields))


def build_snapshot(
    latest: DataFrame,
    forecast: DataFrame,
    findings: DataFrame,
    weather: DataFrame,
    importances: DataFrame | None = None,
    timestamp: Column | None = None,
) -> DataFrame:
    """Snapshot documents in the current schema: one for each region and one for the total.

    ``latest`` (region, load), ``forecast`` (region, step, point, lower, upper), ``findings`` in the
    schema of the rules, ``weather`` one row of means, ``importances`` (region, horizon, feature,
    importance). A document holds the paths, importances and findings of its region, so its size does not depend on
    how many regions there are. The document of the total has the findings on it and no paths.
    """
    # one row per region and horizon holds its path, whose last step is the anchor
    arrays = path_arrays(forecast, ["point", "lower", "upper"])
    last = {n: F.element_at(n, -1) for n in ("point", "lower", "upper")}
    paths = arrays.groupBy("region").agg(
        map_by("horizon", last["point"]).alias("predictions"),
        map_by("horizon", F.struct(last["lower"].alias("lower"), last["upper"].alias("upper"))).alias("intervals"),
        map_by("horizon", F.col("point")).alias("forecast_paths"),
        map_by("horizon", F.struct("lower", "upper")).alias("interval_paths"),
    )
    nested = ["current_load", "predictions", "intervals", "forecast_paths", "interval_paths"]
    parts = latest.select("region", F.col("load").alias("current_load")).join(paths, "region", "left")
    if importances is not None:
        per_horizon = importances.groupBy("region", "horizon").agg(
            map_by("feature", F.col("importance")).alias("_f")
        )
        parts = parts.join(
            nest_long(per_horizon, F.col("_f")).withColumnRenamed("map", "feature_importances"), "region", "left"
        )
        nested.append("feature_importances")

    kinds = {f.name: f.dataType for f in snapshot_schema()}
    empty = {n: F.create_map().cast(kinds[n]) for n in [*nested, "feature_importances"]}

    def alone(name: str) -> Column:
        return F.when(F.col(name).isNull(), empty[name]).otherwise(F.create_map("region", name).cast(kinds[name]))

    documents = parts.select("region", *[alone(n).alias(n) for n in nested])
    total = latest.sparkSession.range(1).select(F.lit(TOTAL).alias("region"), *[empty[n].alias(n) for n in nested])
    found = findings.withColumn("ts", iso(F.col("ts"))).select("region", F.struct(*FINDING).alias("_a"))
    listed = found.groupBy("region").agg(F.array_sort(F.collect_list("_a")).alias("anomalies"))
    means = [weather.select(n).scalar().alias(n) for n in ("temperature", "humidity", "solar_irradiance")]
    out = documents.unionByName(total).join(listed, "region", "left").withColumns({
        "weather": F.struct(*means),
        "anomalies": F.coalesce("anomalies", F.array().cast(f"array<{_FINDING_TYPE}>")),
    })
    if importances is None:
        out = out.withColumn("feature_importances", empty["feature_importances"])
    return stamp(out.drop("region"), timestamp)


def stamp(documents: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Set schema version and time of writing; columns in schema order."""
    when = iso(timestamp if timestamp is not None else F.current_timestamp())
    stamped = documents.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "timestamp": when})
    return stamped.select([F.col(f.name).cast(f.dataType) for f in snapshot_schema()])


def write_snapshot(documents: DataFrame, path: str, region_pattern: str = REGION_PATTERN) -> None:
    """Validate and write JSON lines as a new version below ``path``; a reader sees the version before or this one.

    Documents are computed once, into the shared folder, and checked there. Raises ``ValueError`` on violations, before anything is
    written.
    """
    with staging("snapshot") as keep:
        documents = keep(documents)
        texts = documents.select(F.to_json(F.struct(*documents.columns)).alias("body"))
        bad = validate(texts.withColumn("doc_id", F.lit("snapshot")), region_pattern).limit(5).collect()
        if bad:
            raise ValueError(f"snapshot breaks its schema: {[(r.rule, r.path) for r in bad]}")
        write_version(documents, path)


def read_snapshot(spark: SparkSession, path: str, multiline: bool = False, region_pattern: str = REGION_PATTERN) -> DataFrame | None:
    """Migrated documents with their ``issues``, or None where the path does not exist.

    Below ``path`` the newest finished version is read, or the files themselves where there are no versions. A line that is no document keeps
    its text in ``_corrupt_record``; it is not migrated, so it gets no version and no defaults. Documents that break the schema keep
    what could be read and carry their issues; whoever uses them decides. With ``multiline`` each file is one document.
    """
    try:
        lines = spark.read.option("wholetext", multiline).text(newest(spark, path) or path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    checked = with_issues(lines.where(F.trim("value") != "").select(F.col("value").alias("body")), region_pattern)
    broken = F.try_parse_json("body").isNull()
    parsed = F.from_json("body", snapshot_schema(), {"mode": "PERMISSIVE"})
    # a missing version is what migration repairs
    left = F.filter("issues", lambda i: ~((i["rule"] == "missing_key") & (i["path"] == "schema_version")))
    documents = checked.select(parsed.alias("_d"), F.when(broken, F.col("body")).alias("_corrupt_record"), left.alias("issues"))
    return migrate(documents.select("_d.*", "_corrupt_record", "issues"))


def migrate(documents: DataFrame) -> DataFrame:
    """Bring documents to the current version, one version after the other.

    1.0.0, or no version, gets empty path maps and becomes 1.1.0; 1.1.0 gets default weather and
    becomes 1.2.0. Other versions, and rows that are no documents (``_corrupt_record``), stay as they are.
    """
    whole = F.col("_corrupt_record").isNull() if "_corrupt_record" in documents.columns else F.lit(True)
    kinds = {f.name: f.dataType for f in snapshot_schema()}
    version = F.coalesce("schema_version", F.lit("1.0.0"))
    first, second = whole & (version == "1.0.0"), whole & version.isin("1.0.0", "1.1.0")

    def or_empty(name: str) -> Column:
        empty = F.create_map().cast(kinds[name])
        return F.when(first & F.col(name).isNull(), empty).otherwise(F.col(name))

    default = F.struct(*[F.lit(v).alias(n) for n, v in MIGRATION_WEATHER.items()])
    return documents.select([
        {
            "forecast_paths": or_empty("forecast_paths"),
            "interval_paths": or_empty("interval_paths"),
            "weather": F.when(second & F.col("weather").isNull(), default).otherwise(F.col("weather")),
            "schema_version": F.when(second, SCHEMA_VERSION).otherwise(F.col("schema_version")),
        }.get(c, F.col(c)).alias(c)
        for c in documents.columns
    ])


NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
HORIZON_PATTERN = "^(" + "|".join(HORIZON_STEPS) + ")$"


def validate(documents: DataFrame, region_pattern: str = REGION_PATTERN) -> DataFrame:
    """Violations ``(doc_id, rule, path)`` of a column of JSON texts ``body``; none for valid documents."""
    found = with_issues(documents.select("doc_id", "body"), region_pattern)
    return found.select("doc_id", F.explode("issues").alias("i")).select("doc_id", "i.rule", "i.path")


def with_issues(documents: DataFrame, region_pattern: str = REGION_PATTERN) -> DataFrame:
    """Documents with an array ``issues`` of the violations (rule, path) of their JSON text ``body``.

    Checks required keys, types, region and horizon names, numbers, and that intervals have both
    bounds. Unknown names are violations.
    """
    doc = documents.withColumn("v", F.try_parse_json("body"))

    def part(path: str, kind: str) -> Column:
        return F.try_variant_get("v", path, kind)

    def kind_of(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))

    def issue(rule: str, path: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), path.alias("path"))

    none = F.array().cast("array<struct<rule: string, path: string>>")

    def when(condition: Column, rule: str, path: Column) -> Column:
        return F.when(condition, F.array(issue(rule, path))).otherwise(none)

    def members(value: Column) -> Column:
        """Entries of an object, none for anything else."""
        return F.coalesce(F.map_entries(value), F.array().cast("array<struct<key: string, value: variant>>"))

    def object_of(value: Column) -> Column:
        return F.when(kind_of(value).startswith("OBJECT"), value).try_cast("map<string, variant>")

    def checked(entries: Column, prefix: Column, pattern: str, rule: str, inner) -> Column:
        """Name check of each entry, then ``inner(value, path)``."""
        def one(e: Column) -> Column:
            path = F.concat(prefix, F.lit("."), e["key"])
            return F.concat(when(~e["key"].rlike(pattern), rule, path), inner(e["value"], path))

        return F.flatten(F.transform(entries, one))

    def number(value: Column, path: Column) -> Column:
        return when(~kind_of(value).rlike(NUMBER), "not_a_number", path)

    def numbers(value: Column, path: Column) -> Column:
        items = value.try_cast("array<variant>")
        bad = F.exists(items, lambda x: ~kind_of(x).rlike(NUMBER))
        return when(items.isNull() | F.coalesce(bad, F.lit(False)), "not_numbers", path)

    def both_bounds(check):
        def inner(value: Column, path: Column) -> Column:
            fields = object_of(value)
            parts = [
                F.when(F.try_element_at(fields, F.lit(b)).isNull(), F.array(issue("missing_bound", F.concat(path, F.lit(f".{b}")))))
                .otherwise(check(F.try_element_at(fields, F.lit(b)), F.concat(path, F.lit(f".{b}"))))
                for b in ("lower", "upper")
            ]
            pair = value.try_cast("array<variant>")
            as_pair = F.concat(numbers(value, path), when(F.size(pair) != 2, "not_a_pair", path))
            return F.when(pair.isNotNull(), as_pair).otherwise(F.concat(*parts))

        return inner

    def regions_of(key: str, inner) -> Column:
        def horizons(value: Column, path: Column) -> Column:
            return F.concat(
                when(~kind_of(value).startswith("OBJECT"), "not_an_object", path),
                checked(members(object_of(value)), path, HORIZON_PATTERN, "unknown_horizon", inner),
            )

        return checked(members(part(f"$.{key}", "map<string, variant>")), F.lit(key), region_pattern, "unknown_region", horizons)

    def features(value: Column, path: Column) -> Column:
        return checked(members(object_of(value)), path, "^.+$", "unnamed_feature", number)

    required = F.concat(*[
        when(part(f"$.{k}", "variant").isNull(), "missing_key", F.lit(k)) for k in REQUIRED_KEYS
    ])
    texts = F.concat(*[
        when(part(f"$.{k}", "variant").isNotNull() & (kind_of(part(f"$.{k}", "variant")) != "STRING"), "not_a_text", F.lit(k))
        for k in ("schema_version", "timestamp")
    ])
    findings = F.coalesce(part("$.anomalies", "array<map<string, variant>>"), F.array().cast("array<map<string, variant>>"))
    finding_keys = F.flatten(F.transform(findings, lambda a: F.concat(*[
        when(F.try_element_at(a, F.lit(k)).isNull(), "missing_finding_key", F.lit(f"anomalies.{k}")) for k in ("region", "severity")
    ], when(
        F.try_element_at(a, F.lit("ts")).isNull() & F.try_element_at(a, F.lit("timestamp")).isNull(),
        "missing_finding_key", F.lit("anomalies.timestamp"),
    ))))
    weather = F.concat(*[
        F.when(part(f"$.weather.{k}", "variant").isNotNull(), number(part(f"$.weather.{k}", "variant"), F.lit(f"weather.{k}")))
        .otherwise(none)
        for k in MIGRATION_WEATHER
    ])
    def shape(key: str, kind: str, rule: str) -> Column:
        value = part(f"$.{key}", "variant")
        return when(value.isNotNull() & ~kind_of(value).startswith(kind), rule, F.lit(key))

    objects = ["current_load", "predictions", "intervals", "forecast_paths", "interval_paths", "feature_importances", "weather"]
    issues = F.concat(
        when(F.col("v").isNull(), "not_json", F.lit("$")),
        required, texts, shape("anomalies", "ARRAY", "not_an_array"),
        *[shape(k, "OBJECT", "not_an_object") for k in objects],
        checked(members(part("$.current_load", "map<string, variant>")), F.lit("current_load"), region_pattern, "unknown_region", number),
        regions_of("predictions", number),
        regions_of("intervals", both_bounds(number)),
        regions_of("forecast_paths", numbers),
        regions_of("interval_paths", both_bounds(numbers)),
        regions_of("feature_importances", features),
        finding_keys, weather,
    )
    return doc.withColumn("issues", issues).drop("v")

