"""Backtest reports as JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.functions.text import number_text, percent_text, summary_line
from loadspan.operators.backtest import backtest_overall, backtest_regions
from loadspan.sources.versions import new_version, remove, versions, write_version


def report_rows(weekly: DataFrame) -> DataFrame:
    """One row per region with its means and its weekly results nested; a region has a row per week."""
    week = F.struct("week", "mape", "mase", "train_size", "test_size")
    nested = weekly.groupBy("region").agg(F.array_sort(F.collect_list(week)).alias("weekly_results"))
    return backtest_regions(weekly).join(nested, "region")


#: What a reader waits for: the summary is written behind the regions.
MARK = "summary/_SUCCESS"


def write_backtest_report(weekly: DataFrame, path: str, weeks: int = 4, keep: int = 2) -> None:
    """A new version with both parts: ``regions`` has one JSON line per region, ``summary`` one line.

    The parts are published together: a version counts once its summary, written last, is finished. Older versions but the newest ``keep`` go.
    """
    spark, made = weekly.sparkSession, new_version(path)
    report_rows(weekly).write.json(f"{made}/regions")
    summary = backtest_overall(backtest_regions(weekly), weeks)
    summary.withColumn("backtest_date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.json(f"{made}/summary")
    remove(spark, versions(spark, path, MARK)[:-keep])


REGION_DDL = """region STRING, mape DOUBLE, mase DOUBLE, weeks_tested BIGINT,
weekly_results ARRAY<STRUCT<week: INT, mape: DOUBLE, mase: DOUBLE, train_size: BIGINT, test_size: BIGINT>>"""
SUMMARY_DDL = """overall_mape DOUBLE, overall_mase DOUBLE, regions_tested BIGINT, total_weeks INT, backtest_date STRING"""


def read_backtest_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Regions and summary of the newest finished report."""
    found = versions(spark, path, MARK)
    if not found:
        raise FileNotFoundError(f"no finished report in {path}")
    return spark.read.schema(REGION_DDL).json(f"{found[-1]}/regions"), spark.read.schema(SUMMARY_DDL).json(f"{found[-1]}/summary")


def summary_text(regions: DataFrame, overall: DataFrame) -> DataFrame:
    """Readable lines, numbered: the overall scores, then a line per region."""
    head = overall.select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.format_string("weeks per region: %d", "total_weeks").alias("line")),
        F.struct(F.lit(1).alias("part"), F.format_string("regions scored: %d", "regions_tested").alias("line")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit("mean percentage error: "), percent_text("overall_mape")).alias("line")),
        F.struct(F.lit(3).alias("part"), F.concat(F.lit("mean scaled error: "), number_text("overall_mase")).alias("line")),
    )).alias("l")).select("l.part", F.lit("").alias("region"), "l.line")
    body = regions.select(F.lit(4).alias("part"), "region", summary_line().alias("line"))
    return head.unionByName(body)


def write_summary_text(regions: DataFrame, overall: DataFrame, path: str) -> None:
    lines = summary_text(regions, overall).orderBy("part", "region").select("line")
    write_version(lines.coalesce(1), path, "text")
