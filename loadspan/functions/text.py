"""Formatted texts of measures; undefined ones read N/A."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadspan.functions.time import as_col


def number_text(value: str | Column, places: int = 3) -> Column:
    col = as_col(value)
    return F.when(col.isNull() | F.isnan(col), "N/A").otherwise(F.format_string(f"%.{places}f", col))


def percent_text(value: str | Column, places: int = 1) -> Column:
    col = as_col(value)
    return F.when(col.isNull() | F.isnan(col), "N/A").otherwise(F.format_string(f"%.{places}f%%", col))


def right(text: Column, width: int) -> Column:
    """Right-aligned; longer texts are kept whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def summary_line() -> Column:
    """One line of the backtest summary from ``region, mape, mase, weeks_tested``."""
    return F.format_string(
        "  %s: MAPE=%s, MASE=%s, Weeks=%d",
        F.col("region"), right(percent_text("mape"), 6), right(number_text("mase"), 6), F.col("weeks_tested"),
    )


def metric_text(value: str | Column, unit: str, places: int = 1) -> Column:
    """A measure with its unit, as shown on a status board."""
    return F.concat(number_text(value, places), F.lit(f" {unit}"))
