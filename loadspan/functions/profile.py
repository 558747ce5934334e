"""Deterministic shape functions of load and weather over the time of day and of the year."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.functions.time import as_col

YEAR = 365.25

# Latitude in degrees, base temperature and peak hours of the canonical regions.
REGION_PROFILE = [
    ("region_1", 40.7, 18.0, [8, 9, 18, 19, 20]),
    ("region_2", 35.2, 16.0, [7, 8, 17, 18, 19]),
    ("region_3", 45.0, 19.0, [6, 7, 8, 14, 15, 22, 23]),
    ("region_4", 30.5, 14.0, [5, 6, 18, 19]),
    ("region_5", 32.0, 20.0, [10, 11, 12, 13, 14]),
    ("region_6", 38.5, 8.0, [11, 12, 13, 17, 18]),
    ("region_7", 34.1, 25.0, [10, 11, 12, 13, 14, 15]),
    ("region_8", 41.0, 17.0, [9, 10, 11, 14, 15, 16]),
]
DEFAULT_LATITUDE = 37.0
DEFAULT_TEMPERATURE = 15.0


def with_region_profile(df: DataFrame) -> DataFrame:
    """Add latitude, base temperature and peak hours; unknown regions get the defaults.

    The profile is one map literal of 8 entries, so no join runs.
    """
    entries = F.create_map(*[
        part
        for name, latitude, temperature, hours in REGION_PROFILE
        for part in (
            F.lit(name),
            F.struct(
                F.lit(latitude).alias("latitude"), F.lit(temperature).alias("base_temperature"),
                F.array(*[F.lit(h) for h in hours]).alias("peak_hours"),
            ),
        )
    ])
    found = F.try_element_at(entries, F.col("region"))
    return df.withColumns({
        "latitude": F.coalesce(found["latitude"], F.lit(DEFAULT_LATITUDE)),
        "base_temperature": F.coalesce(found["base_temperature"], F.lit(DEFAULT_TEMPERATURE)),
        "peak_hours": F.coalesce(found["peak_hours"], F.array().cast("array<int>")),
    })


def fractional_hour(ts: str | Column) -> Column:
    ts = as_col(ts)
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def wave(value: Column, period: float, shift: float = 0.0, phase: float = 0.0) -> Column:
    """Sine of ``value + shift`` over one period."""
    return F.sin((value + shift) * (2 * math.pi / period) + phase)


def harmonic_features(ts: str | Column) -> dict[str, Column]:
    """Fractional hour, one to three cycles a day, one cycle a year."""
    hour = fractional_hour(ts)
    return {
        "fractional_hour": hour,
        "daily_1": wave(hour, 24),
        "daily_2": wave(hour, 12),
        "daily_3": wave(hour, 8),
        "yearly": wave(F.dayofyear(as_col(ts)), YEAR),
    }


def hour_distance(hour: Column, peak: Column) -> Column:
    """Distance on the 24-hour circle."""
    apart = F.abs(hour - peak)
    return F.least(apart, 24 - apart)


def peak_hour_proximity(ts: str | Column, peak_hours: str | Column) -> Column:
    """Sum over peak hours of 0.15 exp(-d^2 / 0.5)."""
    hour = fractional_hour(ts)

    def add(total: Column, peak: Column) -> Column:
        d = hour_distance(hour, peak)
        return total + F.exp(-(d * d) / 0.5) * 0.15

    return F.aggregate(as_col(peak_hours), F.lit(0.0), add)


def weekly_factor(ts: str | Column) -> Column:
    return F.when(F.weekday(as_col(ts)) >= 5, -0.1).otherwise(0.05)


def phase_shifted_season(ts: str | Column) -> dict[str, Column]:
    """Yearly wave an eighth ahead, and the yearly and daily parts of temperature."""
    day = F.dayofyear(as_col(ts))
    return {
        "season": wave(day, YEAR, phase=math.pi / 4),
        "yearly_temperature": wave(day, YEAR, shift=-80) * 12,
        "daily_temperature": wave(fractional_hour(ts), 24, shift=-6) * 8,
    }


def temperature_curve(ts: str | Column, base: str | Column) -> Column:
    parts = phase_shifted_season(ts)
    return as_col(base) + parts["yearly_temperature"] + parts["daily_temperature"]


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if high is not None:
        value = F.least(value, F.lit(high))
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value


def clear_sky_irradiance(ts: str | Column, latitude: str | Column, clearness: float = 1.0) -> Column:
    """Irradiance without clouds from latitude, day and hour, between 0 and 1100 W/m2."""
    day, hour = F.dayofyear(as_col(ts)), fractional_hour(ts)
    declination = F.radians(wave(day, YEAR, shift=284) * 23.45)
    hour_angle = F.radians((hour - 12) * 15)
    phi = F.radians(as_col(latitude))
    elevation = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)
    seasonal = wave(day, YEAR, shift=-80) * 0.1 + 0.9
    return clip(clip(elevation, 0.0) * seasonal * (1000.0 * clearness), 0.0, 1100.0)


def humidity_proxy(ts: str | Column, temperature: str | Column) -> Column:
    """Relative humidity from temperature and hour, between 20 and 95."""
    daily = wave(fractional_hour(ts), 24, shift=6) * 20
    return clip((as_col(temperature) - 15) * -1.5 + 70 + daily, 20.0, 95.0)


def weather_curves(ts: str | Column) -> Mapping[str, Column]:
    """All curves of a region that has been given its profile."""
    temperature = temperature_curve(ts, "base_temperature")
    return {
        "temperature": temperature,
        "humidity": humidity_proxy(ts, temperature),
        "solar_irradiance": clear_sky_irradiance(ts, "latitude"),
    }
