"""Queries on shape functions, over every observed step."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.functions import profile as pf
from loadspan.operators import reshape
from loadspan.queries import inputs as src
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.sources import tables

PROFILE_SQL = """named AS (SELECT o.ts, o.load, o.region AS source_name, 'region_' || c.k AS region FROM observed o
        JOIN (SELECT region, row_number() OVER (ORDER BY region) AS k FROM (SELECT DISTINCT region FROM observed) d) c
        ON c.region = o.region),
    profile AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{name}', {float(lat)}, {float(temp)}, [{', '.join(str(h) for h in hours)}])"
    for name, lat, temp, hours in pf.REGION_PROFILE
) + """) t(region, latitude, base_temperature, peak_hours)),
    shaped AS (SELECT n.*, latitude, base_temperature, peak_hours, hour(ts) + minute(ts) / 60.0 AS fh,
        dayofyear(ts) AS doy FROM named n JOIN profile p ON p.region = n.region)"""


def shaped(spark, d):
    observed = tables.observed_load(src.events(spark, d)).withColumnRenamed("region", "source_name")
    return pf.with_region_profile(reshape.region_canonical(observed))


@query("harmonic_features", sql("""SELECT region, ts, round(CAST(fh AS DOUBLE) + 1e-9, 6) AS fractional_hour, round(sin(2 * pi() * fh / 24) + 1e-9, 6) AS daily_1,
    round(sin(4 * pi() * fh / 24) + 1e-9, 6) AS daily_2, round(sin(6 * pi() * fh / 24) + 1e-9, 6) AS daily_3,
    round(sin(2 * pi() * doy / 365.25) + 1e-9, 6) AS yearly FROM shaped""", "observed", extra=PROFILE_SQL))
def harmonic_features(spark, d):
    columns = [c.alias(n) for n, c in pf.harmonic_features("ts").items()]
    return rounded(shaped(spark, d).select("region", "ts", *columns))


@query("peak_hour_proximity", sql("""SELECT region, ts, round(sum(0.15 * exp(-power(least(abs(fh - h), 24 - abs(fh - h)), 2) / 0.5)) + 1e-9, 6) AS proximity
    FROM (SELECT region, ts, fh, unnest(peak_hours) AS h FROM shaped) q GROUP BY region, ts""", "observed", extra=PROFILE_SQL))
def peak_hour_proximity(spark, d):
    return rounded(shaped(spark, d).select("region", "ts", pf.peak_hour_proximity("ts", "peak_hours").alias("proximity")))


@query("weekly_factor", sql("""SELECT region, ts, CAST(CASE WHEN isodow(ts) >= 6 THEN -0.1 ELSE 0.05 END AS DOUBLE) AS factor
    FROM observed""", "observed"))
def weekly_factor(spark, d):
    return tables.observed_load(src.events(spark, d)).select("region", "ts", pf.weekly_factor("ts").alias("factor"))


TEMPERATURE = "base_temperature + 12 * sin(2 * pi() * (doy - 80) / 365.25) + 8 * sin(2 * pi() * (fh - 6) / 24)"


@query("phase_shifted_season", sql(f"""SELECT region, ts, round(sin(2 * pi() * doy / 365.25 + pi() / 4) + 1e-9, 6) AS season,
    round(12 * sin(2 * pi() * (doy - 80) / 365.25) + 1e-9, 6) AS yearly_temperature,
    round(8 * sin(2 * pi() * (fh - 6) / 24) + 1e-9, 6) AS daily_temperature, round({TEMPERATURE} + 1e-9, 6) AS temperature
    FROM shaped""", "observed", extra=PROFILE_SQL))
def phase_shifted_season(spark, d):
    parts = pf.phase_shifted_season("ts")
    return rounded(shaped(spark, d).select(
        "region", "ts", *[c.alias(n) for n, c in parts.items()],
        pf.temperature_curve("ts", "base_temperature").alias("temperature"),
    ))


@query("clear_sky_irradiance", sql("""SELECT region, ts, round(least(1100, greatest(0, 1000 * greatest(0,
    sin(radians(latitude)) * sin(radians(decl)) + cos(radians(latitude)) * cos(radians(decl)) * cos(radians(15 * (fh - 12))))
    * (0.9 + 0.1 * sin(2 * pi() * (doy - 80) / 365.25)))) + 1e-9, 6) AS irradiance FROM (
    SELECT *, 23.45 * sin(2 * pi() * (284 + doy) / 365.25) AS decl FROM shaped) q""", "observed", extra=PROFILE_SQL))
def clear_sky_irradiance(spark, d):
    return rounded(shaped(spark, d).select("region", "ts", pf.clear_sky_irradiance("ts", "latitude").alias("irradiance")))


@query("humidity_proxy", sql(f"""SELECT region, ts, round(least(95, greatest(20, 70 - 1.5 * ({TEMPERATURE} - 15)
    + 20 * sin(2 * pi() * (fh + 6) / 24))) + 1e-9, 6) AS humidity FROM shaped""", "observed", extra=PROFILE_SQL))
def humidity_proxy(spark, d):
    return rounded(shaped(spark, d).select("region", "ts", pf.weather_curves("ts")["humidity"].alias("humidity")))


@query("clip", sql("SELECT region, ts, CAST(greatest(5.0, least(95.5, load)) AS DOUBLE) AS clipped FROM observed", "observed"))
def clip(spark, d):
    return tables.observed_load(src.events(spark, d)).select("region", "ts", pf.clip(F.col("load"), 5.0, 95.5).alias("clipped"))
