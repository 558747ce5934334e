"""Common table expressions shared by the SQL texts."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bounds": ((), """SELECT date_trunc('day', min(ts)) AS lo,
        time_bucket(INTERVAL 15 MINUTE, max(ts)) AS hi FROM events"""),
    "regions": ((), "SELECT DISTINCT event_type AS region FROM events"),
    "spine": (("bounds",), "SELECT unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM bounds"),
    "observed": ((), """SELECT event_type AS region, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
        round(sum(value), 6) AS load FROM events GROUP BY 1, 2"""),
    "load": (("regions", "spine", "observed"), """SELECT r.region, s.ts, coalesce(o.load, 0.0) AS load
        FROM regions r CROSS JOIN spine s LEFT JOIN observed o ON o.region = r.region AND o.ts = s.ts"""),
    "sensed": ((), """SELECT event_type AS region, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
        round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS temperature,
        CAST(count(*) AS DOUBLE) AS humidity, max(value) AS solar_irradiance FROM events GROUP BY 1, 2"""),
    "weather": (("regions", "spine", "sensed"), """SELECT r.region, s.ts, o.temperature, o.humidity, o.solar_irradiance
        FROM regions r CROSS JOIN spine s LEFT JOIN sensed o ON o.region = r.region AND o.ts = s.ts"""),
    "recent": (("load", "bounds"), """SELECT region, ts, load FROM load, bounds
        WHERE ts > hi - INTERVAL 7 DAY"""),
    "latest": (("load", "bounds"), "SELECT region, ts, load FROM load, bounds WHERE ts = hi"),
    "stats": (("recent",), """SELECT region, avg(load) AS mean,
        CASE WHEN stddev_samp(load) > 0 THEN stddev_samp(load) ELSE 1e-6 END AS std
        FROM recent GROUP BY region"""),
    "total": (("load",), "SELECT ts, sum(load) AS total FROM load GROUP BY ts"),
    "recent_total": (("recent",), "SELECT ts, sum(load) AS total FROM recent GROUP BY ts"),
    "total_stats": (("recent_total",), """SELECT avg(total) AS mean,
        CASE WHEN stddev_samp(total) > 0 THEN stddev_samp(total) ELSE 1e-6 END AS std FROM recent_total"""),
    "horizons": ((), """SELECT * FROM (VALUES ('15min', 1), ('1h', 4), ('6h', 24), ('12h', 48),
        ('24h', 96), ('48h', 192)) t(horizon, steps)"""),
    "daily": ((), """SELECT r_name AS region, date_trunc('day', o_orderdate) AS ts, round(sum(o_totalprice), 2) AS load
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""),
    "load_daily": (("daily",), """SELECT r.region, s.ts, coalesce(d.load, 0.0) AS load
        FROM (SELECT DISTINCT r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey) r
        CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily) s
        LEFT JOIN daily d ON d.region = r.region AND d.ts = s.ts"""),
    "features": (("load", "weather", "holidays"), """SELECT l.region, l.ts, l.load,
        CAST(hour(l.ts) AS INTEGER) AS hour, CAST(isodow(l.ts) - 1 AS INTEGER) AS day_of_week,
        CAST(month(l.ts) AS INTEGER) AS month, CAST(isodow(l.ts) >= 6 AS INTEGER) AS is_weekend,
        CAST(CAST(l.ts AS DATE) IN (SELECT d FROM holidays) AS INTEGER) AS is_holiday,
        lag(l.load, 4) OVER w AS lag_1h, lag(l.load, 24) OVER w AS lag_6h, lag(l.load, 96) OVER w AS lag_24h,
        lag(l.load, 192) OVER w AS lag_48h, lag(l.load, 672) OVER w AS lag_168h,
        temperature, humidity, solar_irradiance
        FROM load l LEFT JOIN weather x ON x.region = l.region AND x.ts = l.ts
        WINDOW w AS (PARTITION BY l.region ORDER BY l.ts)"""),
    "years": ((), "SELECT unnest(generate_series(1990, 2035)) AS y"),
    "nth": (("years",), """SELECT d, dayofmonth(d) AS dom, month(d) AS m, isodow(d) AS dow FROM (
        SELECT CAST(unnest(generate_series(make_date(1990, 1, 1), make_date(2035, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d)"""),
    "holidays": (("nth",), """SELECT CASE dow WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS d FROM nth
        WHERE (m = 1 AND dom = 1) OR (m = 6 AND dom = 19 AND year(d) >= 2021) OR (m = 7 AND dom = 4)
           OR (m = 11 AND dom = 11) OR (m = 12 AND dom = 25)
        UNION ALL
        SELECT d FROM (SELECT d, m, dow, row_number() OVER (PARTITION BY year(d), m, dow ORDER BY d) AS n,
            row_number() OVER (PARTITION BY year(d), m, dow ORDER BY d DESC) AS n_last FROM nth) q
        WHERE (m = 1 AND dow = 1 AND n = 3) OR (m = 2 AND dow = 1 AND n = 3) OR (m = 5 AND dow = 1 AND n_last = 1)
           OR (m = 9 AND dow = 1 AND n = 1) OR (m = 10 AND dow = 1 AND n = 2) OR (m = 11 AND dow = 4 AND n = 4)"""),
}


def _collect(name: str, seen: list[str]) -> None:
    if name in seen:
        return
    for parent in CTES[name][0]:
        _collect(parent, seen)
    seen.append(name)


def sql(body: str, *names: str, extra: str = "") -> str:
    """``body`` preceded by the named expressions and what they depend on.

    ``extra`` is further ``name AS (...)`` text placed after the shared ones.
    """
    seen: list[str] = []
    for name in names:
        _collect(name, seen)
    parts = [f"{n} AS ({CTES[n][1]})" for n in seen]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
