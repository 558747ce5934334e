"""Thresholds and grid constants, passed to operators as arguments."""

from __future__ import annotations

from dataclasses import dataclass

STEP_MINUTES = 15
SLOTS_PER_HOUR = 4
SLOTS_PER_DAY = 96
SLOTS_PER_WEEK = 672
WINDOW_ROWS = 96

# Forecast horizons in 15-minute steps.
HORIZON_STEPS = {"15min": 1, "1h": 4, "6h": 24, "12h": 48, "24h": 96, "48h": 192}

# The long horizons in hourly steps, for models at hourly cadence.
HOURLY_HORIZON_STEPS = {"24h": 24, "48h": 48}

# Lags in 15-minute steps and in hours.
LAG_STEPS = {"lag_1h": 4, "lag_6h": 24, "lag_24h": 96, "lag_48h": 192, "lag_168h": 672}
LAG_HOURS = {"lag_1h": 1, "lag_6h": 6, "lag_24h": 24, "lag_48h": 48, "lag_168h": 168}

# Rolling windows in rows and the longer list of lags in hours.
ROLLING_WINDOWS = (4, 12, 24, 96, 288)
ROLLING_LAG_HOURS = (1, 2, 4, 12, 24, 48, 96, 168)

CALENDAR_COLUMNS = ["hour", "day_of_week", "month", "is_weekend", "is_holiday"]
LAG_COLUMNS = list(LAG_STEPS)
WEATHER_COLUMNS = ["temperature", "humidity", "solar_irradiance"]
FEATURE_COLUMNS = CALENDAR_COLUMNS + LAG_COLUMNS + WEATHER_COLUMNS


@dataclass(frozen=True)
class Thresholds:
    """Anomaly thresholds.

    A single value of n regions has a peer z-score of at most (n-1)/sqrt(n), so ``peer`` must
    lie below that bound to find anything: 1.789 for 5 regions, 2.475 for 8.
    """

    region: float = 2.5
    forecast: float = 2.0
    peer: float = 2.0
    share_absolute: float = 0.40
    share_increase: float = 0.15
    high: float = 3.0

    @property
    def spike(self) -> float:
        return max(3.0, self.forecast + 0.5)


DEFAULTS = Thresholds()
