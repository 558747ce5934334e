"""Importing this module registers every query."""

from loadspan.queries import (  # noqa: F401
    analytics, anomalies, backtests, base, documents, forecasts, further, learning, profiles, streams,
)
