from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from loadspan.session import local_session  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("loadspan-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return str(DATA / os.environ.get("LOADSPAN_TEST_SF", "sf0.001"))


@pytest.fixture
def hours(spark):
    """Builds load(region, ts, load) from lists of values at 15-minute steps from 2024-01-01."""
    import datetime as dt

    def build(values: dict[str, list[float]], start=dt.datetime(2024, 1, 1)):
        rows = [
            (region, start + dt.timedelta(minutes=15 * i), float(v))
            for region, series in values.items()
            for i, v in enumerate(series)
        ]
        return spark.createDataFrame(rows, "region string, ts timestamp_ntz, load double")

    return build
