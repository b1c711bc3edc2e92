import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from traffic_risk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from verification.fixtures import Inputs

    return Inputs(spark, "/root/testdata/sf0.001")


@pytest.fixture
def events(spark):
    """Build page views from rows of a few named columns; the rest is filled in."""
    from datetime import date

    defaults = {
        "date": date(2024, 1, 1),
        "distinct_id": "u1",
        "hour_time": 10,
        "url": "/a",
        "referrer": "r",
        "ip": "1.2.3.4",
        "os": "iOS",
        "browser": "Safari",
        "manufacturer": "Acme",
        "province": "p",
        "is_first_day": "0",
        "is_login_id": "false",
        "title": "t",
        "screen_width": "360",
        "screen_height": "800",
    }
    schema = ", ".join(
        f"{k} {'date' if k == 'date' else 'int' if k == 'hour_time' else 'string'}" for k in defaults
    )

    def build(*rows, **common):
        full = [{**defaults, **common, **r} for r in rows]
        return spark.createDataFrame([tuple(r[k] for k in defaults) for r in full], schema)

    return build


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
