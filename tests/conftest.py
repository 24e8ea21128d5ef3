import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterloom.session import build_session, materialise  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, shuffle_partitions=2, app="meterloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


def twin_frame(days: int = 28, missing_day: int = 11, seed: int = 7) -> pd.DataFrame:
    """Three meters on a 15-minute grid with two day shapes, weather, null readings and one missing day."""
    rng = np.random.default_rng(seed)
    slot = np.arange(96)
    weekday_shape = 2 + 3 * np.exp(-((slot - 36) ** 2) / 120) + 4 * np.exp(-((slot - 78) ** 2) / 90)
    weekend_shape = 2 + 5 * np.exp(-((slot - 52) ** 2) / 300)
    parts = []
    for m, (name, level) in enumerate([("m1", 1.0), ("m2", 2.5), ("m3", 0.6)]):
        for d in pd.date_range("2021-01-04", periods=days):
            if m == 1 and (d - pd.Timestamp("2021-01-04")).days == missing_day:
                continue
            temp = 10 + 5 * np.sin(2 * np.pi * (slot - 30) / 96) + rng.normal(0, 0.3, 96) + rng.normal(0, 2)
            shape = weekend_shape if d.weekday() >= 5 else weekday_shape
            load = level * (shape + 0.05 * temp.mean()) + rng.normal(0, 0.05, 96)
            parts.append(pd.DataFrame({
                "series_id": name, "ts": d + pd.to_timedelta(slot * 15, "m"), "temperature": temp,
                "radiation": np.maximum(0, 300 * np.sin(np.pi * (slot - 28) / 44)) * (slot > 28) * (slot < 72), "total": load,
            }))
    out = pd.concat(parts, ignore_index=True)
    out.loc[rng.choice(len(out), 60, replace=False), "temperature"] = np.nan
    out["total_filter"] = out.groupby("series_id")["total"].transform(lambda s: s.rolling(3, center=True, min_periods=1).mean())
    return out


@pytest.fixture(scope="session")
def twin_pandas():
    return twin_frame()


@pytest.fixture(scope="session")
def twin(spark, twin_pandas):
    from pyspark.sql import functions as F

    from meterloom.functions.encode import nan_to_null

    schema = "series_id string, ts timestamp_ntz, temperature double, radiation double, total double, total_filter double"
    df = spark.createDataFrame(twin_pandas, schema)
    return materialise(nan_to_null(df, ["temperature", "radiation", "total", "total_filter"]), "twin")
