import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticklane.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def random_bars(rows: int = 260, seed: int = 3, instruments=("A", "B")) -> pd.DataFrame:
    """Bars with gaps in volume, days of 40 rows and a running position per contract."""
    rng = np.random.default_rng(seed)
    frames = []
    for name in instruments:
        close = 4000 + np.cumsum(rng.normal(0, 6, rows))
        opened = close + rng.normal(0, 3, rows)
        frames.append(pd.DataFrame({
            "instrument": name, "pos": np.arange(rows, dtype="int64"), "date": [f"d{i // 40:02d}" for i in range(rows)],
            "open": opened, "close": close, "high": np.maximum(opened, close) + rng.random(rows) * 4,
            "low": np.minimum(opened, close) - rng.random(rows) * 4,
            "volume": np.where(rng.random(rows) < 0.1, 0, rng.integers(1, 500, rows)).astype("int64")}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars_pd():
    return random_bars()


@pytest.fixture(scope="session")
def bars(spark, bars_pd):
    return spark.createDataFrame(bars_pd).cache()


def per_series(frame: pd.DataFrame, column: str) -> dict[str, np.ndarray]:
    frame = frame.sort_values(["instrument", "pos"])
    return {name: part[column].to_numpy(dtype="float64") for name, part in frame.groupby("instrument")}
