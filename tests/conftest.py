import math
import os

import numpy as np
import pytest

from tapewatch.operators.kernel import score_block
from tapewatch.params import DetectorParams
from tapewatch.session import build_session

START = 1_700_000_000_000
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def make_ticks(specs, start=START, step=1000):
    """(ms, price, volume) arrays, one tick per (price, volume)."""
    ms = np.array([start + i * step for i in range(len(specs))], dtype=np.int64)
    return ms, np.array([p for p, _ in specs], dtype=float), np.array([v for _, v in specs], dtype=float)


def join(*runs):
    return tuple(np.concatenate(parts) for parts in zip(*runs))


def alt(n, d, base=100.0, volume=100.0):
    return [(base + (d if i % 2 else -d), volume) for i in range(n)]


def noisy(n, base=100.0, step=0.01, seed=0, volume=100.0):
    rng = np.random.default_rng(seed)
    return [(p, volume) for p in base + rng.normal(0, step / 4, n)]


def calm(n, seed=1):
    rng = np.random.default_rng(seed)
    v = 100 * np.exp(rng.normal(0, 0.3, n))
    p = 100 + rng.normal(0, 0.001, n)
    return list(zip(p.tolist(), v.tolist()))


# only the z-score and VWAP and wash rule, as the early fixtures assume
BASIC = DetectorParams().only("zscore", "vwap", "wash_rule").with_(z_threshold=3.0, vwap_threshold=0.003)


def run(ticks, params, state=None, ticker="AAPL"):
    kept, out, state = score_block(ticker, *ticks, params, state)
    return out, state


def blank(x):
    return x is None or (isinstance(x, float) and math.isnan(x))


def tick_frame(spark, ticks, ticker="AAPL", **columns):
    ms, price, volume = ticks
    rows = [(ticker, int(m), float(p), float(v), i) for i, (m, p, v) in enumerate(zip(ms, price, volume))]
    return spark.createDataFrame(rows, "ticker string, event_time_ms long, price double, volume double, arrival long")


def random_ticks(spark, n, tickers=("A", "B"), seed=0, gap_every=None, step=1500, same_ms=0.05, shock=0.02):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        gaps = rng.integers(1, 2 * step, n)
        gaps[rng.random(n) < same_ms] = 0
        if gap_every:
            gaps[::gap_every] += 4_000_000
        ms = START + np.cumsum(gaps)
        price = 100 + np.cumsum(rng.normal(0, 0.01, n)) + (rng.random(n) < shock) * rng.normal(0, 0.5, n)
        volume = 100 * np.exp(rng.normal(0, 0.5, n)) * np.where(rng.random(n) < shock, 20, 1)
        rows += [(t, int(m), float(p), float(v), i) for i, (m, p, v) in enumerate(zip(ms, price, volume))]
    return spark.createDataFrame(rows, "ticker string, event_time_ms long, price double, volume double, arrival long")


def have_testdata():
    return os.path.isdir(SF)
