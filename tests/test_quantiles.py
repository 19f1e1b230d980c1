import numpy as np
import pytest

from tapewatch.operators.quantiles import exact_percentiles

WANTED = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}


def check(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, "v", WANTED, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for name, p in WANTED.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


def test_few_values_ties_and_null_groups(spark):
    check(spark, {"one": [3.5], "same": [2.0] * 50, "two": [1.0] * 30 + [7.0] * 3, None: [5.0, 1.0, 9.0]})


def test_many_rows_take_several_rounds(spark):
    rng = np.random.default_rng(3)
    heavy = np.exp(rng.normal(0, 6, 60_000))
    lumpy = np.concatenate([np.full(20_000, 4.25), rng.normal(0, 1, 20_000)])
    check(spark, {"heavy": heavy.tolist(), "lumpy": lumpy.tolist()})


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(101)] + [(None, 1)], "v double, x int")
    r = exact_percentiles(df, "v", WANTED).first()
    assert r["n"] == 101 and r["p50"] == 50 and r["p95"] == 95
    assert exact_percentiles(df.limit(0), "v", WANTED).count() == 0
