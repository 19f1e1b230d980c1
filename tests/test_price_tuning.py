from pyspark.sql import functions as F

from tapewatch.operators import evaluate
from tapewatch.operators.slices import Slicing
from tapewatch.params import DetectorParams
from tapewatch.plans import price_tuning
from tapewatch.plans.detection_queries import TEST_PARAMS
from tapewatch.plans.inputs import ticks
from tapewatch.plans.registry import GAP_MS
from tests.conftest import SF

S = Slicing(width_ms=86_400_000)


def test_settings_are_scored_like_one_by_one(spark):
    data = price_tuning.datasets(ticks(spark, SF), (), gap_ms=GAP_MS, s=S)
    settings = {"a": TEST_PARAMS, "b": TEST_PARAMS.with_(cusum_h=1.0), "never": DetectorParams().only()}
    together = {(r["setting"], r["kind"]): tuple(r)[2:] for r in price_tuning.score_settings(data, settings, "train", S).select(
        "setting", "kind", "events", "detected", "precision", "recall", "f1").collect()}
    assert len(together) == 6 and together[("never", "price_shock")][1] == 0
    for name, p in settings.items():
        alone = price_tuning.score_settings(data, {name: p}, "train", S).select("setting", "kind", "events", "detected", "precision", "recall", "f1")
        assert {(r["setting"], r["kind"]): tuple(r)[2:] for r in alone.collect()}.items() <= together.items()


def test_chosen_setting_is_best_among_those_that_cost_no_other_kind(spark):
    grid = ((0.5, 4.0), (1.0, 2.0))
    t = ticks(spark, SF)
    tuned, table = price_tuning.tune_price(t, TEST_PARAMS, grid, (2.5,), (2.0, 3.0), (), "all", gap_ms=GAP_MS, s=S)
    rows = table.collect()
    base = {r["kind"]: r["f1"] for r in rows if r["stage"] == 0}
    best, fine = max_guarded([r for r in rows if r["stage"] < 2], base)
    (kept,) = {r["setting"] for r in rows if r["stage"] == 1 and r["chosen"]} or {"defaults"}
    assert fine[kept]["price_shock"] == best
    again, fine = max_guarded([r for r in rows if r["stage"] == 2 or r["setting"] == kept], base)
    (final,) = {r["setting"] for r in rows if r["stage"] == 2 and r["chosen"]} or {kept}
    assert again >= best and fine[final]["price_shock"] == again
    assert isinstance(tuned, DetectorParams)
    shown = table.groupBy("stage").agg(F.count_distinct("setting").alias("n"))
    assert {r["stage"]: r["n"] for r in shown.collect()} == {0: 1, 1: 2, 2: 2}
    assert set(base) == set(evaluate.TYPES)


def test_datasets_and_periods_share_one_run(spark, monkeypatch):
    calls = {"detect_batch": 0, "event_metrics": 0}
    for owner, name in ((price_tuning, "detect_batch"), (evaluate, "event_metrics")):
        run = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, _n=name, _f=run, **k: calls.update({_n: calls[_n] + 1}) or _f(*a, **k))
    rows = price_tuning.check_price(ticks(spark, SF), TEST_PARAMS, TEST_PARAMS, False, gap_ms=GAP_MS, s=S).collect()
    assert {r["period"] for r in rows} == {"train", "test", "all"} and calls == {"detect_batch": 1, "event_metrics": 1}
    events = {(r["period"], r["kind"]): r["events"] for r in rows}
    assert all(events["train", k] + events["test", k] == events["all", k] for k in evaluate.TYPES)


def max_guarded(rows, base):
    """(best price shock F1, F1 by setting and kind) of the settings that the guard lets pass."""
    by: dict = {}
    for r in rows:
        by.setdefault(r["setting"], {})[r["kind"]] = r["f1"]
    fine = {s: k for s, k in by.items() if all(k[x] >= base[x] - 0.005 for x in k if x != "price_shock")}
    return max(k["price_shock"] for k in fine.values()), fine
