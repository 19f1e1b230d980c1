"""The recursive signals on small hand-made runs of ticks."""

import json

import numpy as np
import pytest

from tapewatch.operators.kernel import _range_stats, cold_state, score_block
from tapewatch.params import DetectorParams
from tests.conftest import BASIC, START, alt, blank, calm, join, make_ticks, noisy, run

HOURS = 3_600_000


def test_warm_up_scores_nothing():
    out, _ = run(make_ticks([(100, 100)] * 9), BASIC)
    assert np.isnan(out["zscore"]).all() and not out["is_anomaly"].any()


def test_shock_is_flagged():
    out, _ = run(make_ticks(alt(40, 0.1) + [(500, 100)]), BASIC)
    assert out["anomaly_type"][-1] == "price_shock" and out["zscore"][-1] > 3
    assert not out["is_anomaly"][:-1].any()


def test_shock_does_not_contaminate_the_baseline():
    p = BASIC.with_(window_size=100, min_samples=30, vwap_threshold=0.01)
    out, _ = run(make_ticks(alt(150, 0.1) + [(500, 100)] + alt(150, 0.1)), p)
    assert not out["is_anomaly"][151 + 120 :].any()


def test_one_tick_has_bounded_influence():
    p = BASIC.with_(window_size=100, min_samples=30)
    _, before = run(make_ticks(alt(150, 0.1)), p)
    _, after = run(make_ticks(alt(150, 0.1) + [(500, 100)]), p)
    assert np.std(after["window_clipped"]) < 2 * np.std(before["window_clipped"])
    assert after["window_price"][-1] == 500


def test_window_evicts_the_oldest():
    p = BASIC.with_(window_size=5, min_samples=3)
    out, st = run(make_ticks([(100 + 0.001 * i, 10) for i in range(12)]), p.with_(z_threshold=10.0))
    assert st["window_price"] == [100 + 0.001 * i for i in range(7, 12)]
    assert sum(st["window_volume"]) == 50


def test_state_carries_over():
    _, st = run(make_ticks([(100, 100)] * 15), BASIC)
    out, st = run(make_ticks([(100, 100)], start=START + 20_000), BASIC, st)
    assert not blank(out["zscore"][0]) and len(st["window_price"]) == 16


def test_wash_trade_in_a_flat_market_only():
    p = DetectorParams().only("zscore", "vwap", "wash_rule").with_(z_threshold=5.0, vwap_threshold=0.01)
    out, _ = run(make_ticks([(100, 100)] * 15 + [(100, 5000)]), p)
    assert out["anomaly_type"].tolist() == [None] * 15 + ["wash_trade"]
    moving, _ = run(make_ticks(alt(15, 0.5) + [(100, 5000)]), p)
    assert moving["anomaly_type"][-1] != "wash_trade"


def test_lookback_forgets_old_volume():
    p = BASIC.with_(wash_lookback_ms=10_000, wash_lookback_ticks=0.0)
    ticks = join(
        make_ticks([(100, 1e5)] * 5), make_ticks([(100, 100)] * 5 + [(100, 1000)], start=START + 60_000)
    )
    out, _ = run(ticks, p)
    assert out["anomaly_type"][-1] == "wash_trade"


def test_price_signals_take_precedence():
    out, _ = run(make_ticks(alt(15, 0.01) + [(150, 5000)]), BASIC)
    assert out["anomaly_type"][-1] == "price_shock"


def test_wash_across_blocks():
    _, st = run(make_ticks([(100, 100)] * 15), BASIC)
    out, _ = run(make_ticks([(100, 5000)], start=START + 15_000), BASIC, st)
    assert out["anomaly_type"][0] == "wash_trade"


def test_overnight_gap_starts_cold():
    night = START + 30_000 + int(17.5 * HOURS)
    out, st = run(join(make_ticks(alt(30, 0.01)), make_ticks(alt(15, 0.01, base=110.0), start=night)), BASIC)
    assert np.isnan(out["zscore"][30:40]).all() and not out["is_anomaly"].any()
    assert min(st["window_price"]) >= 109


@pytest.mark.parametrize("pause, reset", [(50_000, False), (120_000, True)])
def test_gap_length_decides(pause, reset):
    p = BASIC.with_(gap_reset_ms=60_000)
    _, st = run(make_ticks([(100, 100)] * 15), p)
    out, st = run(make_ticks([(100, 100)], start=START + 14_000 + pause), p, st)
    assert blank(float(out["zscore"][0])) == reset
    assert (len(st["window_price"]) == 1) == reset


def test_straggler_is_dropped_and_counted():
    _, st = run(make_ticks([(100, 100)] * 15), BASIC)
    ms = np.array([START + 7000, *[START + 15_000 + i for i in range(5)]])
    kept, out, st = score_block("AAPL", ms, np.full(6, 100.0), np.full(6, 100.0), BASIC, st)
    assert len(out["zscore"]) == 5 and st["late_dropped"] == 1 and kept == slice(1, 6)


def test_same_millisecond_is_not_late():
    _, st = run(make_ticks([(100, 100)] * 15), BASIC)
    out, st = run(make_ticks([(100, 100)], start=START + 14_000), BASIC, st)
    assert len(out["zscore"]) == 1 and st["late_dropped"] == 0
    assert out["tick_id"][0] == f"AAPL-{START + 14_000}-1"


def test_held_back_ticks():
    ms, price, volume = make_ticks(alt(300, 0.1))
    batches = [list(range(i * 50, i * 50 + 50)) for i in range(6)]
    held = {1: [60, 70, 80], 3: [155]}
    for b, rows in held.items():
        batches[b] = [i for i in batches[b] if i not in rows]
        batches[b + 1] = sorted(batches[b + 1] + rows)
    st, n = None, 0
    for rows in batches:
        _, out, st = score_block("AAPL", ms[rows], price[rows], volume[rows], BASIC, st)
        n += len(out["zscore"])
    assert n == 296 and st["late_dropped"] == 4


def test_state_fields():
    p = DetectorParams()
    _, st = run(make_ticks(noisy(30) + [(150, 100)]), p)
    assert st["cusum_n"] == 31 and st["rate_dt_ms"] == 1000 and st["incident_id"] == f"AAPL-{START + 30_000}"


RAMP = DetectorParams().only("cusum_price").with_(cusum_k=0.5, cusum_h=8.0)


def test_ramp_is_caught():
    climb = [(100 + 0.02 * (i + 1), 100) for i in range(30)]
    out, _ = run(make_ticks(noisy(80) + climb), RAMP)
    assert not out["is_anomaly"][:80].any() and (out["anomaly_type"][80:] == "price_shock").any()


def test_cusum_restarts_after_firing():
    climb = [(100 + 0.02 * (i + 1), 100) for i in range(60)]
    out, _ = run(make_ticks(noisy(80) + climb), RAMP)
    fired = np.flatnonzero(out["is_anomaly"])
    assert 2 <= len(fired) < 15
    assert (out["cusum_price"][fired] > 8).all()
    later = fired[fired + 1 < len(out["cusum_price"])] + 1
    assert (out["cusum_price"][later] < 8).all()


def test_split_wash_and_flat_market_gate():
    p = DetectorParams().only("cusum_volume", "wash_rule").with_(wash_volume_ratio=0.7)
    out, _ = run(make_ticks(calm(80) + [(100, 300)] * 20), p.with_(cusum_volume_k=0.75, cusum_volume_h=3.0))
    assert not out["is_anomaly"][:80].any() and (out["anomaly_type"][80:] == "wash_trade").any()
    gated, _ = run(make_ticks(calm(80) + alt(20, 0.5, volume=300.0)), p)
    assert (gated["cusum_volume"][81:] == 0).all()


def test_cusum_gap_reset():
    night = START + 60_000 + int(17.5 * HOURS)
    out, st = run(join(make_ticks(noisy(60)), make_ticks(noisy(5, base=110.0), start=night)), DetectorParams())
    assert st["cusum_n"] == 5 and np.isnan(out["cusum_price"][60:]).all()


def test_adaptive_lookback():
    specs = [(100, 1000)] * 20 + [(100, 10)] * 5 + [(100, 30)]
    p = DetectorParams().only("wash_rule").with_(wash_volume_ratio=0.3)
    fixed, _ = run(make_ticks(specs), p.with_(wash_lookback_ticks=0.0))
    assert not fixed["is_anomaly"][-1]
    short, _ = run(make_ticks(specs), p.with_(wash_lookback_ticks=5.0))
    assert short["anomaly_type"][-1] == "wash_trade"


def test_rate_resets_with_the_session():
    night = START + 60_000 + int(17.5 * HOURS)
    p = DetectorParams(rate_min_samples=40)
    _, st = run(make_ticks([(100, 100)] * 30, step=2000), p)
    assert st["rate_n"] == 29
    _, st = run(make_ticks([(100, 100)] * 3, start=night, step=500), p, st)
    assert st["rate_n"] == 2 and st["rate_dt_ms"] < 1000


def test_risk_score_and_signals():
    p = BASIC.with_(z_threshold=5.0, vwap_threshold=0.01)
    out, _ = run(make_ticks(alt(40, 0.1) + [(500, 100)]), p)
    z, v = abs(out["zscore"][-1]), out["vwap_divergence"][-1]
    assert out["risk_score"][-1] == pytest.approx(max(z / 5, v / 0.01)) and out["signals"][-1] == "zscore,vwap"


def test_risk_threshold_only_moves_the_flag():
    ticks = make_ticks(alt(40, 0.1) + [(100.45, 100)])
    low, _ = run(ticks, BASIC)
    high, _ = run(ticks, BASIC.with_(risk_threshold=2.0))
    assert low["is_anomaly"][-1] and not high["is_anomaly"][-1]
    assert low["risk_score"][-1] == high["risk_score"][-1]


def _spiked(*at, n=80):
    specs = alt(n, 0.1)
    for i in at:
        specs[i] = (150, 100)
    return make_ticks(specs)


def test_incidents_join_near_flags():
    p = BASIC.only("zscore").with_(z_threshold=3.0)
    out, _ = run(_spiked(30, 35, 60), p)
    ids = {i: out["incident_id"][i] for i in (30, 35, 60)}
    assert ids[30] == ids[35] == f"AAPL-{START + 30_000}" and ids[60] != ids[30]


def test_incident_survives_blocks_but_not_gaps():
    p = BASIC.only("zscore").with_(z_threshold=3.0)
    ms, price, volume = _spiked(30, 35)
    _, st = run((ms[:33], price[:33], volume[:33]), p)
    out, _ = run((ms[33:], price[33:], volume[33:]), p, st)
    assert out["incident_id"][2] == f"AAPL-{START + 30_000}"
    _, st = run((ms[:33], price[:33], volume[:33]), p)
    _, st = run(make_ticks(alt(5, 0.1), start=START + 20 * HOURS), p, st)
    assert st["incident_id"] is None


def test_tick_ids_within_a_millisecond():
    ms = np.array([START] * 3)
    whole, _ = run((ms, np.full(3, 100.0), np.full(3, 1.0)), BASIC)
    _, st = run((ms[:2], np.full(2, 100.0), np.full(2, 1.0)), BASIC)
    rest, _ = run((ms[2:], np.full(1, 100.0), np.full(1, 1.0)), BASIC, st)
    assert whole["tick_id"].tolist() == [f"AAPL-{START}-{i}" for i in range(3)]
    assert rest["tick_id"][0] == whole["tick_id"][2]


def test_volume_spike():
    rng = np.random.default_rng(2)
    base = [(p, v) for (p, _), v in zip(alt(60, 0.5), 100 * np.exp(rng.normal(0, 0.2, 60)))]
    p = DetectorParams().only("volume_spike")
    big, _ = run(make_ticks(base + [(100, 1000)]), p)
    small, _ = run(make_ticks(base + [(100, 300)]), p)
    assert big["signals"][-1] == "volume_spike" and not small["is_anomaly"][-1]
    early, _ = run(make_ticks(base[:30] + [(100, 1000)]), p)
    assert not early["is_anomaly"].any()


def test_one_ulp_does_not_move_scores():
    rng = np.random.default_rng(3)
    price = 213.87 + np.cumsum(rng.normal(0, 0.005, 400))
    nudged = price.copy()
    nudged[::7] = np.nextafter(nudged[::7], np.inf)
    ms, volume = START + 1000 * np.arange(400), np.full(400, 100.0)
    a, _ = run((ms, price, volume), DetectorParams())
    b, _ = run((ms, nudged, volume), DetectorParams())
    assert np.nanmax(np.abs(a["zscore"] - b["zscore"])) < 1e-9


def test_switched_off_signals_stay_silent():
    out, _ = run(make_ticks(alt(60, 0.1) + [(500, 1e6)]), DetectorParams().only("cusum_volume"))
    assert set(out["signals"]) <= {None, "cusum_volume"}
    with pytest.raises(ValueError):
        DetectorParams().only("nonsense")


@pytest.mark.parametrize("seed", range(4))
def test_any_split_gives_the_same_state(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    gaps = rng.integers(0, 3000, n)
    gaps[rng.random(n) < 0.002] = 4_000_000
    ms = START + np.cumsum(gaps)
    price = 100 + np.cumsum(rng.normal(0, 0.01, n)) + (rng.random(n) < 0.05) * rng.normal(0, 1, n)
    volume = 100 * np.exp(rng.normal(0, 1, n))
    p = DetectorParams()
    whole, end = run((ms, price, volume), p)
    cuts = np.sort(rng.integers(0, n, 12))
    st, parts = None, []
    for idx in np.split(np.arange(n), cuts):
        if len(idx):
            # equal times must stay together, as they do in a time slice
            out, st = run((ms[idx], price[idx], volume[idx]), p, st)
            parts.append(out)
    assert json.dumps(st, sort_keys=True) == json.dumps(end, sort_keys=True)
    for name in whole:
        joined = np.concatenate([x[name] for x in parts])
        if joined.dtype == float:
            np.testing.assert_allclose(joined, whole[name], rtol=1e-12, atol=1e-12)
        else:
            assert joined.tolist() == whole[name].tolist()


def _step_by_step(ms, price, volume, p):
    """z-scores and wash ratios tick by tick, straight from the rules."""
    clipped, z, wash, hist, out = [], [], [], [], []
    cutoff = -np.inf
    for t, x, v in zip(ms, price, volume):
        w = clipped[-p.window_size :]
        value = x
        if len(w) >= p.min_samples:
            m, sd = np.mean(w), np.std(w)
            z.append((x - m) / sd if sd > 1e-9 else 0.0)
            if sd > 1e-9:
                value = m + np.clip(x - m, -p.clip_k * sd, p.clip_k * sd)
        else:
            z.append(np.nan)
        clipped.append(value)
        cutoff = max(cutoff, t - p.wash_lookback_ms)
        prior = [(q, u) for s, q, u in hist if cutoff <= s < t]
        ratio = 0.0
        if len(prior) >= p.wash_min_prior:
            lo, hi = min(q for q, _ in prior), max(q for q, _ in prior)
            if (hi - lo) / lo < p.wash_price_range:
                ratio = v / (p.wash_volume_ratio * sum(u for _, u in prior))
        wash.append(ratio)
        hist.append((t, x, v))
    return np.array(z), np.array(wash)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3])
def test_clipping_and_wash_match_the_plain_rules(share):
    rng = np.random.default_rng(11)
    n = 700
    ms = START + np.cumsum(rng.integers(0, 2000, n))
    price = 100 + np.cumsum(rng.normal(0, 0.004, n)) + (rng.random(n) < share) * rng.normal(0, 2, n)
    volume = 100 * np.exp(rng.normal(0, 1, n))
    p = DetectorParams(wash_lookback_ticks=0.0, wash_lookback_ms=20_000, wash_price_range=0.002).only("zscore", "wash_rule")
    p = p.with_(z_threshold=1e12, wash_volume_ratio=0.7)
    out, _ = run((ms, price, volume), p)
    z, wash = _step_by_step(ms, price, volume, p)
    np.testing.assert_allclose(out["zscore"], z, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(out["risk_score"], np.maximum(np.abs(np.nan_to_num(z)) / 1e12, wash), rtol=1e-9, atol=1e-9)


def test_long_ranges_use_tables_with_the_same_result():
    rng = np.random.default_rng(5)
    price, volume = rng.normal(100, 1, 500), rng.random(500)
    hi = np.arange(500)
    lo = np.maximum(0, hi - 300)
    low, high, total = _range_stats(lo, hi, price, volume)
    for i in range(1, 500):
        assert low[i] == price[lo[i] : i].min() and high[i] == price[lo[i] : i].max()
        assert total[i] == pytest.approx(volume[lo[i] : i].sum())
    assert cold_state()["last_ts"] is None


def test_range_sums_do_not_depend_on_the_block():
    rng = np.random.default_rng(6)
    price, volume = rng.normal(100, 1, 3000), rng.random(3000) * 10.0 ** rng.integers(-6, 7, 3000)
    hi = np.arange(1, 3001)
    lo = np.maximum(0, hi - rng.integers(0, 900, 3000))
    whole = _range_stats(lo, hi, price, volume)
    for first in (0, 1, 7, 1200, 2111):  # a block that starts later gives the same bits
        own = lo >= first
        part = _range_stats(lo[own] - first, hi[own] - first, price[first:], volume[first:])
        assert all((a[own] == b).all() for a, b in zip(whole, part))
