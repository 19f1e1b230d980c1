"""Parameter sets of the detector and of the alert stage."""

from __future__ import annotations

from dataclasses import dataclass, replace

INFINITY = float("inf")

# The order in which fired signals are listed.
PRICE_SIGNALS = ("zscore", "vwap", "ewma", "cusum_price")
VOLUME_SIGNALS = ("wash_rule", "volume_spike", "cusum_volume")
SIGNALS = PRICE_SIGNALS + VOLUME_SIGNALS


@dataclass(frozen=True)
class DetectorParams:
    # The defaults of the detector job.
    window_size: int = 20
    min_samples: int = 10
    z_threshold: float = 8.0
    vwap_threshold: float = 0.01
    clip_k: float = 5.0
    wash_lookback_ms: int = 120_000
    wash_volume_ratio: float = 0.7
    wash_price_range: float = 0.0015
    wash_min_prior: int = 4
    wash_lookback_ticks: float = 16.0
    rate_span: float = 200.0
    rate_min_samples: int = 20
    rate_gap_cap_ms: int = 60_000
    gap_reset_ms: int = 1_800_000
    ewma_fast_span: float = 3.0
    ewma_slow_span: float = 20.0
    ewma_threshold: float = 4.0
    ewma_min_samples: int = 50
    cusum_k: float = 2.0
    cusum_h: float = 2.5
    cusum_volume_k: float = 0.75
    cusum_volume_h: float = 3.0
    cusum_sigma_span: float = 100.0
    cusum_min_samples: int = 50
    risk_threshold: float = 1.0
    incident_gap_ticks: int = 10
    volume_spike_multiple: float = 6.0

    def with_(self, **changes) -> "DetectorParams":
        return replace(self, **changes)

    def only(self, *signals: str) -> "DetectorParams":
        """The same detector with every signal but ``signals`` switched off."""
        unknown = set(signals) - set(SIGNALS)
        if unknown:
            raise ValueError(f"unknown signals: {sorted(unknown)}")
        off = {
            "zscore": {"z_threshold": INFINITY},
            "vwap": {"vwap_threshold": INFINITY},
            "ewma": {"ewma_threshold": INFINITY},
            "cusum_price": {"cusum_h": INFINITY},
            "wash_rule": {"wash_volume_ratio": INFINITY},
            "volume_spike": {"volume_spike_multiple": 0.0},
            "cusum_volume": {"cusum_volume_h": INFINITY},
        }
        changes = {}
        for name in SIGNALS:
            if name not in signals:
                changes.update(off[name])
        return replace(self, **changes)


@dataclass(frozen=True)
class AlertConfig:
    # Severity thresholds, burst window and cooldown.
    zscore_critical: float = 4.5
    zscore_warning: float = 3.0
    vwap_critical: float = 0.05
    vwap_warning: float = 0.025
    risk_score_critical: float = 2.0
    risk_score_warning: float = 1.0
    burst_window_ms: int = 10_000
    cooldown_ms: int = 60_000
