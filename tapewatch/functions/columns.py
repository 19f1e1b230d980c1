"""Column functions: sanitising, severity, desk look-ups, alert text, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewatch.params import AlertConfig


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(column: str | Column, default: float = 0.0) -> Column:
    """The column as a double; anything not a finite number becomes default."""
    x = _c(column).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def text(column: str | Column) -> Column:
    return F.coalesce(_c(column).cast("string"), F.lit(""))


def legacy_risk(risk: str | Column, zscore: str | Column, vwap_div: str | Column) -> Column:
    """risk, or for rows that predate it the larger of the two old signals."""
    return F.coalesce(
        finite_or_null(risk), F.greatest(F.abs(finite(zscore)) / 5.0, F.abs(finite(vwap_div)) / 0.01)
    )


def finite_or_null(column: str | Column) -> Column:
    x = _c(column)
    return F.when(x.isNotNull(), finite(x))


def severity(zscore, vwap_div, anomaly_type, risk, cfg: AlertConfig = AlertConfig()) -> Column:
    z, v, r = F.abs(finite(zscore)), F.abs(finite(vwap_div)), finite(risk)
    critical = (r >= cfg.risk_score_critical) | (z >= cfg.zscore_critical) | (v >= cfg.vwap_critical)
    warning = (
        (r >= cfg.risk_score_warning)
        | (z >= cfg.zscore_warning)
        | (v >= cfg.vwap_warning)
        | F.coalesce(_c(anomaly_type) == "wash_trade", F.lit(False))
    )
    return F.when(critical, "CRITICAL").when(warning, "WARNING").otherwise("INFO")


def asset_status(max_risk, max_z, wash_trades, cfg: AlertConfig = AlertConfig()) -> Column:
    r, z, w = _c(max_risk), _c(max_z), _c(wash_trades)
    return (
        F.when((r >= cfg.risk_score_critical) | (z >= cfg.zscore_critical), "CRITICAL")
        .when((r >= cfg.risk_score_warning) | (z >= cfg.zscore_warning) | (w > 0), "WARNING")
        .otherwise("NORMAL")
    )


# Regulatory rule per anomaly type and desk status per severity.
RULES = {
    "price_shock": "SEC Rule 10b-5 (Excessive Volatility)",
    "wash_trade": "FINRA Rule 6140 (Wash Sale / Self-Trade)",
}
DEFAULT_RULE = "FINRA Surveillance Flag"
DESK_STATUS = {
    "CRITICAL": "ESCALATED TO COMPLIANCE",
    "WARNING": "UNDER REVIEW",
    "INFO": "AUDIT LOGGED",
}
DEFAULT_STATUS = "UNDER REVIEW"


def lookup(key: str | Column, values: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _c(key)), F.lit(default))


def regulatory_rule(anomaly_type: str | Column) -> Column:
    return lookup(anomaly_type, RULES, DEFAULT_RULE)


def desk_status(level: str | Column) -> Column:
    return lookup(level, DESK_STATUS, DEFAULT_STATUS)


def case_id(incident_id, ticker, event_time) -> Column:
    """The incident id, else a stable code of ticker and time: the whole hash,
    so that two cases do not share one."""
    code = F.md5(F.concat_ws("|", _c(ticker), F.unix_millis(_c(event_time))))
    return F.coalesce(F.nullif(text(incident_id), F.lit("")), F.concat(F.lit("INC-"), code))


# The wording of an alert.
SHOCK_TEXT = "[%s] %s price %s to $%.2f (risk: %.2f, Z-score: %+.2f, VWAP divergence: %.2f%%%s, %d ticks)"
WASH_TEXT = "[%s] %s suspected wash trade at $%.2f (risk: %.2f, VWAP div: %.2f%%%s, %d ticks)"
OTHER_TEXT = "[%s] %s anomalous behavior detected (risk: %.2f, Z-score: %+.2f%s)"


def alert_message(ticker, level, anomaly_type, price, zscore, vwap_div, risk, signals, ticks) -> Column:
    listed = F.when(text(signals) != "", F.concat(F.lit(", signals: "), text(signals))).otherwise("")
    pct = finite(vwap_div) * 100
    z, r, p = finite(zscore), finite(risk), finite(price)
    move = F.when(z > 0, "spike").otherwise("drop")
    count = _c(ticks).cast("long")
    shock = F.format_string(SHOCK_TEXT, _c(level), _c(ticker), move, p, r, z, pct, listed, count)
    wash = F.format_string(WASH_TEXT, _c(level), _c(ticker), p, r, pct, listed, count)
    other = F.format_string(OTHER_TEXT, _c(level), _c(ticker), r, z, listed)
    return F.when(_c(anomaly_type) == "price_shock", shock).when(_c(anomaly_type) == "wash_trade", wash).otherwise(other)


def rate(numerator, denominator) -> Column:
    """numerator / denominator, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double")), F.lit(0.0))


def rate4(numerator, denominator) -> Column:
    """Rounded to 4 digits, null when the denominator is 0."""
    return F.round(F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double")), 4)


def f1(precision, recall) -> Column:
    p, r = _c(precision), _c(recall)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def f1_4(precision, recall) -> Column:
    p, r = _c(precision), _c(recall)
    return F.when((p != 0) & (r != 0), F.round(2 * p * r / (p + r), 4))


def prf_columns(tp, flagged, positives) -> dict[str, Column]:
    """flagged, precision, recall and F1 from three counts."""
    p, r = rate(tp, flagged), rate(tp, positives)
    return {"flagged": _c(flagged), "precision": p, "recall": r, "f1": f1(p, r)}


def random_baseline(flag_rate, prevalence) -> dict[str, Column]:
    """Expected scores of flagging every tick with probability ``flag_rate``."""
    p, r = _c(prevalence), _c(flag_rate)
    return {"precision": p, "recall": r, "f1": f1(p, r)}
