"""Registered queries that run the recursive detector.

The SQL side steps through every ticker with a recursive query, one tick per
step, so it shares nothing with the column passes of the kernel.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.operators import cube, detect, inject, tuning
from tapewatch.operators import ticks as tk
from tapewatch.params import AlertConfig, DetectorParams
from tapewatch.plans.evaluation import evaluation_report, split_report
from tapewatch.plans.inputs import ANOMALIES_SQL, anomalies, indexed_sql, ticks
from tapewatch.plans.registry import GAP_MS, HOUR, query, r6, s6, slices
from tapewatch.plans.price_tuning import check_price, tune_price
from tapewatch.schemas import ALERT, ANOMALIES, RAW_EVENTS
from tapewatch.session import checkpoint_folder, cut_lineage
from tapewatch.sources import files
from tapewatch.sources.tables import anomaly_rows, persist_batch, read_table
from tapewatch.streaming.alerts import alerts_stream, dedupe_events
from tapewatch.streaming.bars import live_bars
from tapewatch.streaming.detect import checkpoint_path, detect_stream
from tapewatch.streaming.progress import progress_totals, record_progress, stored_progress
from tapewatch.streaming.sinks import alert_log_batch, build_sink, start_sink

# The test ticks are minutes apart and their prices jump freely, so gaps are
# hours and thresholds sit where some ticks of every signal fire.
TEST_PARAMS = DetectorParams(
    z_threshold=3.0,
    vwap_threshold=0.0025,
    wash_lookback_ms=6 * HOUR,
    wash_volume_ratio=0.3,
    wash_price_range=0.003,
    rate_gap_cap_ms=2 * HOUR,
    gap_reset_ms=2 * HOUR,
    ewma_threshold=2.5,
    ewma_min_samples=20,
    cusum_k=1.0,
    cusum_h=2.5,
    cusum_volume_k=0.25,
    cusum_volume_h=1.5,
    cusum_min_samples=20,
    volume_spike_multiple=3.0,
)


def detector_sql(p: DetectorParams, source: str = "ticks") -> str:
    """CTEs up to ``run``: one row per scored tick of ``source``."""
    rate, slow = 2.0 / (p.rate_span + 1), 2.0 / (p.cusum_sigma_span + 1)
    fast_a, slow_a, div_a = 2.0 / (p.ewma_fast_span + 1), 2.0 / (p.ewma_slow_span + 1), 2.0 / (2 * p.ewma_slow_span + 1)
    look = f"CASE WHEN rn >= {p.rate_min_samples} THEN {p.wash_lookback_ticks} * rd ELSE {p.wash_lookback_ms} END"
    if p.wash_lookback_ticks <= 0:
        look = str(p.wash_lookback_ms)
    return f"""
o AS (SELECT ticker, event_time_ms AS ms, price AS p, volume AS v, row_number() OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) AS pos,
  concat_ws('-', ticker, event_time_ms, row_number() OVER (PARTITION BY ticker, event_time_ms ORDER BY arrival) - 1) AS tick_id FROM {source}),
run AS (
  SELECT DISTINCT ticker, 0::BIGINT AS pos, NULL::BIGINT AS ms, NULL::VARCHAR AS tick_id, []::DOUBLE[] AS cl, []::DOUBLE[] AS wp, []::DOUBLE[] AS wv,
    []::STRUCT(m BIGINT, p DOUBLE, v DOUBLE)[] AS hist, NULL::DOUBLE AS ef, NULL::DOUBLE AS es, 0::DOUBLE AS em, 0::BIGINT AS en, 0::DOUBLE AS rd, 0::BIGINT AS rn,
    0::DOUBLE AS up, 0::DOUBLE AS dn, 0::DOUBLE AS cv, NULL::DOUBLE AS pp, 0::DOUBLE AS dms, 0::DOUBLE AS lm, 0::DOUBLE AS lv, 0::BIGINT AS cn,
    NULL::VARCHAR AS inc, 0::BIGINT AS since,
    NULL::DOUBLE AS zscore, NULL::DOUBLE AS vwap_divergence, NULL::DOUBLE AS ewma_divergence, NULL::DOUBLE AS cusum_price, NULL::DOUBLE AS cusum_volume,
    NULL::DOUBLE AS wash_ratio, NULL::DOUBLE AS spike, NULL::DOUBLE AS risk_score, NULL::VARCHAR AS anomaly_type, NULL::VARCHAR AS signals, NULL::VARCHAR AS incident_id
  FROM o
  UNION ALL
  SELECT ticker, pos, ms, tick_id, list_slice(list_append(cl, cp), -{p.window_size}, -1), list_slice(list_append(wp, p), -{p.window_size}, -1), list_slice(list_append(wv, v), -{p.window_size}, -1),
    list_append(hist, {{'m': ms, 'p': p, 'v': v}}), ef, es, em, en, rd, rn,
    CASE WHEN cu / {p.cusum_h} > {p.risk_threshold} AND up / {p.cusum_h} > {p.risk_threshold} THEN 0 ELSE up END,
    CASE WHEN cu / {p.cusum_h} > {p.risk_threshold} AND dn / {p.cusum_h} > {p.risk_threshold} THEN 0 ELSE dn END,
    CASE WHEN cw / {p.cusum_volume_h} > {p.risk_threshold} THEN 0 ELSE cv END,
    p, dms, lm, lv, cn, CASE WHEN sig <> '' THEN inc1 ELSE inc END, CASE WHEN sig <> '' THEN 0 ELSE since + 1 END,
    z, vd, ew, cu, cw, wash, spike, risk, CASE WHEN shock THEN 'price_shock' WHEN sig <> '' THEN 'wash_trade' END, nullif(sig, ''), CASE WHEN sig <> '' THEN inc1 END
  FROM (SELECT *, CASE WHEN inc IS NULL OR since > {p.incident_gap_ticks} THEN concat_ws('-', ticker, ms) ELSE inc END AS inc1,
      greatest(r1, r2, r3, r4, wash, spike, r7) AS risk, r1 > {p.risk_threshold} OR r2 > {p.risk_threshold} OR r3 > {p.risk_threshold} OR r4 > {p.risk_threshold} AS shock,
      concat_ws(',', CASE WHEN r1 > {p.risk_threshold} THEN 'zscore' END, CASE WHEN r2 > {p.risk_threshold} THEN 'vwap' END, CASE WHEN r3 > {p.risk_threshold} THEN 'ewma' END,
        CASE WHEN r4 > {p.risk_threshold} THEN 'cusum_price' END, CASE WHEN wash > {p.risk_threshold} THEN 'wash_rule' END, CASE WHEN spike > {p.risk_threshold} THEN 'volume_spike' END,
        CASE WHEN r7 > {p.risk_threshold} THEN 'cusum_volume' END) AS sig
    FROM (SELECT *, coalesce(abs(z) / {p.z_threshold}, 0) AS r1, coalesce(vd / {p.vwap_threshold}, 0) AS r2, coalesce(abs(ew) / {p.ewma_threshold}, 0) AS r3,
        coalesce(cu / {p.cusum_h}, 0) AS r4, coalesce(cw / {p.cusum_volume_h}, 0) AS r7
      FROM (SELECT *, CASE WHEN n >= {p.min_samples} THEN CASE WHEN sd > 1e-9 THEN (p - mean) / sd ELSE 0 END END AS z,
          CASE WHEN n >= {p.min_samples} AND sv > 1e-9 AND spv / sv > 1e-9 THEN abs(p - spv / sv) / (spv / sv) END AS vd,
          CASE WHEN n >= {p.min_samples} AND sd > 1e-9 THEN mean + greatest(-{p.clip_k} * sd, least({p.clip_k} * sd, p - mean)) ELSE p END AS cp,
          CASE WHEN cn > {p.cusum_min_samples} THEN greatest(up, dn) END AS cu, CASE WHEN cn > {p.cusum_min_samples} THEN cv END AS cw,
          CASE WHEN flat AND pn >= {max(p.wash_min_prior, 1)} AND pv > 0 THEN v / ({p.wash_volume_ratio} * pv) ELSE 0 END AS wash,
          CASE WHEN cn > {p.cusum_min_samples} AND {p.volume_spike_multiple} > 0 THEN v / ({p.volume_spike_multiple} * exp(lm)) ELSE 0 END AS spike
        FROM (SELECT * REPLACE (
            CASE WHEN st IS NULL THEN up ELSE greatest(0, up + st - {p.cusum_k}) END AS up, CASE WHEN st IS NULL THEN dn ELSE greatest(0, dn - st - {p.cusum_k}) END AS dn,
            CASE WHEN pp IS NULL THEN dms ELSE dms + (CASE WHEN cn > 1 THEN {slow} ELSE 1 END) * (coalesce(st * sqrt(dms), p - pp) ** 2 - dms) END AS dms,
            CASE WHEN NOT flat THEN 0 WHEN vst IS NOT NULL THEN greatest(0, cv + vst - {p.cusum_volume_k}) ELSE cv END AS cv,
            CASE WHEN cn = 0 THEN ln(v) ELSE lm + {slow} * (coalesce(lm + vst * sqrt(lv), ln(v)) - lm) END AS lm,
            CASE WHEN cn = 0 THEN lv ELSE (1 - {slow}) * (lv + {slow} * (coalesce(lm + vst * sqrt(lv), ln(v)) - lm) ** 2) END AS lv, cn + 1 AS cn)
          FROM (SELECT *, CASE WHEN pp IS NOT NULL AND sqrt(dms) > 1e-12 THEN greatest(-{p.clip_k}, least({p.clip_k}, (p - pp) / sqrt(dms))) END AS st,
              CASE WHEN flat AND cn > 1 AND sqrt(lv) > 1e-12 THEN greatest(-{p.clip_k}, least({p.clip_k}, (ln(v) - lm) / sqrt(lv))) END AS vst
            FROM (SELECT *, coalesce(lo > 0 AND (hi - lo) / lo < {p.wash_price_range}, FALSE) AS flat
              FROM (SELECT *, list_min(list_transform(prior, lambda h: h.p)) AS lo, list_max(list_transform(prior, lambda h: h.p)) AS hi,
                  coalesce(list_sum(list_transform(prior, lambda h: h.v)), 0) AS pv, len(prior) AS pn, len(cl) AS n, list_avg(cl) AS mean, list_stddev_pop(cl) AS sd,
                  list_sum(wv) AS sv, list_sum(list_transform(list_zip(wp, wv), lambda x: x[1] * x[2])) AS spv
                FROM (SELECT *, list_filter(hist, lambda h: h.m < ms) AS prior
                  FROM (SELECT * REPLACE (list_filter(hist, lambda h: h.m >= ms - cut) AS hist)
                    FROM (SELECT *, {look} AS cut
                      FROM (SELECT * REPLACE (CASE WHEN prev IS NULL THEN rd WHEN rn = 0 THEN least(ms - prev, {p.rate_gap_cap_ms}) ELSE rd + {rate} * (least(ms - prev, {p.rate_gap_cap_ms}) - rd) END AS rd,
                            CASE WHEN prev IS NULL THEN rn ELSE rn + 1 END AS rn,
                            CASE WHEN ef IS NULL THEN p ELSE ef + {fast_a} * (p - ef) END AS ef, CASE WHEN es IS NULL THEN p ELSE es + {slow_a} * (p - es) END AS es,
                            CASE WHEN ef IS NULL THEN em ELSE em + {div_a} * ((ef + {fast_a} * (p - ef) - es) ** 2 - em) END AS em, en + 1 AS en),
                          CASE WHEN ef IS NOT NULL AND en >= {p.ewma_min_samples} AND em > 0 THEN (ef + {fast_a} * (p - ef) - es) / sqrt(em) END AS ew
                        FROM (SELECT o.ticker, o.pos, o.ms, o.tick_id, o.p, o.v, CASE WHEN fresh THEN NULL ELSE r.ms END AS prev,
                            CASE WHEN fresh THEN [] ELSE cl END AS cl, CASE WHEN fresh THEN [] ELSE wp END AS wp, CASE WHEN fresh THEN [] ELSE wv END AS wv, CASE WHEN fresh THEN [] ELSE hist END AS hist,
                            CASE WHEN fresh THEN NULL ELSE ef END AS ef, CASE WHEN fresh THEN NULL ELSE es END AS es, CASE WHEN fresh THEN 0 ELSE em END AS em, CASE WHEN fresh THEN 0 ELSE en END AS en,
                            CASE WHEN fresh THEN 0 ELSE rd END AS rd, CASE WHEN fresh THEN 0 ELSE rn END AS rn, CASE WHEN fresh THEN 0 ELSE up END AS up, CASE WHEN fresh THEN 0 ELSE dn END AS dn,
                            CASE WHEN fresh THEN 0 ELSE cv END AS cv, CASE WHEN fresh THEN NULL ELSE pp END AS pp, CASE WHEN fresh THEN 0 ELSE dms END AS dms, CASE WHEN fresh THEN 0 ELSE lm END AS lm,
                            CASE WHEN fresh THEN 0 ELSE lv END AS lv, CASE WHEN fresh THEN 0 ELSE cn END AS cn, CASE WHEN fresh THEN NULL ELSE inc END AS inc, CASE WHEN fresh THEN 0 ELSE since END AS since
                          FROM (SELECT run.*, coalesce(o.ms - run.ms > {p.gap_reset_ms}, TRUE) AS fresh FROM run JOIN o ON o.ticker = run.ticker AND o.pos = run.pos + 1) r
                          JOIN o ON o.ticker = r.ticker AND o.pos = r.pos + 1
        )))))))))))))"""


TICKS_CTE = indexed_sql(GAP_MS).split("lagged AS")[0].strip().rstrip(",")
FIELDS = ("zscore", "vwap_divergence", "ewma_divergence", "cusum_price", "cusum_volume", "risk_score")
FIELDS_SQL = ", ".join(s6(c) for c in FIELDS)
DETECTED_SQL = f"""
WITH RECURSIVE {TICKS_CTE}, {detector_sql(TEST_PARAMS)}
SELECT ticker, tick_id, {FIELDS_SQL}, anomaly_type IS NOT NULL AS is_anomaly, anomaly_type, signals, incident_id FROM run WHERE pos > 0"""


def _shown(scored: DataFrame) -> DataFrame:
    return scored.select(
        "ticker", "tick_id", *[r6(c) for c in FIELDS], "is_anomaly", "anomaly_type", "signals", "incident_id"
    )


@query("detect", "K-1", "K-2", "K-3", "K-4", "K-5", "K-6", "K-7", "K-8", "K-9", "K-10", "K-11", "K-13", "W-13", "T-3", sql=DETECTED_SQL)
def detect_all(spark, folder):
    return _shown(detect.detect_batch(ticks(spark, folder), TEST_PARAMS, slices(spark, folder)))


@query("detect_sliced", "K-1", "K-3", "K-8", sql=DETECTED_SQL)
def detect_sliced(spark, folder):
    """The same with several slices per ticker and a replay too short for some."""
    scored = detect.detect_batch(ticks(spark, folder), TEST_PARAMS, slices(spark, folder), target_rows=400, burn_ticks=200)
    return _shown(scored)


ISOLATED = {
    "ramp": TEST_PARAMS.only("ewma"),
    "price_steps": TEST_PARAMS.only("cusum_price").with_(cusum_k=0.5, cusum_h=4.0),
    "volume": TEST_PARAMS.only("wash_rule", "volume_spike", "cusum_volume").with_(wash_lookback_ticks=0.0),
}


def _counts_sql(name: str, p: DetectorParams) -> str:
    # an infinite threshold has no literal: a huge one never fires either
    finite = p.with_(**{f: 1e300 for f, v in vars(p).items() if v == float("inf")})
    return f"""(WITH RECURSIVE {TICKS_CTE}, {detector_sql(finite)}
SELECT '{name}' AS param_id, ticker, coalesce(signals, 'none') AS signals, count(*) AS ticks, count(DISTINCT incident_id) AS incidents FROM run WHERE pos > 0 GROUP BY ALL)"""


@query("detect_isolated", "K-14", "J-8", sql=" UNION ALL ".join(_counts_sql(k, p) for k, p in ISOLATED.items()))
def detect_isolated(spark, folder):
    return _isolated_counts(detect.detect_batch(ticks(spark, folder), ISOLATED, slices(spark, folder)))


@query("detect_isolated_sliced", "K-14", "K-7", "J-8", sql=" UNION ALL ".join(_counts_sql(k, p) for k, p in ISOLATED.items()))
def detect_isolated_sliced(spark, folder):
    scored = detect.detect_batch(ticks(spark, folder), ISOLATED, slices(spark, folder), target_rows=400, burn_ticks=200)
    return _isolated_counts(scored)


def _isolated_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("param_id", "ticker", F.coalesce("signals", F.lit("none")).alias("signals")).agg(
        F.count("*").alias("ticks"), F.count_distinct("incident_id").alias("incidents")
    )


@query("detect_with_labels", "J-10", sql=f"""
WITH RECURSIVE {indexed_sql(GAP_MS)}, {detector_sql(TEST_PARAMS)}
SELECT run.ticker, idx.label, coalesce(anomaly_type, 'normal') AS found, count(*) AS ticks FROM run JOIN idx USING (tick_id) WHERE run.pos > 0 GROUP BY ALL""")
def detect_with_labels(spark, folder):
    labelled = detect.detect_batch(ticks(spark, folder), TEST_PARAMS, slices(spark, folder), carry=["label"])
    return labelled.groupBy("ticker", "label", F.coalesce("anomaly_type", F.lit("normal")).alias("found")).agg(
        F.count("*").alias("ticks")
    )


def _tick_stream(spark, folder) -> DataFrame:
    """``ticks`` as a stream over the events file."""
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema)
    e = source.option("pathGlobFilter", "events.parquet").parquet(folder)
    return e.select(
        F.col("event_type").alias("ticker"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"),
        (100 + F.col("value") / 1000).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"),
        F.col("event_id").alias("arrival"),
    ).withColumn("event_time", F.timestamp_millis("event_time_ms"))


def _run_into_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    raw, flagged = f"{base}/raw_events", f"{base}/anomalies"
    scored = detect_stream(_tick_stream(spark, folder), TEST_PARAMS)
    sink = build_sink(scored, f"{base}/checkpoint", "detector", raw_path=raw, anomalies_path=flagged)
    start_sink(sink, available_now=True).awaitTermination()
    return read_table(spark, raw, RAW_EVENTS), read_table(spark, flagged, ANOMALIES)


FLAGGED_SQL = f"""
WITH RECURSIVE {TICKS_CTE}, {detector_sql(TEST_PARAMS)}
SELECT ticker, CAST(CAST(make_timestamp_ms(ms) AS DATE) AS VARCHAR) AS day, tick_id, {FIELDS_SQL}, anomaly_type, signals, incident_id FROM run WHERE anomaly_type IS NOT NULL"""


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ticker", F.col("day").cast("string").alias("day"), "tick_id", *[r6(c) for c in FIELDS], "anomaly_type", "signals", "incident_id"
    )


@query("stream_to_tables", "S-11", "S-12", "S-17", "ST-1", "ST-4", "ST-13", sql=FLAGGED_SQL)
def stream_to_tables(spark, folder):
    return _flagged(_run_into_tables(spark, folder)[1])


@query("stream_in_batches", "S-2", "S-12", "ST-1", "ST-2", "ST-5", sql=FLAGGED_SQL)
def stream_in_batches(spark, folder):
    """The ticks as three files, one micro-batch each; the second micro-batch
    fails after it was written and is run again from the checkpoint."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    raw, flagged = f"{base}/raw_events", f"{base}/anomalies"
    t = ticks(spark, folder).drop("label")
    first, last = t.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    part = F.floor((F.col("event_time_ms") - first) * 3 / (last - first + 1))
    for i in range(3):
        t.filter(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    scored = detect_stream(files.stream_ticks_from_files(spark, f"{base}/in", arrival=True), TEST_PARAMS)
    write, failed = persist_batch(raw, flagged), []

    def fails_once(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the write")

    sink = scored.writeStream.foreachBatch(fails_once).outputMode("update")
    sink = sink.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    try:
        sink.start().awaitTermination()
    except StreamingQueryException:
        sink.start().awaitTermination()
    return _flagged(read_table(spark, flagged, ANOMALIES))


# --- late ticks and progress -------------------------------------------------

DISTURBED = "arrival + CASE WHEN arrival % 17 = 0 THEN 40 WHEN arrival % 23 = 0 THEN 7 ELSE 0 END"


@query("late_ticks", "K-12", sql=f"""
WITH {TICKS_CTE}, d AS (SELECT ticker, arrival AS event_id, event_time_ms, {DISTURBED} AS arrival FROM ticks)
SELECT ticker, event_id, coalesce(event_time_ms < max(event_time_ms) OVER (PARTITION BY ticker ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS is_late FROM d""")
def late_ticks(spark, folder):
    """Ticks that arrive out of order; some arrive together."""
    t = ticks(spark, folder).withColumn("event_id", F.col("arrival")).withColumn("arrival", F.expr(DISTURBED))
    return tk.late_mask(t, per_slice=1_000).select("ticker", "event_id", "is_late")


# Fields of the stored state and what the recursive query calls them.
STATE_SQL = {
    "last_ts": "ms", "ewma_fast": "ef", "ewma_slow": "es", "ewma_div_ms": "em", "rate_dt_ms": "rd", "cusum_up": "up", "cusum_down": "dn",
    "cusum_vol": "cv", "cusum_prev_price": "pp", "cusum_diff_ms": "dms", "cusum_logv_mean": "lm", "cusum_logv_var": "lv",
}


@query("stream_state", "ST-4", "ST-5", "S-18", sql=f"""
WITH RECURSIVE {TICKS_CTE}, {detector_sql(TEST_PARAMS)}, final AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1)
SELECT ticker, {', '.join(s6(c, f) for f, c in STATE_SQL.items())}, len(wp) AS window_ticks, {s6('list_sum(wp)', 'window_prices')}, {s6('list_sum(cl)', 'window_clipped')} FROM final""")
def stream_state(spark, folder):
    """What a stream that was stopped and started again keeps per ticker, read
    from its checkpoint."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    checkpoint = checkpoint_path(f"{base}/checkpoint", "detector")
    t = cut_lineage(ticks(spark, folder).drop("label"))
    first, last = t.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    part = F.floor((F.col("event_time_ms") - first) * 3 / (last - first + 1))
    for files_there in ((0, 1), (2,)):
        for i in files_there:
            t.filter(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
        scored = detect_stream(files.stream_ticks_from_files(spark, f"{base}/in", arrival=True), TEST_PARAMS)
        sink = scored.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "detector").load(checkpoint)
    state = state.select(F.col("key.ticker").alias("ticker"), "value.*")

    def total(prices: str):
        return F.aggregate(prices, F.lit(0.0), lambda a, x: a + x)

    return state.select(
        "ticker", *[r6(f) for f in STATE_SQL], F.size("window_price").cast("long").alias("window_ticks"),
        r6(total("window_price"), "window_prices"), r6(total("window_clipped"), "window_clipped"),
    )


LATE_ROWS = 40


@query("stream_late_rows", "ST-2", "ST-7", "ST-6", sql=f"""
WITH RECURSIVE {TICKS_CTE}, {detector_sql(TEST_PARAMS)}
SELECT 4::BIGINT AS batches, (SELECT count(*) FROM ticks) + {LATE_ROWS} AS "rows", {LATE_ROWS}::BIGINT AS rows_dropped_by_watermark, count(*) AS scored,
  count(anomaly_type) AS flagged FROM run WHERE pos > 0""")
def stream_late_rows(spark, folder):
    """The ticks as three files and a fourth with the first ticks again, long
    after the watermark has passed them: they are counted and change nothing."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    t = cut_lineage(ticks(spark, folder).drop("label"))
    first, last = t.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    part = F.floor((F.col("event_time_ms") - first) * 3 / (last - first + 1))
    for i in range(3):
        t.filter(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    again = t.orderBy("event_time_ms", "arrival").limit(LATE_ROWS).withColumn("price", F.col("price") * 2)
    again.coalesce(1).write.mode("append").parquet(f"{base}/in")
    scored = detect_stream(files.stream_ticks_from_files(spark, f"{base}/in", arrival=True), TEST_PARAMS)
    recorder = record_progress(spark, f"{base}/progress")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    try:
        sink = scored.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
        totals = progress_totals(stored_progress(spark, f"{base}/progress"))
    finally:
        spark.streams.removeListener(recorder)
    out = spark.read.parquet(f"{base}/out").agg(F.count("*").alias("scored"), F.count_if("is_anomaly").alias("flagged"))
    counted = totals.select("batches", "rows", "rows_dropped_by_watermark", F.lit(1).alias("_k"))
    return counted.join(out.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("stream_completeness", "J-7", "S-11", "A-23", sql=f"""
WITH {TICKS_CTE} SELECT ticker, CAST(CAST(make_timestamp_ms(event_time_ms) AS DATE) AS VARCHAR) AS day, count(*) AS "rows" FROM ticks GROUP BY ALL""")
def stream_completeness(spark, folder):
    raw, _ = _run_into_tables(spark, folder)
    return raw.groupBy("ticker", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))


@query("live_bars", "ST-11", sql=f"""
WITH {TICKS_CTE} SELECT ticker, event_time_ms // 14400000 * 14400000 AS bar_ms, {s6('arg_min(price, (event_time_ms, arrival))', '"open"')}, {s6('max(price)', 'high')},
  {s6('min(price)', 'low')}, {s6('arg_max(price, (event_time_ms, arrival))', '"close"')}, {s6('sum(volume)', 'volume')} FROM ticks GROUP BY 1, 2""")
def stream_bars(spark, folder):
    base = f"{checkpoint_folder(spark)}/bars-{uuid.uuid4().hex}"
    bars = live_bars(_tick_stream(spark, folder), "4 hours")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    run = bars.writeStream.outputMode("update").option("checkpointLocation", f"{base}__state").foreachBatch(keep)
    run.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(base)
    # a bar updated by a later batch replaces its earlier version
    newest = F.max_by(F.struct("open", "high", "low", "close", "volume"), "batch").alias("b")
    return rows.groupBy("ticker", "bar_ms").agg(newest).select(
        "ticker", "bar_ms", *[r6(F.col(f"b.{c}"), c) for c in ("open", "high", "low", "close", "volume")]
    )


# --- tuning over windows, thresholds and wash settings ----------------------

# As many settings as the evaluation has, at the scale of the test ticks.
TUNING = cube.Grid(
    windows=cube.WINDOWS,
    z=tuple(round(1.0 + 0.2 * i, 1) for i in range(len(cube.Z_GRID))),
    vwap=(0.0025,),
    wash=tuple((r, w) for r in (0.2, 0.3, 0.5) for w in (0.002, 0.0025, 0.003)),
)
SURFACE = cube.Grid(
    windows=((20, 10),), z=tuple(round(1.0 + 0.25 * i, 2) for i in range(9)), vwap=(0.001, 0.0015, 0.0025), wash=((0.3, 0.003),)
)


def _values(rows) -> str:
    return ", ".join(f"({', '.join(str(v) for v in r)})" for r in rows)


def cube_sql(g: cube.Grid, p: DetectorParams = TEST_PARAMS) -> str:
    """CTEs up to ``sc``: for every ticker, period and setting the counts of
    each kind. z and VWAP step through every ticker with a recursive query per
    window, the look-back with another; all settings meet all ticks."""
    rate = 2.0 / (p.rate_span + 1)
    look = f"CASE WHEN rn >= {p.rate_min_samples} THEN {p.wash_lookback_ticks} * rd ELSE {p.wash_lookback_ms} END"
    kinds = {
        "price_shock": ("shock", "label = 'price_shock'"),
        "wash_trade": ("washed AND NOT shock", "label = 'wash_trade'"),
        "any": ("(shock OR washed)", "label <> 'normal'"),
    }
    sums = ", ".join(
        f"count_if({f} AND {y}) AS tp_{k}, count_if({f}) AS flag_{k}, count_if({y}) AS pos_{k}" for k, (f, y) in kinds.items()
    )
    return f"""
{TICKS_CTE},
cutoff AS (SELECT quantile_cont(CAST(event_time_ms AS DOUBLE), 0.7) AS split_ms FROM ticks),
o AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY pos) AS sess
  FROM (SELECT ticker, event_time_ms AS ms, price AS p, volume AS v, label, CASE WHEN event_time_ms <= split_ms THEN 'train' ELSE 'test' END AS period,
      row_number() OVER w AS pos, coalesce(event_time_ms - lag(event_time_ms) OVER w > {p.gap_reset_ms}, TRUE) AS fresh,
      event_time_ms - lag(event_time_ms) OVER w AS gap
    FROM ticks, cutoff WINDOW w AS (PARTITION BY ticker ORDER BY event_time_ms, arrival))),
win AS (SELECT * FROM (VALUES {_values((i, w, m) for i, (w, m) in enumerate(g.windows))}) x(win, size, warm)),
zrun AS (
  SELECT win, size, warm, ticker, 0::BIGINT AS pos, []::DOUBLE[] AS cl, []::DOUBLE[] AS wp, []::DOUBLE[] AS wv, NULL::DOUBLE AS z, NULL::DOUBLE AS vd
  FROM win, (SELECT DISTINCT ticker FROM o)
  UNION ALL
  SELECT win, size, warm, ticker, pos, list_slice(list_append(cl, CASE WHEN n >= warm AND sd > 1e-9 THEN mean + greatest(-{p.clip_k} * sd, least({p.clip_k} * sd, p - mean)) ELSE p END), -size, -1),
    list_slice(list_append(wp, p), -size, -1), list_slice(list_append(wv, v), -size, -1),
    CASE WHEN n >= warm THEN CASE WHEN sd > 1e-9 THEN (p - mean) / sd ELSE 0 END END,
    CASE WHEN n >= warm AND sv > 1e-9 AND spv / sv > 1e-9 THEN abs(p - spv / sv) / (spv / sv) END
  FROM (SELECT *, len(cl) AS n, list_avg(cl) AS mean, list_stddev_pop(cl) AS sd, list_sum(wv) AS sv,
      list_sum(list_transform(list_zip(wp, wv), lambda x: x[1] * x[2])) AS spv
    FROM (SELECT win, size, warm, o.ticker, o.pos, o.p, o.v, CASE WHEN fresh THEN [] ELSE cl END AS cl, CASE WHEN fresh THEN [] ELSE wp END AS wp, CASE WHEN fresh THEN [] ELSE wv END AS wv
      FROM zrun r JOIN o ON o.ticker = r.ticker AND o.pos = r.pos + 1))),
rrun AS (
  SELECT DISTINCT ticker, 0::BIGINT AS pos, 0::DOUBLE AS rd, 0::BIGINT AS rn, 0::DOUBLE AS cut FROM o
  UNION ALL
  SELECT ticker, pos, rd, rn, CASE WHEN fresh THEN ms - {look} ELSE greatest(cut, ms - {look}) END
  FROM (SELECT o.ticker, o.pos, o.ms, fresh, cut, CASE WHEN fresh THEN 0 ELSE rn + 1 END AS rn,
      CASE WHEN fresh THEN 0 WHEN rn = 0 THEN least(gap, {p.rate_gap_cap_ms}) ELSE rd + {rate} * (least(gap, {p.rate_gap_cap_ms}) - rd) END AS rd
    FROM rrun r JOIN o ON o.ticker = r.ticker AND o.pos = r.pos + 1)),
h AS (SELECT o.ticker, o.pos, any_value(o.v) AS v, count(b.ms) AS n, min(b.p) AS lo, max(b.p) AS hi, sum(b.v) AS total
  FROM o JOIN rrun USING (ticker, pos) LEFT JOIN o b ON b.ticker = o.ticker AND b.sess = o.sess AND b.ms >= cut AND b.ms < o.ms GROUP BY o.ticker, o.pos),
wset AS (SELECT * FROM (VALUES {_values((i, r, w) for i, (r, w) in enumerate(g.wash))}) x(wash, ratio, width)),
wf AS (SELECT ticker, pos, wash, coalesce(n >= {max(p.wash_min_prior, 1)} AND lo > 0 AND (hi - lo) / lo < width AND total > 0 AND v / (ratio * total) > {p.risk_threshold}, FALSE) AS washed FROM h, wset),
zp AS (SELECT * FROM (VALUES {_values((i, z) for i, z in enumerate(g.z))}) x(z_pos, z_at)),
vp AS (SELECT * FROM (VALUES {_values((i, v) for i, v in enumerate(g.vwap))}) x(vwap_pos, vwap_at)),
zf AS (SELECT ticker, pos, win, z_pos, vwap_pos, coalesce(abs(z) > z_at, FALSE) OR coalesce(vd > vwap_at, FALSE) AS shock FROM zrun, zp, vp WHERE pos > 0),
sc AS (SELECT o.ticker, period, win, wash, z_pos, vwap_pos, {sums}, count(*) AS n_ticks
  FROM o JOIN zf USING (ticker, pos) JOIN wf USING (ticker, pos) GROUP BY ALL)"""


COUNT_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*cube.COUNTS, "n_ticks"))


def f1_sql(kind: str) -> str:
    p, r = f"coalesce(tp_{kind} / nullif(flag_{kind}, 0), 0)", f"coalesce(tp_{kind} / nullif(pos_{kind}, 0), 0)"
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


def tuned_sql(source: str, key: str, name: str) -> str:
    """CTEs ``<name>_s`` (the window and thresholds chosen) and ``<name>`` (with
    the wash setting) of each ``key`` of summed counts."""
    order = "row_number() OVER (PARTITION BY {0} ORDER BY {1} DESC, {2}) = 1"
    return f"""
{name}_s AS (SELECT {key}, win, z_pos, vwap_pos, {f1_sql('price_shock')} AS shock_f1 FROM {source} WHERE wash = 0
  QUALIFY {order.format(key, f1_sql('price_shock'), 'win, z_pos, vwap_pos')}),
{name} AS (SELECT {key}, win, z_pos, vwap_pos, wash, shock_f1, {f1_sql('wash_trade')} AS wash_f1
  FROM {source} JOIN {name}_s USING ({key}, win, z_pos, vwap_pos) QUALIFY {order.format(key, f1_sql('wash_trade'), 'wash')})"""


NAMED_SQL = "size::INTEGER AS window_size, warm::INTEGER AS min_samples, z_at::DOUBLE AS z, ratio::DOUBLE AS wash_ratio, width::DOUBLE AS wash_range"
NAMED_JOIN = "JOIN win USING (win) JOIN zp USING (z_pos) JOIN wset USING (wash)"


def _tuning_cube(spark, folder, grid: cube.Grid) -> DataFrame:
    t = tk.period_mask(ticks(spark, folder))
    return cube.exceedance_cube(t, grid, TEST_PARAMS, ["label", "period"], slices(spark, folder))


@query("tune_components", "J-8", "A-14", sql=f"""
WITH RECURSIVE {cube_sql(TUNING)},
m AS (SELECT period AS mask, win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM sc GROUP BY ALL
  UNION ALL SELECT 'all', win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM sc GROUP BY ALL),
{tuned_sql('m', 'mask', 'best')}
SELECT mask, {NAMED_SQL}, {s6('shock_f1')}, {s6('wash_f1')} FROM best {NAMED_JOIN}""")
def tune_components(spark, folder):
    """Window, z and wash setting tuned on all ticks and on each period."""
    counts = cube.setting_counts(_tuning_cube(spark, folder, TUNING), TUNING, ["period"])
    counts = cut_lineage(counts.withColumnRenamed("period", "mask"))
    whole = counts.groupBy(*cube.SETTING).agg(*[F.sum(c).alias(c) for c in (*cube.COUNTS, "n_ticks")])
    tuned = cube.tune(counts.unionByName(whole.withColumn("mask", F.lit("all"))), ["mask"])
    return _named(tuned, TUNING, "mask", r6("shock_f1"), r6("wash_f1"))


def _named(settings: DataFrame, grid: cube.Grid, *columns) -> DataFrame:
    return cube.named(settings, grid).select("window_size", "min_samples", "z", "wash_ratio", "wash_range", *columns)


@query("leave_one_ticker_out", "A-24", "J-8", sql=f"""
WITH RECURSIVE {cube_sql(TUNING)},
own AS (SELECT ticker, win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM sc GROUP BY ALL),
rest AS (SELECT k.ticker, win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM own, (SELECT DISTINCT ticker FROM own) k WHERE own.ticker <> k.ticker GROUP BY ALL),
{tuned_sql('rest', 'ticker', 'tuned')}, {tuned_sql('own', 'ticker', 'best')},
held AS (SELECT ticker, {f1_sql('price_shock')} AS a, {f1_sql('wash_trade')} AS b, {f1_sql('any')} AS c FROM own JOIN tuned USING (ticker, win, z_pos, vwap_pos, wash))
SELECT tuned.ticker, {NAMED_SQL}, {s6('a', 'shock_f1')}, {s6('b', 'wash_f1')}, {s6('c', 'any_f1')}, {s6('best.shock_f1', 'own_shock_f1')}, {s6('best.wash_f1', 'own_wash_f1')}
FROM tuned {NAMED_JOIN} JOIN held USING (ticker) JOIN best USING (ticker)""")
def leave_one_ticker_out(spark, folder):
    """Tuned on all other tickers, over windows, z and wash settings together."""
    counts = cube.setting_counts(_tuning_cube(spark, folder, TUNING), TUNING, ["ticker"])
    f1s = ("shock_f1", "wash_f1", "any_f1", "own_shock_f1", "own_wash_f1")
    rows = cube.leave_one_out(counts, TUNING)
    return rows.select("ticker", "window_size", "min_samples", "z", "wash_ratio", "wash_range", *[r6(c) for c in f1s])


PRF_SHOCK = ", ".join(
    s6(f"coalesce(tp_price_shock / nullif({c}_price_shock, 0), 0)", name) for c, name in (("flag", '"precision"'), ("pos", "recall"))
)


@query("threshold_surface", "J-8", "A-4", sql=f"""
WITH RECURSIVE {cube_sql(SURFACE)}, t AS (SELECT win, z_pos, vwap_pos, {COUNT_SUMS} FROM sc GROUP BY ALL)
SELECT z_at::DOUBLE AS z, vwap_at::DOUBLE AS vwap, tp_price_shock AS tp, flag_price_shock AS n_flag, pos_price_shock AS n_pos, {PRF_SHOCK}, {s6(f1_sql('price_shock'), 'f1')}
FROM t JOIN zp USING (z_pos) JOIN vp USING (vwap_pos)""")
def threshold_surface(spark, folder):
    """Every pair of z and VWAP thresholds at one window: the sweep over z at a
    fixed VWAP threshold and the one over VWAP at a fixed z are its rows and columns."""
    grid = cube.exceedance_cube(ticks(spark, folder), SURFACE, TEST_PARAMS, ["label"], slices(spark, folder))
    rows = cube.threshold_surface(cube.setting_counts(grid, SURFACE), SURFACE)
    return rows.select("z", "vwap", "tp", "n_flag", "n_pos", r6("precision"), r6("recall"), r6("f1"))


@query("full_detector_scores", "A-4", "A-5", "J-10", sql=f"""
WITH RECURSIVE {indexed_sql(GAP_MS)}, {detector_sql(TEST_PARAMS)},
r AS (SELECT anomaly_type, label FROM run JOIN idx USING (tick_id) WHERE run.pos > 0),
k AS (SELECT unnest(['price_shock', 'wash_trade', 'any']) AS kind),
c AS (SELECT kind, count_if(flag) AS nf, count_if(flag AND y) AS tp, count_if(y) AS np, count(*) AS n FROM (
  SELECT kind, CASE WHEN kind = 'any' THEN anomaly_type IS NOT NULL ELSE coalesce(anomaly_type = kind, FALSE) END AS flag,
    CASE WHEN kind = 'any' THEN label <> 'normal' ELSE label = kind END AS y FROM r, k) GROUP BY kind),
q AS (SELECT *, coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(tp / nullif(np, 0), 0) AS r FROM c)
SELECT kind, nf AS flagged, tp, nf - tp AS fp, {s6('nf / n', 'flag_rate')}, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM q""")
def full_detector_scores(spark, folder):
    """All signals at their own thresholds, tick by tick against the labels."""
    scored = detect.detect_batch(ticks(spark, folder), TEST_PARAMS, slices(spark, folder), carry=["label"])
    rows = tuning.detector_scores(scored)
    return rows.select("kind", "flagged", "tp", "fp", r6("flag_rate"), r6("precision"), r6("recall"), r6("f1"))


def _quoted(t: DataFrame) -> DataFrame:
    return t.withColumn("bid", F.col("price") - 0.005).withColumn("ask", F.col("price") + 0.005)


def uniform_sql(seed: int, salt: str, *keys: str) -> str:
    drawn = f"md5(concat_ws('|', {seed}, '{salt}', {', '.join(keys)}))"
    return f"(('0x' || substr({drawn}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal_sql(seed: int, salt: str, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {uniform_sql(seed, salt + '/r', *keys)})) * cos(2 * pi() * {uniform_sql(seed, salt + '/a', *keys)}))"


def between_sql(u: str, low: float, high: float) -> str:
    return f"({low} + {u} * {high - low})"


def whole_sql(u: str, low: int, high: int) -> str:
    return f"({low} + floor({u} * {high - low + 1})::BIGINT)"


KEY = ("ticker", "pos")
INJECT_RATE, INJECT_SEED = 0.02, 42


def _injected_sql(seed: int = INJECT_SEED, rate: float = INJECT_RATE) -> str:
    """CTEs up to ``out``: the ticks with events written in, the first free
    candidate first."""

    def u(salt: str) -> str:
        return uniform_sql(seed, salt, *KEY)

    return f"""
{indexed_sql(GAP_MS)},
ses AS (SELECT ticker, session_id, count(*) AS n, max(pos) AS final, greatest(coalesce(stddev_pop(price_diff), 1e-4), 1e-4) AS sigma FROM idx GROUP BY ALL),
cand AS (SELECT *, least(CASE WHEN kind = 'price_shock' THEN {inject.SHOCK_TICKS} ELSE {whole_sql(u('length'), *inject.WASH_TICKS)} END, final - pos + 1) AS length,
    CASE WHEN {u('side')} > 0.5 THEN 1.0 ELSE -1.0 END * {between_sql(u('size'), *inject.SHOCK_SIGMAS)} * sigma AS size, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS i
  FROM (SELECT ticker, session_id, pos, price AS anchor, sigma, final, CASE WHEN {u('kind')} < 0.5 THEN 'price_shock' ELSE 'wash_trade' END AS kind
    FROM idx JOIN ses USING (ticker, session_id) WHERE n >= {inject.LEAST_SESSION} AND {u('start')} < {rate})),
pick AS (SELECT DISTINCT ticker, 0::BIGINT AS i, 0::BIGINT AS free, FALSE AS kept FROM cand
  UNION ALL SELECT c.ticker, c.i, CASE WHEN c.pos >= free THEN c.pos + c.length ELSE free END, c.pos >= free FROM pick p JOIN cand c ON c.ticker = p.ticker AND c.i = p.i + 1),
hit AS (SELECT ticker, pos + step AS pos, step, kind, length, anchor, sigma, size FROM (
  SELECT cand.*, unnest(range(length)) AS step FROM cand JOIN pick USING (ticker, i) WHERE kept)),
out AS (SELECT ticker, arrival, pos, session_id, CASE WHEN step = 0 THEN kind ELSE 'normal' END AS label,
    CASE WHEN kind = 'price_shock' THEN price + shift WHEN kind = 'wash_trade' THEN flat ELSE price END AS price,
    CASE WHEN kind = 'wash_trade' THEN volume * {between_sql(u('volume'), *inject.WASH_VOLUME)} ELSE volume END AS volume,
    CASE WHEN kind = 'price_shock' THEN price - 0.005 + shift WHEN kind = 'wash_trade' THEN flat - 0.005 ELSE price - 0.005 END AS bid,
    CASE WHEN kind = 'price_shock' THEN price + 0.005 + shift WHEN kind = 'wash_trade' THEN flat + 0.005 ELSE price + 0.005 END AS ask
  FROM (SELECT *, size * (1 - step / length) AS shift, anchor + {normal_sql(seed, 'jitter', *KEY)} * sigma * {inject.JITTER_SIGMAS} AS flat FROM idx LEFT JOIN hit USING (ticker, pos)))"""


@query("inject_anomalies", "D-1", sql=f"""
WITH RECURSIVE {_injected_sql()}
SELECT ticker, arrival, label, {s6('price')}, {s6('volume')}, {s6('bid')}, {s6('ask')} FROM out""")
def inject_anomalies(spark, folder):
    out = inject.inject_anomalies(_quoted(ticks(spark, folder)), INJECT_RATE, INJECT_SEED, slices(spark, folder), GAP_MS)
    return out.select("ticker", "arrival", "label", *[r6(c) for c in ("price", "volume", "bid", "ask")])


@query("inject_densely", "D-1", sql=f"""
WITH RECURSIVE {_injected_sql(7, 1.0)}
SELECT ticker, arrival, label, {s6('price')}, {s6('volume')}, {s6('bid')}, {s6('ask')} FROM out""")
def inject_densely(spark, folder):
    """Every tick is a candidate: one event after the other."""
    out = inject.inject_anomalies(_quoted(ticks(spark, folder)), 1.0, 7, slices(spark, folder), GAP_MS)
    return out.select("ticker", "arrival", "label", *[r6(c) for c in ("price", "volume", "bid", "ask")])


def variant_sql(v: inject.Variant, seed: int, name: str) -> str:
    """CTEs ``<name>_spans`` and ``<name>`` (the changed ticks), after ``idx``."""
    tail = inject.SHOCK_TICKS if v.family == "price_shock" else 0
    step, near = v.length[1] + tail + inject.CLEARANCE, inject.CLEARANCE

    def u(salt: str, *keys: str) -> str:
        return uniform_sql(seed, f"{v.kind}/{salt}", *(keys or KEY))

    jitter = normal_sql(seed, v.kind + "/jitter", *KEY)
    if v.family == "price_shock":
        share = f"CASE WHEN step < ramp THEN (step + 1) / ramp ELSE 1 - (step - ramp + 1) / {float(inject.SHOCK_TICKS)} END"
        changed = f"CASE WHEN step IS NULL THEN price ELSE price + size * {share} END AS price, volume"
    else:
        changed = f"""CASE WHEN step IS NULL THEN price ELSE anchor + {jitter} * sigma * {inject.JITTER_SIGMAS} END AS price,
      CASE WHEN step IS NULL THEN volume ELSE volume * {between_sql(u('volume'), *v.volume)} END AS volume"""
    return f"""
{name}_ses AS (SELECT ticker, session_id, min(pos) AS a, max(pos) AS b, greatest(coalesce(stddev_samp(price_diff), 1e-4), 1e-4) AS sigma FROM idx GROUP BY ALL),
{name}_marks AS (SELECT ticker, pos, 2 AS r, {near} AS off, {near} AS lead FROM idx WHERE label <> 'normal'
  UNION ALL SELECT ticker, a, 1, 0, 0 FROM {name}_ses UNION ALL SELECT ticker, b + 1, 0, 0, 0 FROM {name}_ses),
{name}_free AS (SELECT ticker, a, b, (b - a + {near}) // {step} AS slots FROM (
  SELECT ticker, lag(pos) OVER w + lag(off) OVER w AS a, pos - lead AS b FROM {name}_marks WINDOW w AS (PARTITION BY ticker ORDER BY pos, r)) WHERE b > a),
{name}_places AS (SELECT ticker, a + shift + slot * {step} AS pos FROM (
  SELECT ticker, a, floor({u('shift', 'ticker', 'a')} * (b - a - (slots * {step} - {near}) + 1))::BIGINT AS shift, unnest(range(slots)) AS slot FROM {name}_free WHERE slots > 0)),
{name}_events AS (SELECT e.*, ramp + {tail} AS length, CASE WHEN {u('side')} > 0.5 THEN 1.0 ELSE -1.0 END * {between_sql(u('size'), *inject.SHOCK_SIGMAS)} * sigma AS size
  FROM (SELECT p.ticker, p.pos, price AS anchor, sigma, {whole_sql(uniform_sql(seed, v.kind + '/length', 'p.ticker', 'p.pos'), *v.length)} AS ramp
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ('0x' || substr(md5(concat_ws('|', {seed}, '{v.kind}', ticker, pos)), 1, 15))::BIGINT) AS k FROM {name}_places) p
    JOIN (SELECT ticker, count(*) AS target FROM idx WHERE label = '{v.family}' GROUP BY ticker) t ON t.ticker = p.ticker AND k <= target
    JOIN idx ON idx.ticker = p.ticker AND idx.pos = p.pos JOIN {name}_ses s ON s.ticker = p.ticker AND s.session_id = idx.session_id) e),
{name}_spans AS (SELECT ticker, pos AS start_pos, pos + length AS end_pos, '{v.kind}' AS kind FROM {name}_events),
{name} AS (SELECT ticker, event_time_ms, label, arrival, idx.pos, session_id, tick_id, {changed}
  FROM idx LEFT JOIN (SELECT ticker, pos + step AS pos, step, ramp, anchor, sigma, size FROM (SELECT *, unnest(range(length)) AS step FROM {name}_events)) h USING (ticker, pos))"""


VARIANTS = tuple((f"v{i}", v) for i, v in enumerate((*inject.EXISTING_VARIANTS, *inject.HELDOUT_VARIANTS)))


@query("inject_variants", "D-2", sql=f"""
WITH {indexed_sql(GAP_MS)}, {', '.join(variant_sql(v, 7, n) for n, v in VARIANTS)}
{' UNION ALL '.join(f"SELECT '{v.kind}' AS kind, ticker, arrival, label, {s6('price')}, {s6('volume')} FROM {n}" for n, v in VARIANTS)}""")
def inject_variants(spark, folder):
    """Every tick of one copy per variant, the held-out ones too."""
    t, out = ticks(spark, folder), []
    base = inject.variant_base(t, slices(spark, folder), GAP_MS)
    for _, v in VARIANTS:
        data, _ = inject.inject_variant(t, v, 7, slices(spark, folder), GAP_MS, base)
        out.append(data.select(F.lit(v.kind).alias("kind"), "ticker", "arrival", "label", r6("price"), r6("volume")))
    return reduce(DataFrame.unionByName, out)


@query("variant_spans", "D-2", sql=f"""
WITH {indexed_sql(GAP_MS)}, {', '.join(variant_sql(v, 7, n) for n, v in VARIANTS)}
{' UNION ALL '.join(f"SELECT ticker, start_pos, end_pos, kind FROM {n}_spans" for n, v in VARIANTS)}""")
def variant_spans(spark, folder):
    t = ticks(spark, folder)
    base = inject.variant_base(t, slices(spark, folder), GAP_MS)
    spans = [inject.inject_variant(t, v, 7, slices(spark, folder), GAP_MS, base)[1] for _, v in VARIANTS]
    return reduce(DataFrame.unionByName, spans)


def n6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


NAIVE_SQL = f"""
rets AS (SELECT *, coalesce(abs(price / lag(price) OVER (PARTITION BY ticker ORDER BY event_time_ms, arrival) - 1), 0.0) AS ret FROM ticks),
early AS (SELECT * FROM rets WHERE event_time_ms <= (SELECT quantile_cont(CAST(event_time_ms AS DOUBLE), 0.7) FROM ticks)),
nq AS (SELECT unnest(range(7)) AS i, unnest(quantile_cont(ret, {list(tuning.NAIVE_QUANTILES)})) AS tr, unnest(quantile_cont(volume, {list(tuning.NAIVE_QUANTILES)})) AS tv FROM early),
nc AS (SELECT 'price_shock' AS kind, i, tr AS limit_at, count_if(ret > tr AND label = 'price_shock') AS tp, count_if(ret > tr) AS nf, count_if(label = 'price_shock') AS np FROM nq, early GROUP BY ALL
  UNION ALL SELECT 'wash_trade', i, tv, count_if(volume > tv AND label = 'wash_trade'), count_if(volume > tv), count_if(label = 'wash_trade') FROM nq, early GROUP BY ALL),
nt AS (SELECT max(CASE WHEN kind = 'price_shock' THEN best END) AS by_return, max(CASE WHEN kind = 'wash_trade' THEN best END) AS by_volume FROM (
  SELECT kind, arg_max(limit_at, (coalesce(2 * p * r / nullif(p + r, 0), 0), -i)) AS best FROM (
    SELECT *, coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(tp / nullif(np, 0), 0) AS r FROM nc) GROUP BY kind))"""
DATASETS = tuple((f"v{i}", v, 7 + i) for i, v in enumerate(inject.EXISTING_VARIANTS))
F1 = "coalesce(2 * p * r / nullif(p + r, 0), 0)"

REPORT_SQL = f"""
WITH RECURSIVE {indexed_sql(GAP_MS)}, {', '.join(variant_sql(v, seed, n) for n, v, seed in DATASETS)},
ends AS (SELECT ticker, session_id, max(pos) AS final FROM idx GROUP BY ALL),
plain AS (SELECT ticker, pos AS start_pos, least(pos + CASE WHEN label = 'price_shock' THEN 5 ELSE 9 END, final + 1) AS end_pos, label AS kind
  FROM idx JOIN ends USING (ticker, session_id) WHERE label <> 'normal'),
names AS (SELECT unnest({['original', *[v.kind for _, v, _ in DATASETS]]}) AS dataset),
spans AS (SELECT dataset, concat_ws('|', dataset, ticker) AS ticker, start_pos, end_pos, kind FROM plain, names
  {' '.join(f"UNION ALL SELECT '{v.kind}', concat_ws('|', '{v.kind}', ticker), start_pos, end_pos, kind FROM {n}_spans" for n, v, _ in DATASETS)}),
dticks AS (SELECT concat_ws('|', 'original', ticker) AS ticker, event_time_ms, price, volume, arrival FROM idx
  {' '.join(f"UNION ALL SELECT concat_ws('|', '{v.kind}', ticker), event_time_ms, price, volume, arrival FROM {n}" for n, v, _ in DATASETS)}),
{detector_sql(TEST_PARAMS, 'dticks')},
{NAIVE_SQL},
found AS (SELECT 'detector' AS source, split_part(ticker, '|', 1) AS dataset, ticker, pos - 1 AS pos, anomaly_type AS family, incident_id FROM run WHERE pos > 0 AND anomaly_type IS NOT NULL
  UNION ALL SELECT 'naive', split_part(ticker, '|', 1), ticker, pos, CASE WHEN ret > by_return THEN 'price_shock' ELSE 'wash_trade' END, NULL FROM (
    SELECT *, row_number() OVER w - 1 AS pos, coalesce(abs(price / lag(price) OVER w - 1), 0.0) AS ret FROM dticks WINDOW w AS (PARTITION BY ticker ORDER BY event_time_ms, arrival)), nt
  WHERE ret > by_return OR volume > by_volume),
inside AS (SELECT dataset, ticker, start_pos, kind, CASE WHEN kind LIKE 'shock%' OR kind = 'price_shock' THEN 'price_shock' ELSE 'wash_trade' END AS family, unnest(range(start_pos, end_pos)) AS pos FROM spans),
cv AS (SELECT ticker, pos, list(DISTINCT kind) AS kinds FROM inside GROUP BY ALL),
kinds AS (SELECT DISTINCT dataset, kind, family FROM inside),
g AS (SELECT source, f.dataset, k.kind, count_if(coalesce(list_contains(kinds, k.kind), FALSE)) AS tp, count_if(kinds IS NULL OR list_contains(kinds, k.kind)) AS nf
  FROM found f JOIN kinds k ON k.dataset = f.dataset AND k.family = f.family LEFT JOIN cv ON cv.ticker = f.ticker AND cv.pos = f.pos GROUP BY ALL),
d AS (SELECT source, i.dataset, kind, count(DISTINCT (i.ticker, start_pos)) AS det FROM inside i JOIN found f ON f.ticker = i.ticker AND f.pos = i.pos AND f.family = i.family GROUP BY ALL),
e AS (SELECT source, dataset, kind, count(*) AS events FROM spans, (SELECT unnest(['detector', 'naive']) AS source) GROUP BY ALL),
q AS (SELECT dataset, source, kind, events, coalesce(det, 0) AS det, coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(det, 0) / events AS r
  FROM e LEFT JOIN g USING (source, dataset, kind) LEFT JOIN d USING (source, dataset, kind) WHERE kind = dataset OR dataset = 'original'),
h AS (SELECT sum(CASE WHEN gap_ms <= {GAP_MS} THEN gap_ms END) / 3600000.0 AS hours, count(*) AS n FROM idx),
hit AS (SELECT f.dataset, incident_id, bool_or(i.pos IS NOT NULL) AS ok FROM found f LEFT JOIN (SELECT DISTINCT ticker, pos FROM inside) i ON f.ticker = i.ticker AND f.pos = i.pos WHERE source = 'detector' GROUP BY ALL),
caught AS (SELECT i.dataset, count(DISTINCT (i.ticker, start_pos, kind)) AS n FROM inside i JOIN found f ON f.ticker = i.ticker AND f.pos = i.pos AND source = 'detector' GROUP BY i.dataset),
flags AS (SELECT dataset, count(*) AS n FROM found WHERE source = 'detector' GROUP BY dataset)
SELECT dataset, source, kind, events::DOUBLE AS events, det::DOUBLE AS detected, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6(F1, 'f1')}, NULL::DOUBLE AS alerts_per_hour, NULL::DOUBLE AS flag_rate FROM q
UNION ALL SELECT dataset, 'incidents', 'any', count(*), NULL, {n6('avg(CAST(ok AS DOUBLE))')}, {n6('any_value(c.n) / (SELECT count(*) FROM spans s WHERE s.dataset = hit.dataset)')}, NULL, {n6('count(*) / any_value(h.hours)')}, {n6('any_value(flags.n) / any_value(h.n)')}
FROM hit JOIN caught c USING (dataset) JOIN flags USING (dataset), h GROUP BY dataset"""


@query("evaluation_report", "D-6", "U-1", sql=REPORT_SQL)
def report(spark, folder):
    rows = evaluation_report(ticks(spark, folder), TEST_PARAMS, inject.EXISTING_VARIANTS, session_gap_ms=GAP_MS, s=slices(spark, folder))
    rounded = ("precision", "recall", "f1", "alerts_per_hour", "flag_rate")
    return rows.select("dataset", "source", "kind", "events", "detected", *[r6(c) for c in rounded])


PR_Z = (1.0, 1.5, 2.0, 2.5, 3.0)
WHOLE = replace(TUNING, z=tuple(sorted({*TUNING.z, *PR_Z})))
CANDIDATE = f"z_pos IN ({', '.join(str(WHOLE.z.index(z)) for z in TUNING.z)})"
PRODUCTION = {"win": cube.WINDOWS.index((20, 10)), "wash": TUNING.wash.index((0.3, 0.003)), "z_pos": WHOLE.z.index(3.0)}
KINDS = ("price_shock", "wash_trade", "any")


def _split_rows(source: str, rows: str) -> str:
    """Rows of the split section from summed counts of one setting per period."""
    return " UNION ALL ".join(
        f"SELECT period AS name, '{source}' AS source, '{k}' AS kind, flag_{k} AS nf, tp_{k} AS tp, pos_{k} AS np, n_ticks AS n FROM {rows}" for k in KINDS
    )


def _loo_rows(source: str, rows: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT 'leave_one_out', ticker, '{source}', '{k}', NULL, NULL, NULL, {n6(c)}, NULL FROM {rows}" for k, c in names.items())


SPLIT_SQL = f"""
WITH RECURSIVE {cube_sql(WHOLE)}, {NAIVE_SQL},
m AS (SELECT period, win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM sc GROUP BY ALL),
train AS (SELECT * FROM m WHERE period = 'train' AND {CANDIDATE}),
{tuned_sql('train', 'period', 'chosen')},
tuned AS (SELECT m.* FROM m JOIN chosen USING (win, z_pos, vwap_pos, wash)),
production AS (SELECT * FROM m WHERE period = 'test' AND win = {PRODUCTION['win']} AND wash = {PRODUCTION['wash']} AND z_pos = {PRODUCTION['z_pos']}),
late AS (SELECT 'test' AS period, ret > by_return AS shock, volume > by_volume AND NOT ret > by_return AS wash, label FROM rets, nt
  WHERE event_time_ms > (SELECT quantile_cont(CAST(event_time_ms AS DOUBLE), 0.7) FROM ticks)),
naive AS (SELECT period, {', '.join(f"count_if({f} AND {y}) AS tp_{k}, count_if({f}) AS flag_{k}, count_if({y}) AS pos_{k}" for k, f, y in (("price_shock", "shock", "label = 'price_shock'"), ("wash_trade", "wash", "label = 'wash_trade'"), ("any", "(shock OR wash)", "label <> 'normal'")))}, count(*) AS n_ticks FROM late GROUP BY period),
counted AS ({_split_rows('tuned', 'tuned')} UNION ALL {_split_rows('production', 'production')} UNION ALL {_split_rows('naive', 'naive')}),
scored AS (SELECT *, coalesce(tp / nullif(nf, 0), 0) AS p, coalesce(tp / nullif(np, 0), 0) AS r FROM counted),
own AS (SELECT ticker, win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM sc WHERE {CANDIDATE} GROUP BY ALL),
rest AS (SELECT k.ticker, win, wash, z_pos, vwap_pos, {COUNT_SUMS} FROM own, (SELECT DISTINCT ticker FROM own) k WHERE own.ticker <> k.ticker GROUP BY ALL),
{tuned_sql('rest', 'ticker', 'picked')}, {tuned_sql('own', 'ticker', 'best')},
held AS (SELECT ticker, {f1_sql('price_shock')} AS a, {f1_sql('wash_trade')} AS b, {f1_sql('any')} AS c FROM own JOIN picked USING (ticker, win, z_pos, vwap_pos, wash)),
curve AS (SELECT m.period, z_at, flag_price_shock AS nf, coalesce(tp_price_shock / nullif(flag_price_shock, 0), 0) AS p, coalesce(tp_price_shock / nullif(pos_price_shock, 0), 0) AS r
  FROM m JOIN chosen USING (win) JOIN zp ON zp.z_pos = m.z_pos WHERE m.wash = 0 AND z_at IN ({', '.join(map(str, PR_Z))}))
SELECT 'split' AS section, name, source, kind, nf::DOUBLE AS flagged, {s6('p', '"precision"')}, {s6('r', 'recall')}, {s6(F1, 'f1')},
  CASE WHEN source = 'tuned' AND name = 'test' AND np > 0 THEN round(p / (np / n), 6) + 0.0 END AS lift FROM scored
UNION ALL SELECT 'split', name, 'random', kind, NULL, {n6('p')}, {n6('r')}, {n6(F1)}, NULL FROM (SELECT name, kind, np / n AS p, nf / n AS r FROM scored WHERE source = 'tuned' AND name = 'test')
UNION ALL {_loo_rows('tuned', 'held', {'price_shock': 'a', 'wash_trade': 'b', 'any': 'c'})}
UNION ALL {_loo_rows('own', 'best', {'price_shock': 'shock_f1', 'wash_trade': 'wash_f1'})}
UNION ALL SELECT 'pr_curve', z_at::DOUBLE::VARCHAR, period, 'price_shock', nf, {n6('p')}, {n6('r')}, {n6(F1)}, NULL FROM curve"""


@query("split_report", "D-6", "A-16", "A-24", "A-25", "J-8", sql=SPLIT_SQL)
def split(spark, folder):
    rows = split_report(ticks(spark, folder), TUNING, TEST_PARAMS, PR_Z, slices(spark, folder))
    return rows.select("section", "name", "source", "kind", "flagged", *[r6(c) for c in ("precision", "recall", "f1", "lift")])


@query("price_tuning", "J-8", "A-15")
def price_tuning(spark, folder):
    _, table = tune_price(
        ticks(spark, folder), TEST_PARAMS, cusum_grid=((0.5, 4.0), (1.0, 2.0), (2.0, 3.0)), z_grid=(2.5, 3.5),
        ewma_grid=(2.0, 3.0), gap_ms=GAP_MS, s=slices(spark, folder),
    )
    scores = [r6(c) for c in ("precision", "recall", "f1")]
    return table.select("stage", "setting", "chosen", "kind", "events", "detected", *scores)


@query("price_check", "A-15", "A-10")
def price_check(spark, folder):
    tuned = TEST_PARAMS.with_(cusum_k=1.0, cusum_h=2.0, z_threshold=3.5)
    scores = check_price(ticks(spark, folder), tuned, TEST_PARAMS, gap_ms=GAP_MS, s=slices(spark, folder))
    return scores.select("period", "setting", "kind", "events", "detected", *[r6(c) for c in ("precision", "recall", "f1")])


@query("message_round_trip", "S-3", "S-9", "S-13", sql=f"""
WITH {TICKS_CTE} SELECT ticker, event_time_ms, {s6('price')}, {s6('volume')}, label FROM ticks""")
def message_round_trip(spark, folder):
    messages = files.ticks_to_messages(ticks(spark, folder))
    decoded, _ = files.decode_ticks(messages)
    return decoded.select("ticker", "event_time_ms", r6("price"), r6("volume"), "label")


@query("old_layout", "P-7", "P-8", sql=f"""
WITH {ANOMALIES_SQL} SELECT ticker, CAST(day AS VARCHAR) AS day, concat_ws('-', ticker, event_time_ms, '0') AS tick_id,
  NULL::VARCHAR AS signals, NULL::DOUBLE AS risk_score, {s6('zscore')} FROM scored WHERE is_anomaly""")
def old_layout(spark, folder):
    v1 = anomalies(spark, folder).select(
        "ticker", F.col("event_time").alias("timestamp"), "price", "volume", "zscore", "vwap_divergence", "is_anomaly", "anomaly_type"
    )
    rows = anomaly_rows(v1)
    return rows.select("ticker", F.col("day").cast("string").alias("day"), "tick_id", "signals", "risk_score", r6("zscore"))


# The same debouncing rules, one flag per step and key.
BURST_MS, COOLDOWN_MS = HOUR, 3 * HOUR
DEBOUNCED_SQL = f"""
WITH RECURSIVE {ANOMALIES_SQL},
e AS (SELECT ticker, coalesce(incident_id, anomaly_type) AS k, incident_id, event_time_ms AS ms,
  coalesce(risk_score, 0) >= 2 OR abs(zscore) >= 4.5 OR abs(vwap_divergence) >= 0.05 AS crit,
  row_number() OVER (PARTITION BY ticker, coalesce(incident_id, anomaly_type) ORDER BY event_time_ms, tick_id) AS i FROM scored WHERE is_anomaly),
run AS (
  SELECT DISTINCT ticker, k, 0::BIGINT AS i, FALSE AS open, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms, NULL::BIGINT AS last_ms, FALSE AS crit, 0::BIGINT AS n, NULL::VARCHAR AS event FROM e
  UNION ALL
  SELECT ticker, k, i, CASE WHEN absorb THEN TRUE WHEN quiet THEN FALSE ELSE TRUE END, CASE WHEN absorb OR quiet THEN start_ms ELSE ms END,
    CASE WHEN quiet AND NOT absorb THEN end_ms ELSE ms END, CASE WHEN absorb OR quiet THEN last_ms ELSE ms END,
    CASE WHEN absorb THEN was OR now ELSE CASE WHEN quiet THEN was ELSE now END END, CASE WHEN absorb THEN n + 1 WHEN quiet THEN n ELSE 1 END,
    CASE WHEN absorb THEN CASE WHEN now AND NOT was THEN 'escalated' END WHEN quiet THEN NULL ELSE 'opened' END
  FROM (SELECT r.ticker, r.k, e.i, e.ms, r.start_ms, r.end_ms, r.last_ms, r.crit AS was, e.crit AS now, r.n,
      r.open AND (e.incident_id IS NOT NULL OR e.ms - r.end_ms <= {BURST_MS}) AS absorb,
      coalesce(e.ms - r.last_ms < {COOLDOWN_MS}, FALSE) AS quiet
    FROM run r JOIN e ON e.ticker = r.ticker AND e.k = r.k AND e.i = r.i + 1))
SELECT md5(concat_ws('|', ticker, k, start_ms)) AS alert_id, ticker, event, start_ms, end_ms, n AS tick_count,
  CASE WHEN crit THEN 'CRITICAL' ELSE 'other' END AS level FROM run WHERE event IS NOT NULL"""


@query("alert_log", "S-16", "ST-9", "ST-12", sql=f"""
WITH a AS ({DEBOUNCED_SQL}) SELECT alert_id, ticker, event, tick_count, level, TRUE AS stamped FROM a
UNION ALL SELECT 'latest', NULL, NULL, 1, 'record', TRUE""")
def alert_log(spark, folder):
    """The alerts as the lines of the log, written by the sink and read back;
    and how many newest records there are."""
    base = f"{checkpoint_folder(spark)}/alerts-{uuid.uuid4().hex}"
    flags = anomalies(spark, folder).filter("is_anomaly").drop("event_time_ms")
    flags.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(flags.schema).parquet(f"{base}/in")
    cfg = AlertConfig(burst_window_ms=BURST_MS, cooldown_ms=COOLDOWN_MS)
    run = alerts_stream(dedupe_events(stream, "1 hour"), cfg, late=None).writeStream.outputMode("append")
    run = run.option("checkpointLocation", f"{base}/state").foreachBatch(alert_log_batch(f"{base}/log"))
    run.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.json(f"{base}/log")
    level = F.when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise("other").alias("level")
    stamped = (F.col("created_at").isNotNull() & (F.col("detection_latency_ms") >= 0)).alias("stamped")
    newest = files.latest_alert(log).agg(F.count("*").alias("tick_count"))
    nothing = F.lit(None).cast("string")
    return log.select("alert_id", "ticker", "event", "tick_count", level, stamped).unionByName(
        newest.select(F.lit("latest").alias("alert_id"), nothing.alias("ticker"), nothing.alias("event"), "tick_count",
                      F.lit("record").alias("level"), F.lit(True).alias("stamped"))
    )


@query("alert_stream", "ST-8", "ST-9", sql=DEBOUNCED_SQL)
def alert_stream(spark, folder):
    base = f"{checkpoint_folder(spark)}/alerts-{uuid.uuid4().hex}"
    flags = anomalies(spark, folder).filter("is_anomaly").drop("event_time_ms")
    flags.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(flags.schema).parquet(f"{base}/in")
    cfg = AlertConfig(burst_window_ms=BURST_MS, cooldown_ms=COOLDOWN_MS)
    alerts = alerts_stream(dedupe_events(stream, "1 hour"), cfg, late=None)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = alerts.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").foreachBatch(keep)
    run.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(ALERT).parquet(f"{base}/out").filter(F.col("event") != "closed")
    level = F.when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise("other")
    return rows.select(
        "alert_id", "ticker", "event", F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"),
        "tick_count", level.alias("level"),
    )
