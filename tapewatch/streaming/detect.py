"""The detector as a streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tapewatch.operators.detect import SLICE_ROWS
from tapewatch.operators.kernel import STATE_FIELDS, score_block, scored_frame
from tapewatch.params import DetectorParams
from tapewatch.schemas import DETECTOR_STATE, SCORED, STATE_LAYOUT_VERSION
from tapewatch.session import ensure_state_store

# SCORED plus the running count of late ticks the scorer dropped per ticker.
SCORED_WITH_LATE = StructType([*SCORED.fields, StructField("late_dropped", LongType())])
TICK_COLUMNS = ["event_time_ms", "price", "volume", "arrival"]


class TickScorer(StatefulProcessor):
    """Scores the ticks of one ticker in one micro-batch.

    A key's rows arrive in several frames (Arrow batches). They are put
    together and sorted first, so that order is only lost across micro-batches.
    They are scored ``SLICE_ROWS`` at a time, so that a dense ticker costs its
    times, prices and volumes and not all its scored rows at once."""

    def __init__(self, params: DetectorParams, with_late: bool = False):
        self._params = params
        self._with_late = with_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("detector", DETECTOR_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = self._sorted(rows)
        state = None
        if self._state.exists():
            state = {k: list(v) if isinstance(v, (list, tuple)) else v for k, v in zip(STATE_FIELDS, self._state.get())}
        for at in range(0, len(ticks[0]), SLICE_ROWS):
            arrays = [a[at : at + SLICE_ROWS] for a in ticks]
            kept, columns, state = score_block(key[0], *arrays, self._params, state)
            if columns:
                out = scored_frame(key[0], *[a[kept] for a in arrays], columns)
                out["timestamp"] = out["timestamp"].dt.tz_localize("UTC")
                if self._with_late:
                    out["late_dropped"] = state["late_dropped"]  # late ticks come first, so all are counted
                yield out
        self._state.update(tuple(state[k] for k in STATE_FIELDS))

    @staticmethod
    def _sorted(rows: Iterator[pd.DataFrame]) -> list[np.ndarray]:
        """Times, prices and volumes of all frames, in order."""
        pdf = pd.concat([f[f.columns.intersection(TICK_COLUMNS)] for f in rows], ignore_index=True)
        order = ["event_time_ms", "arrival"] if "arrival" in pdf else ["event_time_ms"]
        pdf = pdf.sort_values(order, kind="stable")
        return [pdf[c].to_numpy() for c in TICK_COLUMNS[:3]]

    def close(self) -> None:
        pass


def detect_stream(
    ticks: DataFrame, params: DetectorParams = DetectorParams(), late: str = "1 minute", with_late: bool = False
) -> DataFrame:
    """Scored ticks from a tick stream with ``event_time``. Rows later than the
    watermark are dropped before the scorer, which needs event-time mode; rows
    within it but older than the ticker's last tick are dropped and counted by
    the scorer."""
    ensure_state_store(ticks.sparkSession)
    columns = ["ticker", "event_time_ms", "event_time", "price", "volume"]
    columns += ["arrival"] if "arrival" in ticks.columns else []
    return (
        ticks.select(*columns)
        .withWatermark("event_time", late)
        .groupBy("ticker")
        .transformWithStateInPandas(
            statefulProcessor=TickScorer(params, with_late),
            outputStructType=SCORED_WITH_LATE if with_late else SCORED,
            outputMode="Update",
            timeMode="EventTime",
        )
    )


def checkpoint_path(folder: str, name: str) -> str:
    """``<folder>/state-v<layout>/<name>``: a new state layout starts from a
    fresh checkpoint instead of failing on the old one."""
    return f"{folder.rstrip('/')}/state-v{STATE_LAYOUT_VERSION}/{name}"
