"""Live progress of runs. live_progress forgets runs that end; progress_stream keeps every run it has seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parchment.runtime import ship

#: fixed values: statuses after which a run says no more
TERMINAL = ("DONE", "FAILED")


def progress_stream(events: DataFrame, run: str, ts: str, current: str, failures: str, status: str) -> DataFrame:
    """(run, current, failures, status, updated): greatest counts and the latest status of each run. For update mode.

    Works on a batch table and on a stream alike. On a stream every run stays in the state: see live_progress.
    """
    return events.groupBy(run).agg(
        F.max(current).alias("current"), F.max(failures).alias("failures"), F.max_by(status, ts).alias("status"), F.max(ts).alias("updated")
    )


def progress_windows(events: DataFrame, run: str, ts: str, current: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(run, start, stop, current): the greatest count of each run in each window; the watermark bounds the state. For append mode."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), run).agg(F.max(current).alias("current"))
    return out.select(run, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "current")


def _follow(terminal: tuple[str, ...], keep_ms: int, linger_ms: int):
    """State function: (current, failures, status, updated ms, began ms) of a run; a row for each micro-batch that has events of it."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, failures, status, updated, began = state.get if state.exists else (0, 0, None, -1, None)
        for rows in batches:
            if rows.empty:
                continue
            ms = rows["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
            current, failures = (max(a, int(rows[c].max())) if rows[c].notna().any() else a for a, c in ((current, "current"), (failures, "failures")))
            began = int(ms.min()) if began is None else min(began, int(ms.min()))
            # a run that has ended stays ended, whatever comes late; otherwise the latest status counts, of equally late ones the greatest
            order = rows.assign(ms=ms, status=rows["status"].fillna("")).sort_values(["ms", "status"])
            ends = order[order["status"].isin(terminal)]
            if status not in terminal:
                if len(ends):
                    status, updated = str(ends["status"].iloc[0]), max(updated, int(ms.max()))
                elif int(order["ms"].iloc[-1]) >= updated:
                    status, updated = str(order["status"].iloc[-1]), int(order["ms"].iloc[-1])
        state.update((current, failures, status, updated, began))
        state.setTimeoutTimestamp(max(updated, state.getCurrentWatermarkMs()) + (linger_ms if status in terminal else keep_ms))
        yield pd.DataFrame({"run": [key[0]], "current": [current], "failures": [failures], "status": [status], "seconds": [(updated - began) / 1000], "ended": [status in terminal]})

    return update


def live_progress(
    events: DataFrame, run: str, ts: str, current: str, failures: str, status: str, terminal: tuple[str, ...] = TERMINAL, late: str = "10 minutes", keep_seconds: int = 86_400, linger_seconds: int = 600
) -> DataFrame:
    """(run, current, failures, status, seconds, ended) of each run that a micro-batch has events of, in update mode.

    Counts never fall. A run that has reached a terminal status stays ended and leaves the state ``linger_seconds`` of event time
    later; one that says nothing for ``keep_seconds`` leaves it too. Events later than the watermark (``late``) are dropped, so a run that
    has left doesn't come back through stragglers. Null counts change nothing, a null status is empty; runs without a name are one.
    """
    ship(events.sparkSession)
    kind = events.schema[run].dataType.simpleString()
    rows = events.select(F.col(run).alias("run"), F.col(ts).alias("ts"), F.col(current).cast("long").alias("current"), F.col(failures).cast("long").alias("failures"), F.col(status).alias("status"))
    out = rows.withWatermark("ts", late).groupBy("run").applyInPandasWithState(
        _follow(terminal, keep_seconds * 1000, linger_seconds * 1000), f"run {kind}, current long, failures long, status string, seconds double, ended boolean",
        "current long, failures long, status string, updated long, began long", "update", GroupStateTimeout.EventTimeTimeout,
    )
    return out.withColumnRenamed("run", run)
