"""Recovery of failed orders, in batches."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.operators.paragraphs import first_seen


def _day(value: str) -> date | None:
    return date.fromisoformat(value) if value and len(value) == 10 else (None if not value else _bad(value))


def _bad(value: str) -> date:
    raise ValueError(f"a date must look like YYYY-MM-DD, not {value!r}")


def date_range(df: DataFrame, ts: str, begin: str = "", end: str = "") -> DataFrame:
    """Rows from the begin day to the end of the end day; empty bounds are open, and begin must not be after end."""
    low, high = _day(begin), _day(end)
    if low and high and low > high:
        raise ValueError("the begin day is after the end day")
    if low:
        df = df.where(F.col(ts) >= F.lit(low).cast("timestamp"))
    return df.where(F.col(ts) < F.lit(high + timedelta(days=1)).cast("timestamp")) if high else df


def plan_recovery(batches: DataFrame, orders: DataFrame, preview: bool = True) -> DataFrame:
    """(batch_no, action, orders, order_ids) from batches (batch_no, status) and orders (batch_no, order_id, status, step, code_order_no).

    A batch listed as in_progress and as partial counts as in_progress. Such a batch waits for its paused orders; a partial one
    resumes its orders that failed in code_gen with a code number and an id, or only plans it in a preview. Batches
    without such orders give no row, and neither do blank batch numbers.
    """
    low = lambda c: F.lower(F.btrim(c))
    rank = F.when(low("status") == "in_progress", 1).when(low("status") == "partial", 2)
    seen = first_seen(batches.withColumn("__rank", rank).where("__rank is not null"), "batch_no", ["__rank"])
    rows = seen.select("batch_no", "__rank").join(
        orders.select("batch_no", "order_id", low("status").alias("s"), low("step").alias("p"), "code_order_no"), "batch_no"
    )
    resume: Column = (F.col("s") == "failed") & (F.col("p") == "code_gen") & (F.coalesce("code_order_no", F.lit("")) != "") & F.col("order_id").isNotNull()
    action = F.when((F.col("__rank") == 1) & (F.col("s") == "paused"), "WAIT_MANUAL_FLOW").when(
        (F.col("__rank") == 2) & resume, "PLAN_ONLY" if preview else "RESUME_CODE_GEN"
    )
    rows = rows.withColumn("action", action).where("action is not null")
    return rows.groupBy("batch_no", "action").agg(F.count("*").alias("orders"), F.array_sort(F.collect_list("order_id")).alias("order_ids"))
