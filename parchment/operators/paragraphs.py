"""Ordered rows of a document: covers, duplicates, blanks, edges, heads, progress and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import fold
from parchment.runtime import materialize


def cover_block(paras: DataFrame, doc: str, order: str, text: str, is_title: Column, is_label: Column) -> DataFrame:
    """(doc, order, label): title rows whose next row that isn't blank is a label."""
    rows = paras.where(F.btrim(text) != "").select(doc, order, text, is_title.alias("t"), is_label.alias("l"))
    here = Window.partitionBy(doc).orderBy(order)
    rows = rows.select("*", F.lead(text).over(here).alias("label"), F.lead("l").over(here).alias("next"))
    return rows.where(F.col("t") & F.col("next")).select(doc, order, "label")


def duplicate_covers(paras: DataFrame, doc: str, order: str, page: str, is_title: Column, is_label: Column, is_blank: Column, reach: int = 10) -> DataFrame:
    """(doc, order, label_order, first, last): titles from page 2 on with a label within ``reach`` rows of the same page.

    The span to delete widens to all blank rows before it and to at most three after it. Row numbers must be without gaps.
    """
    rows = paras.select(doc, order, F.col(page).alias("page"), is_title.alias("t"), is_label.alias("l"), is_blank.alias("b"))
    here = Window.partitionBy(doc).orderBy(order)
    nth = Window.partitionBy(doc, "page").orderBy(order).rowsBetween(1, reach)
    ahead = here.rowsBetween(1, 3)
    rows = rows.select(
        "*",
        F.min(F.when(F.col("l"), F.col(order))).over(nth).alias("label_order"),
        F.max(F.when(~F.col("b"), F.col(order))).over(here.rowsBetween(Window.unboundedPreceding, -1)).alias("solid"),
        F.min(order).over(Window.partitionBy(doc)).alias("start"),
        F.min(F.when(~F.col("b"), F.col(order))).over(ahead).alias("next_solid"),
        F.max(order).over(ahead).alias("far"),
    )
    tail = rows.select(F.col(doc).alias("__doc"), F.col(order).alias("__order"), F.coalesce(F.col("next_solid") - 1, "far", F.col(order)).alias("last"))
    hits = rows.where(F.col("t") & (F.col("page") >= 2) & F.col("label_order").isNotNull())
    hits = hits.select(doc, order, "label_order", F.coalesce(F.col("solid") + 1, "start").alias("first"))
    return hits.join(tail, (F.col(doc) == F.col("__doc")) & (F.col("label_order") == F.col("__order"))).select(doc, order, "label_order", "first", "last")


#: a text of nothing but white space, as str.strip takes it
BLANK = r"\A[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\z"


def collapse_blanks(paras: DataFrame, doc: str, order: str, text: str, emptied: str) -> DataFrame:
    """(doc, order, text): without emptied rows; where a removal brings two blank rows together, the later one goes too.

    Removals act one after another in order. A row that isn't emptied goes if it is blank, the row before it is emptied, and the last
    row that stays before that is blank. That is blank if the last row that isn't emptied is: where that one goes itself, it is blank
    and so is the one it met. So a window tells all rows, without a group in Python.
    """
    here = Window.partitionBy(doc).orderBy(order)
    gone, blank = F.coalesce(F.col(emptied), F.lit(False)), F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(BLANK))
    rows = paras.select(doc, order, text, gone.alias("__gone"), blank.alias("__blank"))
    before = F.last(F.when(~F.col("__gone"), F.col("__blank")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    meets = F.lag("__gone").over(here) & F.col("__blank") & before
    rows = rows.withColumn("__meets", F.coalesce(meets, F.lit(False)))
    return rows.where(~F.col("__gone") & ~F.col("__meets")).select(doc, order, text)


def edges(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, last): the values at the ends of each group."""
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def head_per_key(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group, with their place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= n)


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key that isn't null or blank: the first in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.where(F.coalesce(F.btrim(F.col(key).cast("string")), F.lit("")) != "").withColumn("__n", n).where("__n = 1").drop("__n")


def with_index(df: DataFrame, key: str | None, order: str) -> DataFrame:
    """df with index, from 1 in folded order within the key; without a key the table itself is one ordered list.

    The whole table is numbered in ranges of the order, each beginning after the rows of those before it.
    """
    by = (fold(F.col(order)), F.col(order))
    if key:
        return df.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()), "index")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    out = ranged.join(F.broadcast(first), "__part")  # a row for each range
    return out.withColumn("index", (F.col("__first") + place).cast("int")).select(*df.columns, "index")


def order_folded(df: DataFrame, c: str) -> DataFrame:
    """Sorted by the folded value, then the value."""
    return df.orderBy(fold(F.col(c)), c)


def progress(events: DataFrame, run: str, order: list, seconds: Column, current: str, total: str, failures: str) -> DataFrame:
    """events with monotone current and failures, remaining and ETA in seconds (null until something is complete)."""
    here = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.max(current).over(here)
    out = events.withColumn("done", done).withColumn("failed", F.max(failures).over(here))
    out = out.withColumn("elapsed", seconds - F.min(seconds).over(Window.partitionBy(run)))
    out = out.withColumn("remaining", F.greatest(F.col(total) - F.col("done"), F.lit(0)))
    return out.withColumn("eta", F.when(F.col("done") > 0, F.col("elapsed") / F.col("done") * F.col("remaining")))
