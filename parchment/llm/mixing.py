"""Mixing sources to target weights by weighted fair queueing, in native DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: rows of a source whose running sum one task makes
SLICE_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size): water-filling of budget * all sizes by weight.

    Sources ordered by code point (null last) get the weights in turn. No target exceeds cap * its source's size;
    the excess is shared again by weight. The window runs over the table of sources, not over documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    out = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int") + 1).cast("long"))
    out = out.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    out = out.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("given"),
        F.sum("w").over(after).alias("rest_w"),
        (F.sum("source_size").over(whole) * F.lit(float(budget))).alias("total"),
    )
    out = out.withColumn("capped", F.col("most") * F.col("rest_w") <= F.col("w") * (F.col("total") - F.col("given")))
    rest = out.withColumn("given", F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0.0)))
    rest = rest.withColumn("rest_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole))
    share = F.col("w") * (F.col("total") - F.col("given")) / F.col("rest_w")
    return rest.select("skey", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(share).alias("target"))


def _cut(entries: DataFrame, budget: float) -> tuple | None:
    """(finish, skey) of the last entry that fits, when all are sorted by these and truncated at budget; None if none fits.

    Entries are range-sorted over all tasks; each range adds the sizes of the ranges before it to its running sum.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(parts, "finish", "skey").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.sum("size").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    here = Window.partitionBy("part").orderBy("finish", "skey").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(F.broadcast(offsets), "part").withColumn("upto", F.col("offset") + F.sum("size").over(here))  # a row for each range
    return upto.where(F.col("upto") <= budget).agg(F.max(F.struct("finish", "skey"))).first()[0]


def turn_of(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """The shuffle key of a document: MD5 of seed and id, or of the text where the id is null."""
    nameless = F.concat(F.lit("text-"), F.md5(F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(F.lit(seed + "-"), F.coalesce(doc_id.cast("string"), nameless)))


def weighted_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    passes: int = 2,
    seed: str = "mix",
    with_turn: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target and taken (words the mix takes, repeats counted); turn, its shuffle key, on demand.

    Each source queues its documents ``passes`` times, each time in the same shuffled order (MD5 of seed and id).
    An entry's virtual finish time is the source's running words divided by its target; all entries are range-sorted by
    it and truncated where the running total passes the budget, so every source comes near its target.

    Running sums of a source are made in slices by the first digits of the shuffle key with the slices' totals
    added, so that a source with a third of all rows is many small windows. Null text has size 0 and takes nothing;
    a null source is a source of its own, ordered last; null ids take their turns by a hash of the text. Repeated rows are
    entries of their own, one behind the other, so the mix may take one of them and not the next; finish times in a
    source differ, and equal ones of two sources go by source. An empty table gives no rows. Other columns are ignored.
    """
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        turn_of(F.col(id_col), F.col(text_col), seed).alias("turn"),
    )
    base = materialize(base, "mix")
    digits = max(0, math.ceil(math.log(max(base.count(), 1) / SLICE_ROWS, 16)))
    base = base.withColumn("slice", F.substring("turn", 1, digits))
    sums = materialize(base.groupBy("skey", "source", "slice").agg(F.sum("size").alias("tokens")), "mix")
    targets = source_targets(sums.groupBy("skey", "source").agg(F.sum("tokens").alias("source_size")), weights, budget, passes)
    earlier = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "slice", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, "skey")
    here = Window.partitionBy("skey", "slice").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = base.join(offsets, ["skey", "slice"]).withColumn("upto", F.col("offset") + F.sum("size").over(here))
    queue = materialize(queue.select("id", "source", "skey", "turn", "size", "source_size", "target", "upto"), "mix")

    def finish(i: int | Column) -> Column:
        return F.try_divide(F.col("upto") + F.col("source_size") * i, F.col("target"))

    entries = queue.where("size > 0").select("skey", "size", F.explode(F.array(*[finish(i) for i in range(passes)])).alias("finish"))
    total = queue.agg(F.sum("size")).first()[0] or 0
    at, skey = _cut(entries, total * budget) or (-1.0, "")

    def fits(i: int) -> Column:
        same = (finish(i) == F.lit(at)) & (F.col("skey") <= F.lit(skey))
        return F.coalesce((finish(i) < F.lit(at)) | same, F.lit(False)).cast("long")

    taken = F.col("size") * sum((fits(i) for i in range(1, passes)), fits(0))
    return queue.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), *(["turn"] if with_turn else [])
    )


#: the same mix in DuckDB SQL, with one window over each source
SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-' || coalesce(doc_id::VARCHAR, 'text-' || md5(coalesce(text, '')))) AS turn
  FROM documents),
sources AS (
  SELECT skey, source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w
  FROM base GROUP BY skey, source),
filled AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
         sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM sources WINDOW r AS (ORDER BY source_size * 2.0::DOUBLE / w, encode(source) NULLS LAST)),
marked AS (SELECT *, most * rest_w <= w * (total - given) AS capped FROM filled),
targets AS (
  SELECT skey, source_size, total, CASE WHEN capped THEN most ELSE
         w * (total - coalesce(sum(most) FILTER (capped) OVER (), 0)) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target
  FROM marked),
queue AS (
  SELECT b.*, t.source_size, t.target, t.total,
         (sum(size) OVER (PARTITION BY b.skey ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM base b JOIN targets t USING (skey)),
entries AS (
  SELECT q.*, p, (upto + source_size * p)::DOUBLE / nullif(target, 0) AS finish FROM queue q, range(2) r(p)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, skey, turn) <= total AS fits FROM entries WHERE size > 0)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target,
       coalesce(sum(c.size) FILTER (c.fits), 0)::BIGINT AS taken
FROM queue q LEFT JOIN cut c ON q.doc_id IS NOT DISTINCT FROM c.doc_id AND q.upto = c.upto AND q.skey = c.skey
GROUP BY q.doc_id, q.source, q.size, q.source_size, q.target, q.upto
"""
