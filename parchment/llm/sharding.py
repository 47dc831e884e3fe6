"""Shards of near-equal bytes by histogram sort: probe key boundaries, then exchange once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.storage import materialize
from parchment.runtime import ship

PROBES = 32


def shard_key(text: Column, doc_id: Column) -> Column:
    """A long whose upper 32 bits hash the text and whose lower 31 hash the id: equal texts are neighbours."""
    high = F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31), 32)
    return high + F.xxhash64(F.lit("shard"), doc_id).bitwiseAND(F.lit(0x7FFFFFFF))


def _counter(probes: np.ndarray):
    """mapInArrow function: bytes of each interval between probes, over all rows of a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            key, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "size"))
            np.add.at(total, np.searchsorted(probes, key, "right"), size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["slot", "bytes"])

    return count


def _between(a: int, b: int) -> set[int]:
    """Up to PROBES keys strictly between a and b: the least keys of texts if there are any, else any keys."""
    unit = 1 << 32 if (b - 1) // (1 << 32) > a // (1 << 32) else 1
    low, high = a // unit + 1, (b - 1) // unit
    n = min(PROBES, high - low + 1)
    return {(low + (high - low) * j // max(n - 1, 1)) * unit for j in range(n)} if n > 0 else set()


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float) -> list[int]:
    """Keys below which about i / n_shards of all bytes lie, within ``tolerance`` of a shard's bytes where keys allow it.

    Each round probes PROBES keys in every open bracket, counts exact bytes below each probe over all partitions
    (one small array a task), and narrows the bracket. Probes fall between texts until a bracket holds a single
    text, so a group of equal texts is cut only where it is larger than the tolerance.
    """
    lo, hi = -(1 << 63), (1 << 63) - 1
    total = keys.agg(F.sum("size")).first()[0] or 0
    brackets = {i: (lo, hi) for i in range(1, n_shards)}
    done: dict[int, int] = {}
    while brackets:
        probes = np.array(sorted(set().union(*(_between(a, b) for a, b in brackets.values()))), np.int64)
        counted = keys.mapInArrow(_counter(probes), "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect()
        sums = np.zeros(len(probes) + 1, np.int64)
        for slot, n in counted:
            sums[slot] += n
        below = dict(zip(probes.tolist(), np.cumsum(sums)[:-1].tolist(), strict=True))
        for i, (a, b) in list(brackets.items()):
            want = total * i / n_shards
            inside = [p for p in below if a < p < b]
            best = min(inside, key=lambda p: (abs(below[p] - want), p), default=a)
            if inside and abs(below[best] - want) <= tolerance * total / n_shards or b - a <= 1:
                done[i] = best if inside else b
                del brackets[i]
                continue
            brackets[i] = (max([a, *(p for p in inside if below[p] <= want)]), min([b, *(p for p in inside if below[p] > want)]))
    return sorted(done.values())


def _numberer(splitters: list[int]):
    """mapInArrow function over rows sorted by key: shard, and the row's place among the task's rows of that shard."""
    cuts = np.array(splitters, np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            shard = np.searchsorted(cuts, batch.column("key").to_numpy(zero_copy_only=False), "right")
            place = np.arange(len(shard)) - np.searchsorted(shard, shard) + seen[shard]
            seen += np.bincount(shard, minlength=len(seen))
            names = [*batch.schema.names, "shard", "place"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(place)], names)

    return number


def histogram_shards(keys: DataFrame, n_shards: int = 24, tolerance: float = 0.01) -> DataFrame:
    """keys (with key long, size long, and any other columns) with shard int and slot long.

    Shards are ranges of the key with near-equal bytes; slots count from 0 without gaps in key order. After the
    splitters are known, rows are exchanged once, into ranges of the key that are as many as shuffle partitions,
    so no task holds a whole shard; the ranges' row counts give each its first slot. Null keys aren't allowed;
    an empty table gives no rows.
    """
    spark = keys.sparkSession
    ship(spark)
    splitters = find_splitters(keys.select("key", "size"), n_shards, tolerance)
    schema = T.StructType([*keys.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = [c for c, kind in keys.dtypes if c not in ("key", "size") and kind in ("long", "bigint", "int", "string")]
    ranged = keys.repartitionByRange(parts, "key", *tie).sortWithinPartitions("key", *tie)
    ranged = materialize(ranged.mapInArrow(_numberer(splitters), schema).withColumn("part", F.spark_partition_id()), "shards")
    counts = ranged.groupBy("shard", "part").count()
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    out = ranged.join(F.broadcast(first), ["shard", "part"])  # at most a row for each partition and shard
    return out.select(*keys.columns, "shard", (F.col("first") + F.col("place")).alias("slot"))


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, tolerance: float = 0.01, with_text: bool = False
) -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null); text on demand.

    size is the UTF-8 length of the text plus 8. Equal texts are neighbours in key order, so they share a shard unless
    their group is too large for the balance. Null text counts as empty, null ids and repeated rows are rows like
    others (repeated rows tie, and either may have the lower slot), an empty table gives no rows, and columns other
    than the two are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_key(text, F.col(id_col)).alias("key"),
        *([F.col(text_col).alias("text")] if with_text else []),
    )
    rows = histogram_shards(materialize(keys, "keys"), n_shards, tolerance)
    return rows.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), *(["text"] if with_text else []),
    )
