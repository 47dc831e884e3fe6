"""Places and digests of rows in the order of their group, without a task or a row that holds a large group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parchment.runtime import materialize, ship

#: rows of a group that a window may sort in one task; larger groups are placed in ranges
WINDOW_ROWS = 1_000_000
#: values that one digest covers
CHUNK = 4096
#: levels of the digest tree: CHUNK ** 4 rows are more than any table has
LEVELS = 4
#: values that are joined to one row before a digest runs over the rows
PIECE = 64


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def places(df: DataFrame, keys: list[str], order: list, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """df with place (from 0) and total, longs, of each row in the given total order of its group.

    If the largest group has at most ``window_rows`` rows, a window numbers them. Otherwise rows are sorted into ranges of key and
    order, where their numbers run on; counts of each group and range, at most as many for a group as there are ranges, tell where
    the range begins in the group. Both give the same places. Null keys make a group; rows that tie take places in any order.
    """
    if _largest_group(df, keys) <= window_rows:
        here = Window.partitionBy(*keys)
        return df.withColumn("place", F.row_number().over(here.orderBy(*order)).cast("long") - 1).withColumn("total", F.count("*").over(here))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # the id's upper bits are the range, its lower 33 count the range's rows in order
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "places").withColumn("__part", F.shiftright("__at", 33))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    per = ranged.groupBy(*named, F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))])
    before = F.coalesce(F.sum("__n").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__before", before).withColumn("total", F.sum("__n").over(group))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranged.join(per, same).withColumn("place", F.col("__at") - F.col("__first") + F.col("__before")).select(*df.columns, "place", "total")


def digest_tree(df: DataFrame, keys: list[str], order: list, value: Column, sums: dict[str, Column] | None = None, chunk: int = CHUNK, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(keys, n, sums, fingerprint): a SHA-256 over each group's values in order, one a line, as a tree of chunks.

    Chunks of ``chunk`` values are digested by themselves; the digests of a group with several chunks are values again, until one is
    left (``chunk`` is at least 2). A group of one chunk thus has the digest of its values. Null values are left out of the digest but counted.
    """
    named = {f"__s{i}": c for i, c in enumerate((sums or {}).values())}
    rows = df.select(*keys, F.struct(*order).alias("__order"), value.cast("string").alias("__value"), *[c.alias(n) for n, c in named.items()])
    level = places(rows, keys, ["__order"], window_rows).select(*keys, "place", "__value", *named, F.lit(1).cast("long").alias("n"))
    totals = [F.sum(x).alias(x) for x in ("n", *named)]
    for i in range(LEVELS):
        inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "__value"))), lambda x: x["__value"])
        up = level.withColumn("__chunk", F.floor(F.col("place") / chunk)).groupBy(*keys, "__chunk").agg(inside.alias("__in"), *totals, F.count("*").alias("__size"))
        digest = F.sha2(F.array_join("__in", "\n"), 256)
        if i:  # a first node by itself is its group's root and stays as it is
            digest = F.when((F.col("__chunk") == 0) & (F.col("__size") == 1), F.col("__in")[0]).otherwise(digest)
        level = up.select(*keys, F.col("__chunk").alias("place"), digest.alias("__value"), *named, "n")
    return level.select(*keys, "n", *[F.col(n).alias(x) for n, x in zip(named, sums or {}, strict=True)], F.col("__value").alias("fingerprint"))


def _chain():
    """mapInArrow function: pieces (..., text, filled, first, last) in the order of their groups; fingerprint, with a group's last piece, takes the place of these four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = hashlib.sha256(), False
        for batch in batches:
            rest, out = batch.num_columns - 4, []
            for text, filled, first, last in zip(*batch.columns[rest:], strict=True):
                if first.as_py():
                    state, begun = hashlib.sha256(), False
                if filled.as_py():
                    state.update((b"\n" if begun else b"") + text.as_py().encode())
                    begun = True
                out.append(state.hexdigest() if last.as_py() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:rest], pa.array(out, pa.string())], [*batch.schema.names[:rest], "fingerprint"])

    return run


def digest_chain(df: DataFrame, keys: list[str], order: list, value: Column, sums: dict[str, Column] | None = None, piece: int = PIECE, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(keys, n, sums, fingerprint): the SHA-256 over all of each group's values in order, one a line, whatever the group's size.

    Values are placed and joined to pieces of ``piece`` values over all tasks. A SHA-256 goes from one block to the next, so one task
    reads a group's pieces, in order and in batches, and holds none but the batch. Null values are left out of the digest but counted.
    """
    named = {f"__s{i}": c for i, c in enumerate((sums or {}).values())}
    rows = df.select(*keys, F.struct(*order).alias("__order"), value.cast("string").alias("__value"), *[c.alias(n) for n, c in named.items()])
    rows = places(rows, keys, ["__order"], window_rows).withColumn("__piece", F.floor(F.col("place") / piece))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "__value"))), lambda x: x["__value"])
    held = rows.groupBy(*keys, "__piece").agg(
        inside.alias("__in"), F.count("*").alias("__n"), F.max("total").alias("__total"), F.count("__value").alias("__filled"), *[F.sum(x).alias(x) for x in named]
    )
    held = held.select(
        *keys, "__piece", "__n", *named, F.array_join("__in", "\n").alias("__text"), (F.col("__filled") > 0).alias("__some"),
        (F.col("__piece") == 0).alias("__first"), ((F.col("__piece") + 1) * piece >= F.col("__total")).alias("__last"),
    )
    ship(df.sparkSession)
    kept = [*keys, "__n", *named]
    schema = StructType([*held.select(*kept).schema, StructField("fingerprint", StringType())])
    held = held.repartition(*keys).sortWithinPartitions(*keys, "__piece").select(*kept, "__text", "__some", "__first", "__last")
    totals = [F.sum("__n").alias("n"), *[F.sum(n).alias(x) for n, x in zip(named, sums or {}, strict=True)]]
    return held.mapInArrow(_chain(), schema).groupBy(*keys).agg(*totals, F.max("fingerprint").alias("fingerprint"))
