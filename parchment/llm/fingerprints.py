"""SimHash fingerprints of 64 bits, and all of them within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm import kernels as K
from parchment.llm.storage import materialize
from parchment.runtime import ship

BITS = 64
#: fingerprints of a bucket that one task compares with another such block at once
BLOCK_ROWS = 512


def simhash(column: pa.Array, width: int = 3) -> np.ndarray:
    """One 64-bit fingerprint a row: each distinct ``width``-word shingle votes on every bit with weight log2(1 + count).

    A-Z are lowered; shorter texts are one shingle; texts without words and nulls have fingerprint 0.
    """
    out = []
    for _, data, offsets in K.blocks(column, K.BLOCK_BYTES // 2):
        n = len(offsets) - 1
        h, rows = K.word_hashes(data, offsets)
        g, times, rows = K.distinct(*K.shingles(h, rows, width), n)
        bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        weight = np.log2(1.0 + times).astype(np.float32)
        votes = K.row_reduce(np.add, np.where(bits, weight[:, None], -weight[:, None]), rows, np.float32(0))
        out.append(np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of two texts' shingle weights from their fingerprints' Hamming distance, 0 where negative."""
    return np.clip(np.cos(np.pi * np.bitwise_count(a ^ b) / BITS), 0.0, 1.0)


def _hex(values: np.ndarray) -> pa.Array:
    return pa.array([f"{x:016x}" for x in values.tolist()])


def edited_text(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first characters of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _fingerprint_pass(width: int, step: int = 512):
    """mapInArrow function over rows sorted by (part, order): every row with the one after it."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (id, text, part, tail); the last one only serves as the next of the one before."""
        texts = [t for _, t, _, _ in rows]
        made = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        own, new = simhash(pa.array(texts, pa.large_string()), width), simhash(pa.array(made, pa.large_string()), width)
        keep = [i for i in range(len(made)) if not rows[i][3]]
        pick = np.array(keep, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(made[i].encode()).hexdigest() for i in keep], pa.string()),
                pa.array(own[pick].view(np.int64)), pa.array(new[pick].view(np.int64)),
                pa.array(likeness(own[pick], new[pick])), pa.array(likeness(own[pick], own[pick + 1])),
            ],
            ["id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for row in zip(*(part.column(c).to_pylist() for c in ("id", "text", "part", "tail")), strict=True):
                    if held and held[-1][2] != row[2]:
                        if len(held) > 1:
                            yield work(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[1])
                    if len(held) > step or size > 1 << 21 and len(held) > 1:
                        yield work(held)
                        held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield work(held)

    return run


def _with_next(src: DataFrame, parts: int) -> DataFrame:
    """(id, text, part, tail): rows in ranges of the id, each range ending with a copy of the next range's first rows.

    Ranges begin at ids of the table, so the rows to copy are known by id; the last range ends with the first id.
    Their number is bounded by ``parts``.
    """
    src = src.withColumn("ord", F.coalesce("id", F.lit(-(1 << 63))))
    bounds = src.agg(F.min("ord"), F.percentile_approx("ord", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()
    starts = np.array(sorted({bounds[0], *(bounds[1] or [])} - {None}), np.int64)

    @F.pandas_udf("array<int>")
    def parts_of(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(starts, keys, "right") - 1
        head = starts[own] == keys
        return pd.Series([[i, (i - 1) % len(starts)] if first else [i] for i, first in zip(own.tolist(), head, strict=True)])

    placed = src.select("id", "ord", "text", F.posexplode(parts_of("ord")).alias("tail", "part"))
    placed = placed.withColumn("tail", F.col("tail") > 0)
    return placed.repartition(parts, "part").sortWithinPartitions("part", "tail", "ord", "text").drop("ord")


def near_counts(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp, n_near): for each distinct fingerprint, rows of ``prints`` (fp long) within ``radius`` bits, its own included.

    The bits are cut into ``blocks`` blocks; two fingerprints within the radius agree in blocks - radius of them, so
    each choice of that many blocks is a table keyed by their bits, and every such pair meets in some table. A pair
    counts only in the first table where it meets. Equal fingerprints are one row with a weight. Buckets are compared
    in blocks of bounded size, and pairs are counted where they meet, never emitted.
    """
    ship(prints.sparkSession)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    tables = np.array([sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)], np.uint64)
    signed = [int(x) for x in tables.view(np.int64)]
    same = prints.where("fp is not null").groupBy("fp").agg(F.count("*").cast("int").alias("weight"))
    keyed = same.select("fp", "weight", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "bits"))
    keyed = keyed.select("fp", "weight", F.col("t").cast("byte").alias("t"), F.xxhash64("t", "bits").alias("key"))
    crowd = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    n_blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    member = keyed.join(crowd, "key").withColumn("n", n_blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    member = member.select("fp", "weight", "t", "key", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    member = member.select("fp", "weight", "t", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def count(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(np.uint64)
        weight, block, t = table["weight"].to_numpy(), table["block"].to_numpy(), table["t"].to_numpy()
        sides = [np.flatnonzero(block == table[c][0].as_py()) for c in ("i", "j")]
        total = np.zeros(len(fp), np.int64)
        for p in sides[0]:
            qs = sides[1] if block[p] != table["j"][0].as_py() else sides[1][sides[1] > p]
            differ = fp[p] ^ fp[qs]
            near = (t[qs] == t[p]) & (np.bitwise_count(differ) <= radius)
            qs, differ = qs[near], differ[near]
            for m in tables[: t[p]]:
                met = (differ & m) == 0
                qs, differ = qs[~met], differ[~met]
            total[p] += weight[qs].sum()
            total[qs] += weight[p]
        hit = np.flatnonzero(total)
        return pa.table({"fp": pa.array(fp[hit].view(np.int64)), "n": pa.array(total[hit])})

    met = member.groupBy("key", "i", "j").applyInArrow(count, "fp long, n long")
    return same.select("fp", F.col("weight").cast("long").alias("n")).unionByName(met).groupBy("fp").agg(F.sum("n").alias("n_near"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    The edited text ends with the beginning of the next document by id (after the last, the first); of rows that
    repeat an id the order is by text, and rows without an id come first. n_near counts the documents whose
    fingerprint is within ``radius`` bits, the document itself included. Null texts are empty, and a text without words
    has fingerprint 0. A single document is its own next. An empty table gives no rows; other columns are ignored.

    Texts are exchanged once, into ranges of the id, and each range is read in order.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
    rows = materialize(_with_next(src, parts).mapInArrow(_fingerprint_pass(width), schema), "fingerprints")
    near = near_counts(rows.select("fp"), radius)
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(near, "fp").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", text("fp").alias("fingerprint"),
        text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )
