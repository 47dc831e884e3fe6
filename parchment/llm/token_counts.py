"""Exact token-length histogram of a corpus, with suffix sums for every context limit."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.runtime import ship

#: a public byte-level BPE vocabulary as base64 rank lines
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the public pattern that cuts a text before byte-pair merges
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def _encoding(ranks: bytes):
    import tiktoken

    key = hashlib.sha256(ranks).hexdigest()
    if key not in _loaded:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[key] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[key]


def _lengths(ranks: bytes):
    """mapInArrow function: texts to (n_tokens, docs), summed over each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks)
        total: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column("text").slice(at, 256).to_pylist():
                    n = len(encoding.encode_ordinary(text)) if text else 0
                    total[n] = total.get(n, 0) + 1
        keys = np.array(sorted(total), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([total[k] for k in keys.tolist()], pa.int64())], ["n_tokens", "docs"])

    return run


def length_histogram(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(n_tokens, docs): documents by the exact number of tokens of their whole text.

    Null and empty texts have length 0, repeated rows count each, an empty table gives no rows, and other columns are
    ignored. Each task sums its own histogram, so what is exchanged is bounded by the number of distinct lengths.
    """
    ship(docs.sparkSession)
    with open(ranks, "rb") as f:
        binary = f.read()
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(binary), "n_tokens long, docs long")
    return counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def length_sums(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, read as a context limit.

    n_tokens, docs, docs_upto and docs_over (documents within and beyond the limit), tokens_upto (tokens of those within),
    truncated_tokens (tokens left if all are cut at the limit), total_tokens and quantile (share of documents within). The
    windows run over distinct lengths, not documents.
    """
    upto = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("docs")
    out = histogram.select(
        "*", F.sum("docs").over(upto).alias("docs_upto"), F.sum(tokens).over(upto).alias("tokens_upto"),
        F.sum("docs").over(whole).alias("all_docs"), F.sum(tokens).over(whole).alias("total_tokens"),
    )
    over = F.col("all_docs") - F.col("docs_upto")
    return out.select(
        "n_tokens", "docs", "docs_upto", over.alias("docs_over"), "tokens_upto",
        (F.col("tokens_upto") + over * F.col("n_tokens")).alias("truncated_tokens"), "total_tokens",
        (F.col("docs_upto") / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at any limit, also one that is no length of the table."""
    row = sums.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "tokens_upto", "docs_over")).alias("x")).first().x
    if row is None:
        docs = sums.agg(F.sum("docs")).first()[0] or 0
        return docs * limit
    return row.tokens_upto + row.docs_over * limit


def length_quantile(sums: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of all documents don't exceed."""
    return sums.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]
