"""The corpus pipeline: low quality goes, near copies go, secrets are masked, sources are mixed, texts are encoded and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.llm.mixing import turn_of, weighted_mix
from parchment.llm.near_dedup import near_duplicates
from parchment.llm.pieces import encode_and_decode
from parchment.llm.quality_classifier import fit_quality, statistics
from parchment.llm.quality_rules import bind
from parchment.llm.secrets import redact_secrets
from parchment.llm.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 1 stay, with all their columns.

    Null and empty texts are judged by statistics that are all 0; texts of any length are read whole; the same text always
    gets the same verdict, so ties and repeated rows stay or go together. Null ids are judged like others. Without labels
    the score is 0.5 and all stay. An empty table gives no rows. Only text and, of documents and labels, doc_id are read,
    so other columns and their names don't matter.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(bind(statistics(F.col("text")), model.score) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Rows that repeat an id are one document: of them the row with the least text hash, then least text, stays (any of
    them if they are equal). Null and wordless texts are like nothing and stay, as do rows with a null id. Long texts
    count whole. An empty table gives no rows; other columns stay as they are and aren't read.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.where("doc_id is not null").join(kept, docs.doc_id == F.col("__id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return named.withColumn("__first", first).where("__first = 1").drop("__first").unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific secrets are masked in the texts and n_chars counts anew; all documents stay.

    Null and empty texts stay as they are, long texts are scanned whole, repeated rows and null ids are rows like others,
    a null source is an owner of its own. An empty table gives no rows; other columns stay as they are.
    """
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and wordless texts have size 0 and are never taken. Rows with the same id, or without an id the same text, and the
    same size take in order of their text's hash what the mix takes of such rows, the greatest first, so their sum is kept.
    Ties are as weighted_mix says. An empty table gives no rows; other columns stay as they are.
    """
    taken = weighted_mix(docs, with_turn=True).where("taken > 0").select(F.struct("turn", "size").alias("__key"), F.expr("taken div size").alias("n"))
    # of the rows with a key, how many the mix takes at least once and twice: the first rows are those
    taken = taken.groupBy("__key").agg(F.count("*").alias("__once"), F.count_if(F.col("n") > 1).alias("__twice"))
    size = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.struct(turn_of(F.col("doc_id"), F.col("text")).alias("turn"), size.alias("size")).alias("__key"), F.xxhash64("text").alias("__hash"))
    # numbered and joined by the same key, so that texts are exchanged once
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__hash"))
    both = rows.where("__key.size > 0").withColumn("__place", place).join(taken, "__key").where("__place <= __once")
    times = F.when(F.col("__place") <= F.col("__twice"), 2).otherwise(1)
    return both.select("__row", F.explode(F.sequence(F.lit(1), times))).select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, chunks and the pieces of every text, the text that they decode to, and round_trip.

    round_trip tells whether the decoded text is the text itself, null being empty; a mark U+2581 comes back as a space.
    Empty texts have no pieces; long ones are encoded in chunks with the result of the whole; repeated rows, equal texts
    and null ids are rows like others. An empty table gives no rows; columns other than doc_id, n_chars and text are dropped.
    """
    return encode_and_decode(docs).select(
        "doc_id", "n_chars", F.size("pieces").cast("long").alias("n_pieces"), "chunks", "pieces", "text",
        (F.sha2("text", 256) == F.col("digest")).alias("round_trip"),
    )


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: a fitted classifier and a tokenizer are beyond SQL; the tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next. parchment.runtime.sweep deletes their tables once the result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
