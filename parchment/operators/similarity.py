"""Joins on content: vocabularies, categories, relevance across projects, similar images, topic conflicts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from parchment.functions.media import hamming
from parchment.functions.text import fold, semantic_tokens
from parchment.operators.terms import TermIndex, index_of, listed_terms, shared_terms, term_hits
from parchment.runtime import materialize, ship

#: tokens that references may have in all to be broadcast: a few dozen MB
MOST_TOKENS = 1_000_000


def category_mismatch(docs: DataFrame, rules: list[tuple[str, tuple[str, ...]]], key: str, title: str, text: str) -> DataFrame:
    """(key, category): the text holds the category's phrase, but the title none of its keywords."""
    found = []
    for phrase, words in rules:
        allowed = F.lit(False)
        for w in words:
            allowed = allowed | F.col(title).contains(w)
        found.append(F.when(F.col(text).contains(phrase) & ~allowed, F.lit(phrase)))
    return docs.select(key, F.explode(F.array_compact(F.array(*found))).alias("category"))


def token_sets(df: DataFrame, key: str, text: str, stop: tuple[str, ...]) -> DataFrame:
    """(key, token, n): one row for each token of a text's set, with the set's size."""
    sets = df.select(key, semantic_tokens(F.col(text), stop).alias("tokens"))
    return sets.select(key, F.explode("tokens").alias("token"), F.size("tokens").alias("n"))


@dataclass(frozen=True)
class ReferenceIndex:
    """Token sets of the references, in ascending order of the references: which of them hold each token, and how many tokens they have."""

    refs: pa.Array
    names: pa.Array  # the references as text
    tokens: pa.Array
    starts: np.ndarray  # token to its first holder and the end
    holders: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(cls, rows: pa.Table) -> ReferenceIndex:
        """Rows are (ref, name, tokens), ascending by ref."""
        refs, names, sets = (rows.column(c).combine_chunks() for c in ("ref", "name", "tokens"))
        coded = sets.flatten().dictionary_encode()
        sizes = pc.list_value_length(sets).to_numpy()
        place = coded.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(coded.dictionary) + 1))
        return cls(refs, names, coded.dictionary, starts, np.repeat(np.arange(len(refs)), sizes)[order], sizes)

    def scores(self, sets: pa.ListArray) -> np.ndarray:
        """(text, reference): common tokens over the geometric mean of the set sizes, 0 where none is common."""
        sizes = pc.list_value_length(sets).to_numpy()
        at = pc.index_in(sets.flatten(), self.tokens).fill_null(-1).to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
        at = at[at >= 0]
        n = self.starts[at + 1] - self.starts[at]
        held = self.holders[np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)]
        common = np.bincount(np.repeat(text, n) * len(self.refs) + held, minlength=len(sizes) * len(self.refs)).reshape(len(sizes), -1)
        return common / np.sqrt(np.maximum(np.outer(sizes, self.sizes), 1).astype(np.float64))

    def steps(self, sets: pa.ListArray, cells: int = 1_000_000) -> list[tuple[int, int]]:
        """(first text, number of texts) of steps whose scores, and whose tokens times holders, are at most ``cells``, or that are one text."""
        sizes = pc.list_value_length(sets).to_numpy()
        at = pc.index_in(sets.flatten(), self.tokens).fill_null(-1).to_numpy()
        n = np.where(at >= 0, self.starts[at + 1] - self.starts[at], 0)
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(sizes))]
        out, i, wide = [], 0, max(1, cells // len(self.refs))
        while i < len(sizes):
            stop = int(np.searchsorted(ends, ends[i] + cells, "right")) - 1
            stop = min(max(stop, i + 1), i + wide, len(sizes))
            out.append((i, stop - i))
            i = stop
        return out

    def best(self, sets: pa.ListArray, own: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text's own reference, the greatest other score and its reference, or -1; ties go to the higher one."""
        scores, mine = self.scores(sets), pc.index_in(own, self.names).fill_null(-1).to_numpy()
        rows = np.flatnonzero(mine >= 0)
        own_score = np.zeros(len(scores))
        own_score[rows] = scores[rows, mine[rows]]
        scores[rows, mine[rows]] = 0.0
        scores[own.is_null().to_numpy(zero_copy_only=False)] = 0.0
        place = scores.shape[1] - 1 - scores[:, ::-1].argmax(axis=1)
        other = scores[np.arange(len(scores)), place]
        return own_score, other, np.where(other > 0, place, -1)


def _scored_by(shared: Broadcast, ref_type: pa.DataType):
    """mapInArrow function: (row, own, tokens) to (row, own_score, best_other, best_ref), in steps of bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i, step in index.steps(batch.column(2)):
                rows, own, sets = batch.slice(i, step).columns
                mine, other, place = index.best(sets, own)
                found = index.refs.take(pa.array(place, mask=place < 0)).cast(ref_type)
                yield pa.RecordBatch.from_arrays([rows, pa.array(mine), pa.array(other), found], ["row", "own_score", "best_other", "best_ref"])

    return run


#: rarest tokens of a text that the first round looks up; each round reaches four times as far
FIRST_TOKENS = 8


def _scored_by_rounds(rows: DataFrame, sets: DataFrame, emitted: list[int] | None = None, first: int = FIRST_TOKENS) -> DataFrame:
    """As _scored_by, for references of any number: the best other reference of each text by rounds over its tokens, the rarest first.

    A reference y whose score with text x reaches t shares at least t * t * |x| tokens with it, as the score is at most sqrt(common / |x|).
    So it holds one of the text's tokens but for the last ceil(t * t * |x|) - 1, the most frequent ones. Each round looks up the next
    tokens of those texts whose best score so far doesn't rule them out, scores the references found in full, and raises the bound.
    Frequent tokens are thus looked up only for texts that are like nothing. ``emitted`` gets the number of pairs of each round.
    """
    a = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "relevance")
    held = materialize(sets.select("ref", "name", F.explode("tokens").alias("token")), "tokens")
    often = held.groupBy("token").agg(F.count("*").alias("often"))
    each = a.select("id", F.explode("tokens").alias("token")).join(often, "token")
    ranked = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    none = F.array().cast(ranked.schema["ranked"].dataType)
    size = F.size("tokens")
    share = F.size(F.array_intersect("tokens", "other")) / F.sqrt((size * F.size("other")).cast("double"))
    names = sets.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("other"))
    mine = F.when((size > 0) & (F.size("other") > 0), share)
    state = a.join(ranked, "id", "left").join(names, a.own == names.name, "left").select("id", "own", "tokens", F.coalesce("ranked", none).alias("ranked"), mine.alias("own_score"))
    kind = sets.schema["ref"].dataType.simpleString()
    state = materialize(state.withColumn("best", F.lit(None).cast(f"struct<score: double, ref: {kind}>")), "scores")
    score = F.coalesce("best.score", F.lit(0.0))
    # a hair less, so that rounding rules out nothing
    reach = F.size("ranked") + 1 - F.ceil(score * score * size * (1 - 1e-9)).cast("int")
    low, high = 0, first
    while True:
        more = state.where((F.col("own").isNotNull()) & (F.size("ranked") > low) & (reach > low))
        if more.isEmpty():
            break
        few = F.slice("ranked", F.lit(low + 1), F.least(reach, F.lit(high)) - low)
        pairs = more.select("id", "own", F.explode(few).alias("x")).select("id", "own", F.col("x.token").alias("token")).join(held, "token")
        pairs = materialize(pairs.where("name <> own").select("id", "ref").distinct(), "pairs")
        if emitted is not None:
            emitted.append(pairs.count())
        scored = pairs.join(sets.select("ref", F.col("tokens").alias("other")), "ref").join(more.select("id", "tokens"), "id")
        found = scored.groupBy("id").agg(F.max(F.struct(share.alias("score"), "ref")).alias("found"))
        better = F.greatest("best", F.col("found").cast(f"struct<score: double, ref: {kind}>"))
        state = materialize(state.join(found, "id", "left").withColumn("best", better).drop("found"), "scores")
        low, high = high, 4 * high
    zero = F.lit(0.0)
    out = a.select("id", "row").join(state.select("id", "own_score", "best"), "id")
    return out.select("row", F.coalesce("own_score", zero).alias("own_score"), F.coalesce("best.score", zero).alias("best_other"), F.col("best.ref").alias("best_ref"))


def batch_relevance(
    texts: DataFrame, refs: DataFrame, key: str, own: str, ref: str, text: str, ref_text: str, stop: tuple[str, ...], most_tokens: int = MOST_TOKENS
) -> DataFrame:
    """(key, own_score, best_other, best_ref, status, confidence, reason) of each text against all references.

    texts have ``own``, the reference they belong to. Scores are common tokens over the geometric mean of the set sizes.
    Ties between others go to the higher reference. References with up to ``most_tokens`` tokens in all are broadcast as an
    index, so that texts are scored where they are, without a shuffle; more are looked up by the rarest tokens first, see _scored_by_rounds.

    Null and blank texts score 0 and are unknown; long texts count whole. Rows that repeat a key are rows of their own; rows
    that repeat a reference are one with the tokens of all; null references are left out, and a text whose ``own`` is null
    has neither an own score nor another. Without references all scores are 0.
    """
    sets = refs.where(F.col(ref).isNotNull()).select(F.col(ref).alias("ref"), semantic_tokens(F.col(ref_text), stop).alias("tokens"))
    sets = sets.groupBy("ref").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tokens", F.array().cast("array<string>"))))).alias("tokens"))
    sets = materialize(sets.select("ref", F.col("ref").cast("string").alias("name"), "tokens"), "references")
    tokens = F.coalesce(semantic_tokens(F.col(text), stop), F.array().cast("array<string>"))
    rows = texts.select(F.struct(F.col(key).alias("key"), (F.coalesce(F.btrim(text), F.lit("")) == "").alias("blank")).alias("row"), F.col(own).cast("string").alias("own"), tokens.alias("tokens"))
    size = sets.agg(F.count("*").alias("refs"), F.coalesce(F.sum(F.size("tokens") + 1), F.lit(0)).alias("tokens")).first()
    if 0 < size.refs and size.tokens <= most_tokens:
        spark = texts.sparkSession
        ship(spark)
        index = spark.sparkContext.broadcast(ReferenceIndex.build(sets.orderBy("ref").toArrow()))
        schema = StructType([rows.schema["row"], *(StructField(x, DoubleType()) for x in ("own_score", "best_other")), StructField("best_ref", sets.schema["ref"].dataType)])
        out = rows.mapInArrow(_scored_by(index, to_arrow_type(sets.schema["ref"].dataType)), schema)
    else:
        out = _scored_by_rounds(rows, sets)
    blank = F.col("row.blank")
    relevant = F.col("own_score") >= 0.08
    foreign = (F.col("best_other") >= 0.08) & (F.col("best_other") - F.col("own_score") >= 0.05)
    status = F.when(blank, "unknown").when(relevant, "relevant").when(foreign, "irrelevant").otherwise("unknown")
    confidence = (
        F.when(blank, 0.0).when(relevant, F.least(F.lit(0.99), F.col("own_score") + 0.85))
        .when(foreign, F.least(F.lit(0.99), F.col("best_other") + 0.86)).otherwise(0.4)
    )
    reason = (
        F.when(blank, "no text").when(relevant, F.format_string("like its own reference (%.3f)", "own_score"))
        .when(foreign, F.format_string("more like %s (%.3f) than its own reference (%.3f)", F.col("best_ref").cast("string"), "best_other", "own_score")).otherwise("too little in common with any")
    )
    return out.select(F.col("row.key").alias(key), "own_score", "best_other", "best_ref", status.alias("status"), confidence.alias("confidence"), reason.alias("reason"))


def similar_to_first(media: DataFrame, key: str, order: str, hash_: str, max_dist: int = 6) -> DataFrame:
    """(key, first, order, distance): later images of a group within ``max_dist`` bits of the first one."""
    head = media.groupBy(key).agg(F.min(order).alias("first"), F.min_by(hash_, order).alias("__hash"))
    rows = media.join(head, key).where(F.col(order) > F.col("first"))
    return rows.select(key, "first", order, hamming(F.col(hash_), F.col("__hash")).alias("distance")).where(F.col("distance") <= max_dist)


def _counter(shared: Broadcast, topics: list[str], vocabulary: int):
    """mapInArrow function: (key, title, body, late) to key, terms of title or body, hits of topics, and counts of generic terms.

    The broadcast terms are those of the topics, then the generic ones. One pass over the body, and one over its late part if the
    title holds a term.
    """

    def row(index: TermIndex, title: str, body: str, late: str):
        titled, hits = index.counts(title), index.counts(body)
        after = index.counts(late) if any(i < vocabulary for i in titled) else {}
        terms = [{"topic": topics[i], "hits": hits.get(i, 0), "late": after.get(i, 0)} for i in sorted(titled) if i < vocabulary]
        per: dict[str, int] = {}
        for i, n in hits.items():
            if i < vocabulary:
                per[topics[i]] = per.get(topics[i], 0) + n
        return terms, [{"topic": t, "hits": n} for t, n in per.items()], [hits.get(i, 0) for i in range(vocabulary, index.size)]

    kinds = [pa.list_(pa.struct([("topic", pa.string()), ("hits", pa.int32()), ("late", pa.int32())])), pa.list_(pa.struct([("topic", pa.string()), ("hits", pa.int32())])), pa.list_(pa.int32())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(shared)
        for batch in batches:
            texts = zip(*(batch.column(i) for i in (1, 2, 3)), strict=True)
            rows = [row(index, *(x.as_py() or "" for x in r)) for r in texts]
            values = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["key", "titled", "topics", "generic"])

    return count


def topic_conflict(
    docs: DataFrame, key: str, title: str, paragraphs: str, topics: dict[str, list[str]], generic: tuple[str, ...], early: int = 10, least_chars: int = 80
) -> DataFrame:
    """(key, status, reason, title_hits, absent, strongest_other): whether the body speaks of another topic than the title.

    docs have an array of paragraphs. The title's own repetitions are removed (case aside) before counting. Evidence for a
    reviewer only: unknown, or review_topic_mismatch; reason says why. All terms are counted in one pass over a text, so neither
    plan nor cost grow with the vocabulary.
    """
    low_title = fold(F.coalesce(F.col(title), F.lit("")))
    strip = lambda c: F.when(low_title == "", fold(c)).otherwise(F.replace(fold(c), low_title, F.lit("")))
    body = strip(F.array_join(paragraphs, "\n"))
    late = strip(F.array_join(F.slice(paragraphs, early + 1, 1 << 30), "\n"))
    listed = listed_terms(topics)
    shared = shared_terms(docs.sparkSession, [x for _, x in listed] + list(generic))
    head = F.struct(F.col(key).alias("key"), (F.length(F.btrim(body)) < least_chars).alias("short"))
    rows = docs.select(head.alias("key"), low_title.alias("title"), body.alias("body"), late.alias("late"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, titled array<struct<topic: string, hits: int, late: int>>, topics array<struct<topic: string, hits: int>>, generic array<int>"
    rows = rows.mapInArrow(_counter(shared, [t for t, _ in listed], len(listed)), schema)
    total = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0), lambda s, x: s + x)
    own = F.transform("titled", lambda x: x["topic"])
    strongest = F.array_max(F.transform("topics", lambda x: F.when((x["hits"] >= 5) & ~F.array_contains(own, x["topic"]), x["hits"]).otherwise(0)))
    rows = rows.select(
        F.col("key.key").alias(key), F.col("key.short").alias("short"), F.size("titled").alias("terms"), total(F.col("titled"), lambda x: x["hits"]).alias("title_hits"),
        F.size(F.filter("titled", lambda x: x["hits"] == 0)).alias("absent"), total(F.col("titled"), lambda x: x["late"]).alias("late_hits"),
        F.coalesce(strongest, F.lit(0)).alias("strongest_other"), total(F.col("generic"), lambda x: x).alias("ops"), F.coalesce(F.array_min("generic"), F.lit(0)).alias("least_op"),
    )
    strong, hits = F.col("strongest_other"), F.col("title_hits")
    conflict = (strong > 0) & ((F.col("absent") >= 2) | ((hits <= 3) & (strong >= 8)) | ((strong >= 8) & (strong > hits) & (F.col("late_hits") <= 1)))
    bland = (F.col("absent") == F.col("terms")) & (F.col("ops") >= 20) & (F.col("least_op") > 0)
    judged = ~F.col("short") & (F.col("terms") > 0)
    status = F.when(judged & (conflict | bland), "review_topic_mismatch").otherwise("unknown")
    reason = (
        F.when(F.col("short"), "too little text").when(F.col("terms") == 0, "no term in the title").when(conflict, "another topic is stronger than the title's")
        .when(bland, "only generic terms, none of the title's").otherwise("no conflict found")
    )
    return rows.select(key, status.alias("status"), reason.alias("reason"), "title_hits", "absent", "strongest_other")


def mentions(df: DataFrame, key: str, text: str, terms: dict[str, str]) -> DataFrame:
    """(key, one flag a term): whether any text of the key holds the term."""
    return df.groupBy(key).agg(*[F.bool_or(F.coalesce(F.col(text).contains(t), F.lit(False))).alias(n) for n, t in terms.items()])


def late_hits(paras: DataFrame, key: str, order: str, text: str, topics: dict[str, list[str]], early: int = 10) -> DataFrame:
    """term_hits of what follows a document's first ``early`` paragraphs, summed."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    late = paras.withColumn("__n", n).where(F.col("__n") > early)
    return term_hits(late, key, text, topics).groupBy(key, "topic", "term").agg(F.sum("hits").alias("hits"))
