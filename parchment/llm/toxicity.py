"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, and calibrated votes that weigh by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm import kernels as K
from parchment.llm.quality_classifier import held_out
from parchment.llm.storage import materialize
from parchment.runtime import ship

#: examples in a block of an index
BLOCK = 64
#: terms that more than this share of the examples hold have no posting list: they are read block by block
OFTEN, MOST_OFTEN = 1 / 32, 256
#: texts that are searched for at once
QUERIES = 64
#: nearest examples that vote: a few, which tell where there are few examples at all, and more
NEAREST = (10, 75)
PROOFS = 3


def _terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, their counts, and the first index of each text and the end."""
    n = len(offsets) - 1
    h, rows = K.term_hashes(data, offsets)
    return K.distinct(h, np.repeat(np.arange(n), np.diff(rows)), n)


def _known(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _terms_of, with places in the ascending vocabulary for terms; others are left out."""
    g, times, rows = _terms_of(data, offsets)
    if not len(vocabulary):
        return np.zeros(0, np.int64), times[:0], np.zeros_like(rows)
    at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
    here = vocabulary[at] == g
    return at[here], times[here], np.append(0, np.cumsum(here))[rows]


def _lists(rows: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values, kind))


def _example_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, terms, times): all terms of the texts."""
    for batch in batches:
        for row, data, offsets in K.blocks(batch.column("text")):
            g, times, rows = _terms_of(data, offsets)
            rest = [batch.column(c).slice(row, len(offsets) - 1) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays(
                [*rest, _lists(rows, g.view(np.int64), pa.int64()), _lists(rows, times, pa.int32())], ["id", "label", "terms", "times"]
            )


def _text_counter(shared: Broadcast):
    """mapInArrow function: (text) to (place, texts), for a whole task the number of texts that hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        texts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, data, offsets in K.blocks(batch.column("text")):
                texts += np.bincount(_known(vocabulary, data, offsets)[0], minlength=len(vocabulary))
        held = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(texts[held])], ["place", "texts"])

    return count


def unit_weights(places: np.ndarray, times: np.ndarray, rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights (1 + ln count) * idf of each text, divided by the text's length as a vector."""
    w = (1.0 + np.log(times)) * idf[places]
    length = np.sqrt(K.row_reduce(np.add, w * w, rows, 0.0))
    return w / np.repeat(np.where(length > 0, length, 1.0), np.diff(rows))


@dataclass(frozen=True)
class BlockMaxIndex:
    """Unit vectors of the examples, in blocks of examples that share their heaviest frequent term.

    Rare terms have posting lists. Frequent ones are rows of a matrix, with their greatest weight in each block.
    """

    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # term to its first posting and the end
    owners: np.ndarray
    weights: np.ndarray
    slot: np.ndarray  # term to its column among the frequent ones, or -1
    often: np.ndarray  # (example, frequent term): weight
    peaks: np.ndarray  # (frequent term, block): greatest weight

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, places: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_terms: int) -> BlockMaxIndex:
        n = len(ids)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(rows))
        texts = np.bincount(places, minlength=n_terms)
        frequent = np.argsort(-texts, kind="stable")[:MOST_OFTEN]
        frequent = frequent[texts[frequent] > n * OFTEN]
        slot = np.full(n_terms, -1, np.int16)
        slot[frequent] = np.arange(len(frequent))
        dense = slot[places] >= 0
        often = np.zeros((n, max(len(frequent), 1)), np.float32)
        often[owner[dense], slot[places[dense]]] = weights[dense]
        order = np.lexsort((ids, -often.max(axis=1), often.argmax(axis=1)))
        owner, often = np.argsort(order).astype(np.int32)[owner], often[order]
        blocks = -(-n // BLOCK)
        peaks = np.zeros((often.shape[1], blocks), np.float32)
        for b in range(blocks):
            peaks[:, b] = often[b * BLOCK : (b + 1) * BLOCK].max(axis=0)
        place, owner, weights = places[~dense], owner[~dense], weights[~dense]
        by_term = np.lexsort((owner, place))
        starts = np.searchsorted(place[by_term], np.arange(n_terms + 1, dtype=np.int32)).astype(np.int32)
        return cls(ids[order], labels[order], starts, owner[by_term], weights[by_term].astype(np.float32), slot, often, peaks)

    def search(self, places: np.ndarray, weights: np.ndarray, rows: np.ndarray, k: int, leave: bool) -> tuple[np.ndarray, np.ndarray]:
        """(text, example) cosines, those of the k nearest examples exact and -1 where a block could not hold one of them; and which blocks were read.

        Rare terms are summed from their posting lists. What frequent terms can add is bounded by their peaks in each
        block: the blocks with the greatest bounds are read first, then those whose bound reaches the k-th best cosine
        of these. ``leave`` leaves out examples with the query's own vector.
        """
        m, n = len(rows) - 1, len(self.ids)
        k, blocks = min(k, n), self.peaks.shape[1]
        who = np.repeat(np.arange(m), np.diff(rows))
        slot = self.slot[places]
        rare, dense = slot < 0, slot >= 0
        query = np.zeros((m, self.often.shape[1]), np.float32)
        query[who[dense], slot[dense]] = weights[dense]
        low = self.starts[places[rare]].astype(np.int64)
        size = self.starts[places[rare] + 1] - low
        at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        cell = self.owners[at] + np.repeat(who[rare] * (blocks * BLOCK), size)
        cosines = np.bincount(cell, self.weights[at] * np.repeat(weights[rare], size), m * blocks * BLOCK)
        cosines = cosines.astype(np.float32).reshape(m, blocks, BLOCK)
        cosines[:, -1, n - blocks * BLOCK or BLOCK :] = -1.0
        bound = cosines.max(axis=2) + query @ self.peaks
        done = np.zeros((m, blocks), bool)

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                q, rows_of = np.flatnonzero(wanted[:, b]), self.often[b * BLOCK : (b + 1) * BLOCK]
                found = cosines[q, b, : len(rows_of)] + query[q] @ rows_of.T
                if leave:
                    found[found > 1.0 - 1e-5] = -1.0
                cosines[q, b, : len(rows_of)] = found
            done[wanted] = True

        def floor() -> np.ndarray:
            """The k-th best cosine among the blocks read."""
            known = np.where(done[:, :, None], cosines, np.float32(-1.0)).reshape(m, -1)
            return np.partition(known, known.shape[1] - k, axis=1)[:, -k, None]

        ranked, step = np.argsort(-bound, axis=1), -(-k // BLOCK) + 1
        first = np.zeros((m, blocks), bool)
        np.put_along_axis(first, ranked[:, :step], True, axis=1)
        read(first)
        # the next best blocks raise the floor before the rest is held against it
        more = np.zeros((m, blocks), bool)
        np.put_along_axis(more, ranked[:, step : 3 * step], True, axis=1)
        read(more & (bound >= floor() - 1e-5) & ~done)
        read((bound >= floor() - 1e-5) & ~done)
        cosines[~done] = -1.0
        return cosines.reshape(m, -1)[:, :n].round(6), done


def vote_odds(cosines: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Log odds of label 1 among the k nearest examples of each text: each votes with its cosine over the greatest.

    Examples that tie with the last share the places left. Three votes of the examples' own rate keep the odds finite.
    """
    base, k = labels.mean(), min(k, cosines.shape[1])
    last = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k, None]
    above, level = cosines > last, cosines == last
    left = (k - above.sum(axis=1)) / np.maximum(level.sum(axis=1), 1)
    top = np.maximum(cosines.max(axis=1), 0.0)
    weigh = np.maximum(cosines, 0.0) / np.where(top > 0, top, 1.0)[:, None] * (above + level * left[:, None])
    yes, total = weigh @ labels, weigh.sum(axis=1)
    share = (yes + 3 * base) / (total + 3)
    return np.log(share / (1 - share))


@dataclass(frozen=True)
class Examples:
    """Labelled examples: the vocabulary with its weights, and the index."""

    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex

    @property
    def sizes(self) -> tuple[int, int]:
        return int((self.index.labels == 0).sum()), int((self.index.labels == 1).sum())

    def judge(self, data: np.ndarray, offsets: np.ndarray, leave: bool) -> tuple[np.ndarray, list[list[int] | None]]:
        """(vote odds for each of NEAREST, ids of the nearest examples) of each text; no ids where no example shares a weighing term."""
        places, times, rows = _known(self.vocabulary, data, offsets)
        weights = unit_weights(places, times, rows, self.idf)
        cosines, _ = self.index.search(places, weights, rows, NEAREST[-1], leave)
        labels = self.index.labels.astype(np.float64)
        odds, proof = np.stack([vote_odds(cosines, labels, k) for k in NEAREST], axis=1), []
        near = np.argpartition(-cosines, min(PROOFS * 4, cosines.shape[1] - 1), axis=1)[:, : PROOFS * 4]
        # all that tie with the last of the proofs compete by their ids
        for i, row in enumerate(cosines):
            least = np.sort(row[near[i]])[-PROOFS:][0]
            some = near[i] if (row[near[i]] < least).any() else np.flatnonzero(row >= least)
            some = some[np.lexsort((self.index.ids[some], -row[some]))][:PROOFS]
            proof.append(self.index.ids[some[row[some] > 0]].tolist() or None)
        return odds, proof


def _judged(shared: Broadcast, leave: bool = False):
    """mapInArrow function: (id, ..., text) to (id, ..., odds, evidence); null odds where there is no evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = shared.value
        for batch in batches:
            names = batch.schema.names[:-1]
            for row, data, offsets in K.blocks(batch.column("text")):
                for a in range(0, len(offsets) - 1, QUERIES):
                    cut = offsets[a : a + QUERIES + 1]
                    odds, proof = examples.judge(data[cut[0] : cut[-1]], cut - cut[0], leave)
                    values = [f if p else None for f, p in zip(odds.tolist(), proof, strict=True)]
                    rest = [batch.column(c).slice(row + a, len(cut) - 1) for c in names]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(values, pa.list_(pa.float64())), pa.array(proof, pa.list_(pa.int64()))], [*names, "odds", "evidence"])

    return run


@dataclass(frozen=True)
class ToxicityModel:
    """Broadcast examples with the calibration of their votes, slopes of at least 0; without examples of both labels every score is the base rate."""

    examples: Broadcast | None
    intercept: float
    slopes: tuple[float, ...]
    base: float

    def score(self, odds: Column) -> Column:
        total = F.lit(self.intercept)
        for i, slope in enumerate(self.slopes):
            total = total + F.lit(slope) * F.get(odds, F.lit(i))
        return F.when(odds.isNull(), F.lit(self.base)).otherwise(1.0 / (1.0 + F.exp(-total)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int, max_bytes: int) -> ToxicityModel:
    """Draw the examples, weigh their terms over all documents, index them, and calibrate their votes on each other."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = labels.where(~held_out(id_col, 5, 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("label in (0, 1)")
    # what the labelled texts hold, so that long ones draw fewer examples
    held = src.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(rows, "id")
    found = {r.label: r for r in held.groupBy("label").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()}
    keep = {y: min(1.0, max_examples / found[y].rows, max_bytes / 2 / max(found[y].bytes, 1)) if y in found else 1.0 for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.lit("example"), "id"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(draw < F.when(F.col("label") == 1, keep[1]).otherwise(keep[0]))
    # at most about 2 * max_examples pairs of numbers
    drawn = materialize(src.join(F.broadcast(drawn), "id"), "examples")
    schema = "id long, label int, terms array<long>, times array<int>"
    table = drawn.select("id", "label", "text").mapInArrow(_example_vectors, schema).toArrow()
    ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
    sizes = [int((label == y).sum()) for y in (0, 1)]
    counted = [n / keep[y] for y, n in enumerate(sizes)]
    base = (counted[1] + 0.5) / (sum(counted) + 1.0)
    if not all(sizes):
        return ToxicityModel(None, math.log(base / (1 - base)), (), base)

    flat, times = (pa.concat_arrays([x.flatten() for x in table.column(c).chunks]).to_numpy() for c in ("terms", "times"))
    ends = np.append(0, np.cumsum(pa.compute.list_value_length(table.column("terms")).to_numpy()))
    vocabulary = np.unique(flat.view(np.uint64))
    places = np.searchsorted(vocabulary, flat.view(np.uint64)).astype(np.int32)
    del table, flat
    counter = _text_counter(spark.sparkContext.broadcast(vocabulary))
    counts = src.select("text").mapInArrow(counter, "place int, texts long").groupBy("place").agg(F.sum("texts").alias("texts")).toArrow()
    texts = np.zeros(len(vocabulary), np.int64)
    texts[counts.column("place").to_numpy()] = counts.column("texts").to_numpy()
    idf = np.log((1.0 + src.count()) / (1.0 + texts)).astype(np.float32)
    weights = unit_weights(places, times, ends, idf).astype(np.float32)
    index = BlockMaxIndex.build(ids, label, places, weights, ends, len(vocabulary))
    examples = spark.sparkContext.broadcast(Examples(vocabulary, idf, index))
    del counts, texts, places, times, weights, vocabulary, index

    judged = drawn.select("id", "label", "text").mapInArrow(_judged(examples, leave=True), "id long, label int, odds array<double>, evidence array<long>")
    judged = judged.where("odds is not null").select(
        array_to_vector("odds").alias("features"), F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, 1.0 / keep[1]).otherwise(1.0 / keep[0]).alias("weight"),
    )
    judged = materialize(judged, "votes")
    if judged.select("label").distinct().count() < 2:
        return ToxicityModel(examples, math.log(base / (1 - base)), (), base)
    fit = LogisticRegression(weightCol="weight", maxIter=100, lowerBoundsOnCoefficients=DenseMatrix(1, len(NEAREST), [0.0] * len(NEAREST))).fit(judged)
    return ToxicityModel(examples, float(fit.intercept), tuple(fit.coefficients.toArray().tolist()), base)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = 4_000,
    max_bytes: int = 48 << 20,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted and evidence (ids of the nearest examples).

    Examples are about ``max_examples`` labelled rows of either class at most, and about ``max_bytes`` of text in all, drawn by a hash
    of the id from the training folds: so the index, which is broadcast, is bounded however long the texts are. A vector holds all
    terms of a whole text, weighed (1 + ln count) * ln((1 + texts) / (1 + texts with the term)) over all documents. A block-max index
    gives the NEAREST examples by exact cosine. Terms that no example holds only lengthen the text's own vector, which changes neither
    the order of its cosines nor their ratios, so they need no weight. The nearest vote, weighing by cosine (see vote_odds), and a
    logistic curve that never falls makes scores of the odds; it is fitted on the examples themselves, each judged without those of its
    own vector and weighing by its class's rate of drawing.

    Null and empty texts and those that share no term with an example get the base rate and no evidence, as do all texts
    without examples of both labels. Null labels are no examples, an id with several labels has the greatest, null ids
    are scored and count as the empty text for the fold. Repeated rows are rows like others. An empty table gives no
    rows; other columns are ignored.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, max_examples, max_bytes)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model.examples is None:
        scored = src.select("id", F.lit(model.base).alias("score"), F.lit(None).cast("array<bigint>").alias("evidence"))
    else:
        scored = src.mapInArrow(_judged(model.examples), "id long, odds array<double>, evidence array<long>")
        scored = scored.select("id", model.score(F.col("odds")).alias("score"), "evidence")
    return scored.select(
        F.col("id").alias(id_col), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.coalesce("evidence", F.array().cast("array<bigint>")).alias("evidence"),
    )
