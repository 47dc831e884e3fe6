"""Occurrences of the terms of a vocabulary, all counted in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.text import fold
from parchment.runtime import ship

#: terms that a vocabulary may have, and characters in all: its automaton is made in every worker, from a broadcast list
MOST_TERMS = 100_000
MOST_CHARACTERS = 4_000_000


def listed_terms(topics: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(topic, term) of a dictionary given by the user, by topic."""
    rows = [(t, x) for t, terms in sorted(topics.items()) for x in terms]
    if len(rows) > MOST_TERMS or sum(len(x) for _, x in rows) > MOST_CHARACTERS:
        raise ValueError(f"a vocabulary of {len(rows)} terms; the bounds are {MOST_TERMS} and {MOST_CHARACTERS} characters")
    return rows


class TermIndex:
    """An automaton over folded terms. Terms are numbered as given; empty ones occur nowhere."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        places: dict[str, list[int]] = {}
        for i, x in enumerate(terms):
            if x:
                places.setdefault(x.lower(), []).append(i)
        self.same = list(places.values())
        self.automaton = ahocorasick.Automaton()
        for j, x in enumerate(places):
            self.automaton.add_word(x, (j, len(x)))
        if places:
            self.automaton.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """Term number to its occurrences that don't overlap, counted from the left, for terms that occur."""
        if not self.same:
            return {}
        n: dict[int, int] = {}
        free: dict[int, int] = {}
        for end, (j, size) in self.automaton.iter(text):
            if end - size >= free.get(j, -1):
                free[j] = end
                n[j] = n.get(j, 0) + 1
        return {i: k for j, k in n.items() for i in self.same[j]}


#: the automaton of the list last used in this worker, by the list's identity; the list is kept alive beside it
_made: dict[int, tuple[list[str], TermIndex]] = {}


def shared_terms(spark: SparkSession, terms: list[str]) -> Broadcast:
    ship(spark)
    return spark.sparkContext.broadcast(terms)


def index_of(shared: Broadcast) -> TermIndex:
    """The automaton of broadcast terms, made once in a worker."""
    key = id(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = (shared.value, TermIndex(shared.value))
    return _made[key][1]


def term_hits(docs: DataFrame, key: str, text: str, topics: dict[str, list[str]]) -> DataFrame:
    """(key, topic, term, hits): folded occurrences of each term that occurs, in one pass over a text, however many terms there are.

    Occurrences of one term don't overlap, those of different terms may. A term listed under two topics gives a row for each. Null
    texts, empty terms and an empty vocabulary give no rows; repeated keys are rows of their own.
    """
    listed = listed_terms(topics)
    topic, term = pa.array([t for t, _ in listed], pa.string()), pa.array([x for _, x in listed], pa.string())
    shared = shared_terms(docs.sparkSession, [x for _, x in listed])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(shared)
        for batch in batches:
            found = [sorted(index.counts(value.as_py() or "").items()) for value in batch.column(1)]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            which = pa.array([i for x in found for i, _ in x], pa.int32())
            hits = pa.array([n for x in found for _, n in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), topic.take(which), term.take(which), hits], [key, "topic", "term", "hits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, fold(F.col(text)).alias("__low")).mapInArrow(count, f"`{key}` {kind}, topic string, term string, hits int")
