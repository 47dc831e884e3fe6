"""Periodic runs of words: tiles for every octave of periods, solved by themselves and stitched by document and period.

A run is a longest stretch of words with smallest period q that holds at least four periods and six words. Word i is equal to
word i + q along all but the last q words of a run; below, that is called a stretch at lag q: at least 3 * q places.

Octave k holds the periods from s = 2^k to 2 * s - 1. Its tiles start at the multiples of s. A tile at c asks at which lags of
its octave the 2 * s words from c come again. Every stretch of the octave covers the first 2 * s words of a tile, as 3 * q places
hold s - 1 places before a multiple of s and 2 * s from it. Only the smallest such lag counts: if the block comes again at
q' < q, both less than 2 * s, then the block and its second copy share more than q - q' words and so all 2 * s + q words from c
have period q - q', hence gcd(q, q - q'), which divides q; then q is no smallest period. So a tile gives one lag at most, whatever
the text repeats. From a block that comes again the stretch goes on by less than s words before it and after it where the
neighbouring tiles don't hold it, which comparing the two ends of the block gives.

A stretch at a multiple of the smallest period spans the same run, so of the periods of one span only the smallest is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm import kernels as K
from parchment.llm.quality_rules import bind
from parchment.runtime import ship

#: places that are compared at once
MOST_CELLS = 1 << 20
U64 = np.uint64
_LEVEL = U64(0xC2B2AE3D27D4EB4F)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _doubled(h: np.ndarray, s: int) -> np.ndarray:
    """Hashes of 2 * s words at every place, from those of s words."""
    if len(h) <= s:
        return h[:0]
    x = h[:-s] * _LEVEL + h[s:]
    return x ^ (x >> U64(29))


def _tiles(h: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, smallest lag in the octave at which its block comes again) of the tiles that have one; h hashes 2 * s words."""
    m, rows = len(h), (len(h) - 1) // s
    if rows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lags, step = [], [], max(1, MOST_CELLS // s)
    for r in range(0, rows, step):
        top = min(rows, r + step)
        later = h[(r + 1) * s : (top + 1) * s]
        if short := (top - r) * s - len(later):
            later = np.concatenate([later, np.zeros(short, np.uint64)])
        same = later.reshape(-1, s) == h[r * s : top * s : s][:, None]
        if short:
            same.ravel()[m - (r + 1) * s :] = False
        j = same.argmax(1)
        hit = np.flatnonzero(same[np.arange(len(j)), j])
        starts.append((hit + r) * s)
        lags.append(j[hit] + s)
    return np.concatenate(starts), np.concatenate(lags)


def _reach(w: np.ndarray, at: np.ndarray, lag: np.ndarray, s: int, step: int) -> np.ndarray:
    """How many places, up to s, from ``at`` on in direction ``step`` are equal to those at the lag."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, MOST_CELLS // s)
    for r in range(0, len(at), rows):
        i = at[r : r + rows, None] + step * np.arange(s)
        j = i + lag[r : r + rows, None]
        inside = (i >= 0) & (j < len(w))
        same = inside & (w[np.where(inside, i, 0)] == w[np.where(inside, j, 0)])
        out[r : r + rows] = np.where(same.all(1), s, same.argmin(1))
    return out


def octave_stretches(w: np.ndarray, h: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first place, place after the last) of stretches that the octave's tiles over the word hashes w find, joined where tiles overlap."""
    c, q = _tiles(h, s)
    order = np.lexsort((c, q))
    c, q = c[order], q[order]
    new = np.ones(len(c), bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] > c[:-1] + 2 * s)
    first = np.flatnonzero(new)
    if not len(first):
        return c, c, c
    lo, hi, q = c[first], c[np.append(first[1:], len(c)) - 1] + 2 * s, q[first]
    return q, lo - _reach(w, lo - 1, q, s, -1), hi + _reach(w, hi, q, s, 1)


def _runs_of(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs among whole stretches, by start, then period."""
    keep = (hi - lo >= 3 * q) & (hi - lo + q >= 6)
    q, lo, end = q[keep], lo[keep], hi[keep] + q[keep]
    order = np.lexsort((q, end, lo))
    q, lo, end = q[order], lo[order], end[order]
    new = np.ones(len(q), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (end[1:] != end[:-1])
    q, lo, end = q[new], lo[new], end[new]
    order = np.lexsort((q, lo))
    return lo[order], (end - lo)[order], q[order]


def batch_runs(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of the runs of many rows at once; h has the word hashes of row i at rows[i]:rows[i + 1].

    The rows are laid out from the longest to the shortest, each with an end of its own kind behind it, which nothing equals; an
    octave reads only the rows that have four of its periods.
    """
    count = np.diff(rows)
    order = np.argsort(-count, kind="stable")
    size = count[order]
    start = np.concatenate([[0], np.cumsum(size + 1)])
    w = np.empty(start[-1], np.uint64)
    put = np.ones(len(w), bool)
    put[start[1:] - 1] = False
    w[put] = h[np.repeat(rows[:-1][order], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))]
    w[~put] = K.mix(np.arange(len(size), dtype=np.uint64) + U64(0xE4D << 40))
    found, s = [], 1
    level = _doubled(w, 1)
    while len(size) and size[0] >= max(6, 4 * s):
        end = start[np.searchsorted(-size, -4 * s, "right")]
        w, level = w[:end], level[: max(end - 2 * s + 1, 0)]
        found.append(octave_stretches(w, level, s))
        s *= 2
        level = _doubled(level, s)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    at, length, q = _runs_of(*(np.concatenate(x) for x in zip(*found, strict=True)))
    place = np.searchsorted(start, at, "right") - 1
    out = np.lexsort((q, at, order[place]))
    return order[place][out], (at - start[place])[out], length[out], q[out]


def strips(n: int, strip_words: int) -> Iterator[tuple[int, int, int]]:
    """(s, first, last) for a document of n words: spans of whole tiles of each octave, at least eight of its periods long."""
    s = 1
    while 4 * s <= n:
        wide = max(strip_words // s, 16) * s
        yield from ((s, a, min(a + wide, n)) for a in range(0, n, wide))
        s *= 2


def strip_stretches(w: np.ndarray, s: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the tiles of an octave that start in first:last find, seen with the words that they reach: parts of stretches."""
    a = max(0, first - s)
    part = w[a : last + 6 * s]
    level, wide = part, 1
    while wide < 2 * s:
        level = _doubled(level, wide)
        wide *= 2
    q, lo, hi = octave_stretches(part, level[: max(last - a, 0) + 2 * s], s)
    return q, lo + a, hi + a


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def _output(ids: pa.Array, texts: list[bytes], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    words = [t.split() for t in texts]  # of bytes: exactly the six ASCII characters
    counts = np.array([len(x) for x in runs], np.int64)
    flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
    names = ["start", "length", "period"]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names))
    kept = pa.array([_kept(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), lists, kept], ["id", "n_words", "runs", "collapsed"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, text) to id, n_words, runs and collapsed, many short texts at once."""
    for batch in batches:
        ids = batch.column("id")
        for row, data, offsets in K.blocks(batch.column("text")):
            n = len(offsets) - 1
            doc, start, length, period = batch_runs(*K.word_hashes(data, offsets, lower=False))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            for d, run in zip(doc.tolist(), zip(start.tolist(), length.tolist(), period.tolist(), strict=True), strict=True):
                runs[d].append(run)
            raw = data.tobytes()
            yield _output(ids.slice(row, n), [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], runs)


def _part_solver(strip_words: int):
    """mapInArrow function: (key, text) to key, period, lo, hi, the parts of stretches that each strip of a long text finds."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in K.blocks(batch.column("text"), 1):
                w, _ = K.word_hashes(data, offsets, lower=False)
                for s, first, last in strips(len(w), strip_words):
                    q, lo, hi = strip_stretches(w, s, first, last)
                    if len(q):
                        key = pa.array([batch.column("key")[row].as_py()] * len(q), pa.string())
                        yield pa.RecordBatch.from_arrays([key, *map(pa.array, (q, lo, hi))], ["key", "period", "lo", "hi"])

    return parts


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, text, runs) to id, n_words, runs and collapsed."""
    for batch in batches:
        for i in range(batch.num_rows):
            runs = [(r["start"], r["length"], r["period"]) for r in batch.column("runs")[i].as_py() or ()]
            yield _output(batch.column("id").slice(i, 1), [(batch.column("text")[i].as_py() or "").encode()], [runs])


def stitch(parts: DataFrame) -> DataFrame:
    """(key, runs): parts of stretches (key, period, lo, hi) that overlap or touch make one, shuffled by key and period; then runs."""
    before = Window.partitionBy("key", "period").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key", "period").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.distinct().withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int"))
    whole = rows.withColumn("n", F.sum("new").over(upto)).groupBy("key", "period", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = whole.where("hi - lo >= 3 * period and hi - lo + period >= 6").withColumn("length", F.expr("hi - lo + period"))
    runs = whole.groupBy("key", F.col("lo").alias("start"), "length").agg(F.min("period").alias("period"))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).cast(RUNS).alias("runs"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = 1 << 16, strip_words: int = 1 << 13) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. The collapsed text leaves out the words of each run after its first period.
    Texts of less than ``long_bytes`` are solved in blocks with all their tiles; longer ones in strips of about ``strip_words``
    words (more where an octave's tiles are larger), each by itself, whose parts of stretches are shuffled by document and period
    and stitched; the bounds don't change the result. Null text counts as empty (no words, no runs, an empty collapsed text), null
    ids and repeated rows are rows like others, an empty table gives no rows, and columns other than the two are ignored.
    Words are compared by 64-bit hashes.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows, schema = docs.select(F.col(id_col).alias("id"), text.alias("text")), f"id {kind}, n_words long, runs {RUNS}, collapsed string"
    short = rows.where(F.octet_length("text") < long_bytes).mapInArrow(_solve, schema)
    # runs depend on the text alone
    long = rows.where(F.octet_length("text") >= long_bytes).withColumn("key", F.sha2("text", 256))
    runs = stitch(long.select("key", "text").mapInArrow(_part_solver(strip_words), "key string, period long, lo long, hi long"))
    whole = long.join(runs, "key", "left").select("id", "text", "runs").mapInArrow(_collapse, schema)
    return short.unionByName(whole).withColumnRenamed("id", id_col)


def with_repeated_tails(text: Column, doc_id: Column) -> Column:
    """The text; with h = crc32 of the decimal id and h % 10 = 0, one that repeats its words from a place on with a period, both dealt by h."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        return bind(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"), n.alias("n")), lambda x: F.array_join(repeated(words, x), " "))

    def repeated(words: Column, x: Column) -> Column:
        tail = F.transform(F.sequence(x["a"], x["n"] - 1), lambda i: F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))
        return F.concat(F.slice(words, F.lit(1), x["a"].cast("int")), tail)

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    return F.when((h % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), bind(words, edited)).otherwise(text)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, its text's tail repeated for one in ten ids: n_runs, the longest run, and digests of runs and collapsed text.

    Of runs of equal length the longest is that with the smallest start, then period; without runs its columns are null. A null id has
    no hash, so its text stays as it is; otherwise as periodic_runs says.
    """
    edited = docs.select(F.col(id_col).alias("doc_id"), with_repeated_tails(F.col(text_col), F.col(id_col)).alias("text"))
    out = periodic_runs(edited)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("top", longest)
    length = -F.col("top.less")
    return out.select(
        F.col("doc_id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
