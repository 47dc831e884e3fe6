"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm import kernels as K
from parchment.llm.components import star_components
from parchment.llm.storage import materialize
from parchment.runtime import lean, ship

#: rows of a bucket that one task compares with another such block at once
BLOCK_ROWS = 256
#: ids (8 bytes each) that may be broadcast
MOST_IDS = 1_000_000


@dataclass(frozen=True)
class Signature:
    """A signature of ``chunks`` * ``places`` MinHash values of 32 bits each; ``errors`` of a chunk's places may differ.

    By pigeonhole, two signatures that differ in fewer than chunks * (errors + 1) places agree in all but at most
    ``errors`` places of some chunk. Each way to leave out that many places gives one key of the chunk, so all
    such pairs share a key. At a Jaccard similarity of 0.75 a pair shares none with probability 6e-6. Pairs whose
    signatures differ in more than ``far`` places are not confirmed: at 0.75 that is a chance of 3e-6.
    """

    chunks: int = 12
    places: int = 5
    errors: int = 1
    far: int = 32
    seed: int = 7

    def factors(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.integers(1, 1 << 62, self.chunks * self.places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def omissions(self) -> list[tuple[int, ...]]:
        from itertools import combinations

        return [tuple(sorted(set(range(self.places)) - set(x))) for x in combinations(range(self.places), self.errors)]


def _sketcher(width: int, signature: Signature | None):
    """mapInArrow function: (rid, text) to rid, n, key1, key2 and the signature, or the sorted shingle set."""
    factors = signature and signature.factors()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in K.blocks(batch.column("text")):
                n = len(offsets) - 1
                rid = batch.column("rid").slice(row, n)
                h, rows = K.word_hashes(data, offsets)
                g, _, rows = K.distinct(*K.shingles(h, rows, width), n)
                if signature is None:
                    yield pa.RecordBatch.from_arrays([rid, K.binary(rows, g)], ["rid", "shingles"])
                    continue
                sums = [K.row_reduce(np.add, K.mix(g ^ np.uint64(c)), rows, np.uint64(0)).view(np.int64) for c in (0x51ED, 0xA7F3B)]
                mins = np.empty((n, len(factors)), np.uint32)
                for j, a in enumerate(factors):
                    mins[:, j] = K.row_reduce(np.minimum, g * a, rows, np.uint64(0)) >> np.uint64(32)
                sig = K.binary(np.arange(n + 1) * len(factors), mins.ravel())
                yield pa.RecordBatch.from_arrays([rid, pa.array(np.diff(rows)), *map(pa.array, sums), sig], ["rid", "n", "key1", "key2", "sig"])

    return sketch


def _keyer(signature: Signature):
    keep = signature.omissions()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            width = signature.chunks * signature.places
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, width).astype(np.uint64)
            for c in range(signature.chunks):
                chunk = sig[:, c * signature.places : (c + 1) * signature.places]
                for o, places in enumerate(keep):
                    key = np.full(len(sig), c * len(keep) + o + 1, np.uint64)
                    for p in places:
                        key = K.mix(key ^ chunk[:, p]) * np.uint64(0x9E3779B97F4A7C15)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid)], ["key", "rid"])

    return keys


def _places(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Signatures as rows of 32-bit values."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), -1)


def _likely(signature: Signature, percent: int):
    """mapInArrow function: pairs whose set sizes and signatures allow a link."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("nu", "nv")])
            apart = (_places(batch.column("su")) != _places(batch.column("sv"))).sum(axis=1)
            ok = (apart <= signature.far) & (100 * sizes.min(axis=0) >= percent * sizes.max(axis=0))
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return likely


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    least, most = sorted((len(a), len(b)))
    if 100 * least < percent * most:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (least + most - common)


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("su", "sv")]
            ok = np.fromiter((_similar(a, b, percent) for a, b in zip(*sets, strict=True)), bool, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok))

    return verify


def _bucket_linker(percent: int):
    """applyInArrow function: links of one block's left rows to rows of other components, one for each pair of components.

    Each left row's elements are marked once, and one pass over all sets of the block counts its intersections.
    """

    def link(table: pa.Table) -> pa.Table:
        rid, comp, left = (table[c].to_numpy() for c in ("rid", "comp", "left"))
        size = np.array([len(x) // 8 for x in table["shingles"].to_pylist()], np.int64)
        _, ids = np.unique(np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint64), return_inverse=True)
        starts = np.append(0, np.cumsum(size))
        marked = np.zeros(len(ids) and int(ids.max()) + 1, np.int64)
        roots = comp.copy()
        out = []
        for p in np.flatnonzero(left):
            if (roots == roots[p]).all():
                continue
            own = ids[starts[p] : starts[p + 1]]
            marked[own] = 1
            common = np.add.reduceat(marked[ids], starts[:-1])
            marked[own] = 0
            for q in np.flatnonzero((roots != roots[p]) & (100 * common >= percent * (size + size[p] - common))):
                if roots[q] != roots[p]:
                    out.append((int(rid[p]), int(rid[q])))
                    roots[roots == max(roots[p], roots[q])] = min(roots[p], roots[q])
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([x for _, x in out], pa.int64())})

    return link


def _mixed_blocks(member: DataFrame) -> DataFrame:
    """(key, i, j, rid, comp, left): blocks of the buckets (key, rid, comp) that hold several components.

    A bucket's largest component is its majority. Only pairs with a row outside it can link components, so those rows
    (left) meet every row: they are cut into blocks i, and all rows into blocks j. Buckets with the same rows count once.
    """
    each = member.groupBy("key", "comp").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rid))").alias("who"))
    mixed = each.groupBy("key").agg(
        F.count("*").alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("most"), F.expr("bit_xor(who)").alias("who")
    )
    mixed = mixed.where("comps > 1").groupBy("who", "size", "most").agg(F.min("key").alias("key"))
    rows = member.join(mixed.select("key", "size", "most"), "key")
    wide = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    tall = F.ceil((F.col("size") - F.col("most.n")) / BLOCK_ROWS).cast("int")
    place = F.xxhash64("rid")
    rows = rows.select("key", "rid", "comp", (F.col("comp") != F.col("most.comp")).alias("odd"), wide.alias("wide"), tall.alias("tall"), place.alias("h"))
    j, i = F.pmod("h", "wide").cast("int"), F.pmod("h", "tall").cast("int")
    down = rows.select("key", "rid", "comp", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("left"))
    along = rows.where("odd").select("key", "rid", "comp", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(True).alias("left"))
    # a row that meets its own block stands there once, on the left
    return along.unionByName(down).groupBy("key", "i", "j", "rid", "comp").agg(F.max("left").alias("left"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    signature: Signature = Signature(),
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    A-Z are lowered, words are runs of characters other than space and \\t to \\r, and a document's set holds its
    distinct ``width``-word shingles (a shorter text is one shingle). Two documents are linked if
    100 * intersection >= percent * union of their whole sets; component_id is the smallest id reachable.

    1. Sketch every text once: set size, set hash and signature. Equal sets collapse to one representative.
    2. Multi-index join: the signature's keys make buckets, and each bucket pairs its members with its smallest one.
       Pairs that their signatures allow are confirmed on the full sets, and confirmed links make components.
    3. Buckets that still hold several components compare all pairs across components on the full sets, in
       blocks of bounded size. Copies are never expanded into pairs.

    Null or wordless texts have an empty set and stay alone. A row with a null id has a null component and is
    kept. Rows that repeat an id are one node, linked as any of them is. Ties can't arise: ids order the result.
    An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("text"))
    schema = "rid long, n long, key1 long, key2 long, sig binary"
    sketch = materialize(src.mapInArrow(lean(_sketcher(width, signature)), schema), "sketch")
    full = sketch.where("n > 0 and rid is not null")
    same = full.groupBy("n", "key1", "key2").agg(F.min("rid").alias("rep"), F.min("sig").alias("sig"))
    same = materialize(same, "sets")
    keys = same.select(F.col("rep").alias("rid"), "sig").mapInArrow(lean(_keyer(signature)), "key long, rid long")

    shared = keys.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high")
    member = materialize(keys.join(shared.select("key", "low"), "key"), "buckets")
    pairs = materialize(member.where("rid <> low").select(F.col("low").alias("u"), F.col("rid").alias("v")).distinct(), "pairs")

    sigs = same.select(F.col("rep").alias("rid"), "n", "sig")
    both = pairs.join(sigs.toDF("u", "nu", "su"), "u").join(sigs.toDF("v", "nv", "sv"), "v")
    pairs = materialize(both.mapInArrow(lean(_likely(signature, percent)), "u long, v long"), "pairs")

    def shingle_sets(ids: DataFrame) -> DataFrame:
        """Full sets of the ids. Up to MOST_IDS of them are broadcast; beyond that the texts are exchanged."""
        ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
        some = src.where("rid is not null").join(ids, "rid", "left_semi")
        return materialize(some.mapInArrow(lean(_sketcher(width, None)), "rid long, shingles binary"), "shingles")

    sets = shingle_sets(materialize(pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct(), "ids"))
    paired = pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    links = materialize(paired.select("u", "v", "su", "sv").mapInArrow(lean(_verifier(percent)), "u long, v long"), "links")
    first = materialize(star_components(links), "components")

    member = member.join(first.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("comp"))
    blocks = materialize(_mixed_blocks(member), "blocks")
    sets = shingle_sets(materialize(blocks.select("rid").distinct(), "ids"))
    late = blocks.join(sets, "rid").groupBy("key", "i", "j").applyInArrow(_bucket_linker(percent), "u long, v long")
    late = materialize(late.distinct(), "links")
    if late.head(1):
        first = materialize(star_components(links.unionByName(late)), "components")

    # every id of an equal set belongs to the set's representative
    alike = full.select("rid", "n", "key1", "key2").join(same.select("n", "key1", "key2", "rep"), ["n", "key1", "key2"])
    alike = alike.where("rid <> rep").select(F.col("rid").alias("u"), F.col("rep").alias("v")).distinct()
    kinds = full.select("rid", F.struct("n", "key1", "key2").alias("kind")).groupBy("rid")
    if kinds.agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b").head(1):
        # rows of one id differ: their sets join through it
        first = star_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(alike))
        alike = alike.where("false")
    rep = F.coalesce("v", "rid")
    out = sketch.select("rid", "n").join(alike, F.col("u") == F.col("rid"), "left").select("rid", "n", rep.alias("node"))
    out = out.join(first, "node", "left").select("rid", "n", F.coalesce("component", "node").alias("component_id"))
    kept = F.coalesce(F.col("rid") == F.col("component_id"), F.lit(True))
    return out.select(F.col("rid").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


#: the same rows in DuckDB SQL: exact links by a join on shingles, components by recursion
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT rid, unnest(g) AS h, len(g) AS n FROM s),
c AS (SELECT a.rid AS u, b.rid AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x.doc_id AS u, y.doc_id AS v FROM c JOIN s x ON x.rid = u JOIN s y ON y.rid = v WHERE 100 * shared >= 75 * (nu + nv - shared)),
t AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(node, far) AS (SELECT u, v FROM t UNION SELECT r.node, t.v FROM r JOIN t ON r.far = t.u),
k AS (SELECT node, min(far) AS low FROM r GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, low) AS component_id, coalesce(doc_id <= low, true) AS kept FROM s LEFT JOIN k ON node = doc_id
"""
