"""SentencePiece encoding and decoding of whole documents by a max-plus scan over chunks."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.storage import materialize
from parchment.runtime import lean, ship

#: a public BPE model with byte fallback; any model of the library may stand in its place
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: code points of one chunk
CHUNK = 16_384
MARK = "▁"
NEVER = float("-inf")

State = tuple[int, str]  # code points that the last piece reaches past the boundary; that piece ("" where it doesn't matter)


class Lattice:
    """Which pieces may follow each other, and what they weigh, for one model.

    A unigram model weighs a piece by its score, and any piece may follow any. A BPE model gives the one sequence whose
    neighbouring pairs all encode to themselves: a pair that doesn't is forbidden (-inf), and every other weighs 0.
    So both are best paths of a max-plus lattice; only a BPE state needs to know its last piece.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.unigram = spec.trainer_spec.model_type == 1
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        normal, unknown, user, unused = 1, 2, 4, 5
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        self.score = {p.piece: p.score for p in spec.pieces if p.type in (normal, user, unused)}
        self.unknown = min([*self.score.values(), 0.0]) - 10.0
        self.longest = max(map(len, self.score))
        # pieces whose mark stands only in front can't cross the start of a marked word
        self.words = not any(MARK in p.lstrip(MARK) for p in self.score)
        spec.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.fits = lru_cache(1 << 18)(self._fits)

    def _merged(self, text: str) -> list[str]:
        """Highest-scoring, leftmost merges of neighbours until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = max(
                ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None
            )
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        if self.unigram:
            return True
        return self._merged(a + b) == ([a, b] if a else [b])

    def weight(self, piece: str) -> float:
        return (self.score.get(piece, self.unknown)) if self.unigram else 0.0

    def _state(self, reach: int, piece: str) -> State:
        return reach, "" if self.unigram else piece

    def pieces_at(self, text: str, i: int) -> Iterator[str]:
        """Pieces that may start at i: those of the vocabulary, and the single character in any case."""
        yield text[i]
        for n in range(2, min(self.longest, len(text) - i) + 1):
            if text[i : i + n] in self.score:
                yield text[i : i + n]

    def word_start(self, text: str, low: int, high: int) -> int | None:
        """The first place in low..high-1 that no piece crosses."""
        if self.words:
            for i in range(max(low, 1), high):
                if text[i] == MARK and text[i - 1] != MARK:
                    return i
        return None

    def last_word_start(self, text: str, low: int, high: int) -> int | None:
        if self.words:
            for i in range(high - 1, max(low, 1) - 1, -1):
                if text[i] == MARK and text[i - 1] != MARK:
                    return i
        return None

    def entries(self, text: str, at: int) -> list[State]:
        """States in which a path may cross ``at``: by a piece that starts before it and ends at it or later."""
        out = {}
        for i in range(max(0, at - self.longest), at):
            for piece in self.pieces_at(text, i):
                if i + len(piece) >= at and self.fits("", piece):
                    out[self._state(i + len(piece) - at, piece)] = True
        return list(out)

    def walk(self, text: str, low: int, high: int, start: State) -> dict[State, float]:
        """Best weight from a state at ``low`` to each state at ``high`` (after the last piece that starts below high)."""
        best: dict[int, dict[str, float]] = {low + start[0]: {start[1]: 0.0}}
        out: dict[State, float] = {}
        for i in range(low, high):
            here = best.pop(i, None)
            if not here:
                continue
            for piece in self.pieces_at(text, i):
                total = max((w for last, w in here.items() if not last or self.fits(last, piece)), default=NEVER)
                if total == NEVER or not self.fits("", piece):
                    continue
                total += self.weight(piece)
                end, last = i + len(piece), "" if self.unigram else piece
                if end >= high:
                    key = (end - high, last)
                    out[key] = max(out.get(key, NEVER), total)
                else:
                    now = best.setdefault(end, {})
                    now[last] = max(now.get(last, NEVER), total)
        for end, states in best.items():  # the entering piece may reach past the whole stretch
            if end >= high:
                for last, w in states.items():
                    out[end - high, last] = max(out.get((end - high, last), NEVER), w)
        return out

    def transfer(self, text: str, low: int, high: int, first: bool) -> list[tuple[State, State, float]]:
        """The chunk's matrix: the best weight for each way in and out that some path takes.

        text holds the chunk at low..high-1 with enough before and after to see the pieces that cross its ends. A word start
        inside parts the chunk: all ways in meet there, so head and tail are walked alone and what lies between adds the
        same to each.
        """
        starts = [(0, "")] if first else self.entries(text, low)
        a = self.word_start(text, low + (0 if first else 1), high)
        if a is None:
            return [(s, e, w) for s in starts for e, w in self.walk(text, low, high, s).items()]
        b = self.last_word_start(text, a, high)
        tail = self.walk(text, b, high, (0, ""))
        heads = [(s, self.walk(text, low, a, s).items()) for s in starts if s[0] <= a - low]
        return [(s, e, w + x) for s, ends in heads for (reach, _), w in ends if reach == 0 for e, x in tail.items()]


def combine(matrices: list[list[tuple[State, State, float]]]) -> list[State]:
    """The state at the end of each chunk on the best path from (0, "") to an end that reaches past nothing.

    Max-plus products of vectors and matrices in chunk order; the way back picks the best predecessor.
    """
    reached: list[dict[State, tuple[float, State]]] = []
    now: dict[State, float] = {(0, ""): 0.0}
    for matrix in matrices:
        step: dict[State, tuple[float, State]] = {}
        for enter, leave, w in matrix:
            if enter in now and (leave not in step or now[enter] + w > step[leave][0]):
                step[leave] = now[enter] + w, enter
        reached.append(step)
        now = {s: w for s, (w, _) in step.items()}
    end = max((s for s in now if s[0] == 0), key=lambda s: now[s])
    path = [end]
    for step in reversed(reached):
        path.append(step[path[-1]][1])
    return path[::-1][1:]


_loaded: dict[str, Lattice] = {}


def _lattice(model: bytes) -> Lattice:
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Lattice(model)
    return _loaded[key]


def _marked(lattice: Lattice, text: str) -> str:
    return (MARK if lattice.prefix and text else "") + text.replace(" ", MARK)


def _lists(ids: list[list[int]]) -> pa.Array:
    """A list column of piece ids, without an object for each."""
    flat = array("i")
    for x in ids:
        flat.fromlist(x)
    offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The piece ids of each row as arrays; a null row has none."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    rows = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [values[:0] if null else x for x, null in zip(rows, column.is_null().to_pylist(), strict=True)] if column.null_count else rows


def _encode(model: bytes, digest_of: Callable[[str], str]):
    """mapInArrow function: (id, text) to (id, n_chars, digest, pieces) for texts of a single chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids = lattice.plain.encode([_marked(lattice, x) for x in texts], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(map(len, texts), pa.int64()), pa.array(map(digest_of, texts)), _lists(ids)],
                    ["id", "n_chars", "digest", "pieces"],
                )

    return run


def _digest(text: str) -> str:
    """SHA-256 of the text that decoding gives: a mark in the text itself comes back as a space."""
    return hashlib.sha256(text.replace(MARK, " ").encode()).hexdigest()


def _exact_digest(text: str) -> str:
    """SHA-256 of the text as it is."""
    return hashlib.sha256(text.encode()).hexdigest()


def _split(model: bytes, chunk: int, digest_of: Callable[[str], str]):
    """mapInArrow function: long texts to one row a chunk, with enough around it to see pieces that cross its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        side = lattice.longest
        kinds = [("rid", pa.int64()), ("id", pa.int64()), ("n_chars", pa.int64()), ("digest", pa.string())]
        kinds += [("chunk", pa.int32()), ("text", pa.string()), ("low", pa.int32()), ("high", pa.int32())]
        for batch in batches:
            for rid, id_, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "id", "text")), strict=True):
                marked, digest = _marked(lattice, text), digest_of(text)
                out = []
                for c, low in enumerate(range(0, len(marked), chunk)):
                    begin, high = max(0, low - side), min(len(marked), low + chunk)
                    out.append((rid, id_, len(text), digest, c, marked[begin : high + side], low - begin, high - begin))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return run


def _transfers(model: bytes):
    """mapInArrow function: chunks to their matrices, one row for each pair of states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in batches:
            for row in batch.to_pylist():
                m = lattice.transfer(row["text"], row["low"], row["high"], row["chunk"] == 0)
                yield pa.RecordBatch.from_pylist(
                    [{"rid": row["rid"], "chunk": row["chunk"], "reach": s[0], "last": s[1], "to_reach": e[0], "to_last": e[1], "weight": w} for s, e, w in m],
                    pa.schema([("rid", pa.int64()), ("chunk", pa.int32()), ("reach", pa.int32()), ("last", pa.string()), ("to_reach", pa.int32()), ("to_last", pa.string()), ("weight", pa.float64())]),
                )

    return run


def _paths(table: pa.Table) -> pa.Table:
    """applyInArrow function: the matrices of one document to where each chunk's own pieces begin and end."""
    matrices: dict[int, list] = {}
    for r in table.to_pylist():
        matrices.setdefault(r["chunk"], []).append(((r["reach"], r["last"]), (r["to_reach"], r["to_last"]), r["weight"]))
    n = len(matrices)
    ends = [reach for reach, _ in combine([matrices[c] for c in range(n)])]
    return pa.table(
        {"rid": pa.array([table["rid"][0].as_py()] * n), "chunk": pa.array(range(n), pa.int32()), "skip": pa.array([0, *ends[:-1]], pa.int32()), "over": pa.array(ends, pa.int32())}
    )


def _backtrace(model: bytes):
    """mapInArrow function: each chunk's pieces between its two known states; such a stretch encodes by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in batches:
            rows = batch.to_pylist()
            ids = lattice.plain.encode([r["text"][r["low"] + r["skip"] : r["high"] + r["over"]] for r in rows], num_threads=1)
            names = ["rid", "id", "n_chars", "digest", "chunk"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), _lists(ids)], [*names, "ids"])

    return run


def read_model(path: str) -> bytes:
    """A model file of bounded size, read on the driver and sent with the functions."""
    with open(path, "rb") as f:
        return f.read()


def _chained(first, then):
    """One mapInArrow function of two, so that a task needs one Python worker."""
    return lambda batches: then(first(batches))


def _encoded(docs: DataFrame, id_col: str, text_col: str, model: bytes, chunk: int, exact: bool, then=None, made: str = "pieces array<int>") -> DataFrame:
    """(id, n_chars, digest, what is made of the pieces, chunks): the pieces themselves, or what the mapInArrow function ``then`` puts in their place."""
    ship(docs.sparkSession)
    digest_of, then = _exact_digest if exact else _digest, then or iter
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    length = F.length(F.coalesce("text", F.lit("")))
    short = rows.where(length < chunk).mapInArrow(lean(_chained(_encode(model, digest_of), then)), f"id long, n_chars long, digest string, {made}")
    giant = rows.where(length >= chunk).select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    schema = "rid long, id long, n_chars long, digest string, chunk int, text string, low int, high int"
    giant = materialize(giant.mapInArrow(lean(_split(model, chunk, digest_of)), schema).repartition("rid", "chunk"), "chunks")
    matrix = giant.mapInArrow(lean(_transfers(model)), "rid long, chunk int, reach int, last string, to_reach int, to_last string, weight double")
    paths = matrix.groupBy("rid").applyInArrow(_paths, "rid long, chunk int, skip int, over int")
    traced = giant.join(paths, ["rid", "chunk"]).select("rid", "id", "n_chars", "digest", "chunk", "text", "low", "high", "skip", "over")
    traced = traced.mapInArrow(lean(_backtrace(model)), "rid long, id long, n_chars long, digest string, chunk int, ids array<int>")
    whole = traced.groupBy("rid", "id", "n_chars", "digest").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
    whole = whole.select("id", "n_chars", "digest", F.size("all").alias("chunks"), F.flatten("all.ids").alias("pieces"))
    if then is not iter:
        whole = whole.mapInArrow(lean(then), f"id long, n_chars long, digest string, chunks int, {made}")
    return short.withColumn("chunks", F.lit(1)).unionByName(whole).withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, exact: bool = False) -> DataFrame:
    """One row per document: id, n_chars, digest (SHA-256 of the text that decoding gives), pieces and chunks.

    With ``exact``, digest is that of the text as it is, which decoding misses where the text holds the mark U+2581.

    pieces are what the library makes of the whole text. A text of over ``chunk`` code points is cut at any places. Each
    of its chunks gives a matrix of best weights between the states at its ends (tasks share the chunks out), a document's
    matrices are combined in order, and then each chunk is encoded by itself between its two known states. Only
    such texts are exchanged; a text of one chunk has its states given and is encoded where it is read.

    Null and empty texts have no pieces. Null ids and repeated rows are rows like others; an empty table gives no rows;
    other columns are ignored.
    """
    return _encoded(docs, id_col, text_col, read_model(model), chunk, exact).select(id_col, "n_chars", "digest", "pieces", "chunks")


def _decode(model: bytes, keep: bool, with_pieces: bool = False):
    """mapInArrow function: replaces pieces by their text (and themselves, on demand), or by the digests of pieces and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names = [c for c in part.schema.names if c != "pieces"]
                rows = _rows(part.column("pieces"))
                ids = [x.tolist() for x in rows]
                texts = lattice.plain.decode(ids) if ids else []
                if lattice.prefix:
                    texts = [x[1:] if i and lattice.plain.id_to_piece(i[0]).startswith(MARK) else x for x, i in zip(texts, ids, strict=True)]
                if keep:
                    made = ({"pieces": part.column("pieces")} if with_pieces else {}) | {"text": pa.array(texts, pa.string())}
                else:
                    made = {
                        "n_pieces": pa.array(map(len, ids), pa.int64()),
                        "pieces_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in rows], pa.string()),
                        "decoded": pa.array(map(_digest, texts), pa.string()),
                    }
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made.values()], [*names, *made])

    return run


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with its pieces column replaced by their text; null pieces are an empty text. All other columns stay."""
    ship(encoded.sparkSession)
    rest = encoded.drop("pieces", "text")
    schema = T.StructType([*rest.schema.fields, T.StructField("text", T.StringType())])
    return encoded.select(*rest.columns, "pieces").mapInArrow(lean(_decode(read_model(model), True)), schema)


def piece_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, n_chars, n_pieces, chunks, pieces_sha256 (of 4-byte little-endian ids) and round_trip.

    round_trip tells whether decoding the pieces gives the text again. See encode_documents for the method and cases.
    """
    binary = read_model(model)
    checked = _encoded(docs, id_col, text_col, binary, chunk, False, _decode(binary, False), "n_pieces long, pieces_sha256 string, decoded string")
    same = (F.col("decoded") == F.col("digest")).alias("round_trip")
    return checked.select(id_col, "n_chars", "n_pieces", "chunks", "pieces_sha256", same)


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, n_chars, digest (of the text as it is), pieces, the text that they decode to, and chunks.

    As encode_documents and decode_documents one after the other, in one pass of a task's worker.
    """
    binary = read_model(model)
    return _encoded(docs, id_col, text_col, binary, chunk, True, _decode(binary, True, True), "pieces array<int>, text string")
