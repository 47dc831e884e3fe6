import hashlib
import random

import numpy as np
import pytest

from parchment.llm import pieces as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    try:
        return P.read_model(P.MODEL)
    except OSError:
        pytest.skip("no model")


def scanned(lattice, text, chunk):
    """The operator's steps on one text, without Spark."""
    t, side = P._marked(lattice, text), lattice.longest
    chunks, matrices = [], []
    for c, low in enumerate(range(0, len(t), chunk)):
        begin, high = max(0, low - side), min(len(t), low + chunk)
        chunks.append((t[begin : high + side], low - begin, high - begin))
        matrices.append(lattice.transfer(*chunks[-1], c == 0))
    ends = [reach for reach, _ in P.combine(matrices)]
    out = []
    for (x, low, high), skip, over in zip(chunks, [0, *ends[:-1]], ends, strict=True):
        out += lattice.plain.encode(x[low + skip : high + over])
    return out


@pytest.mark.parametrize("chunk", [1, 3, 16, 50])
def test_scan_equals_library(model, chunk):
    lattice, whole = P.Lattice(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(chunk)
    for _ in range(40):
        text = "".join(rng.choice(["the", "ing", "a", "  ", " ", "\n", "日", "😀", "▁", "é", "1", "000", "==", "aaaa", "tion"]) for _ in range(40))
        for x in (text, text.replace(" ", "")):
            assert scanned(lattice, x, chunk) == whole.encode(x)


@pytest.mark.parametrize("chunk", [2, 7])
def test_unigram_lattice(model, chunk):
    """The same pieces with unigram weights: the library's own best paths."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    spec.trainer_spec.model_type = 1
    rng = random.Random(1)
    for p in spec.pieces:
        if p.type == 1:
            p.score = -2.0 - rng.random() * 8 / len(p.piece)
    made = spec.SerializeToString()
    lattice, whole = P.Lattice(made), sentencepiece.SentencePieceProcessor(model_proto=made)
    for _ in range(30):
        text = "".join(rng.choice(["the", "ing", "a", " ", "tion", "e", "re"]) for _ in range(20))
        got, want = scanned(lattice, text, chunk), whole.encode(text)
        score = lambda ids: sum(whole.get_score(i) for i in ids)
        assert whole.decode(got) == whole.decode(want)
        assert abs(score(got) - score(want)) < 1e-3


@pytest.mark.parametrize("chunk", [P.CHUNK, 500])
def test_documents(model, documents, awkward, empty, chunk):
    whole = sentencepiece.SentencePieceProcessor(model_proto=model)
    for docs in (documents, awkward):
        texts = sorted((r.text or "" for r in docs.collect()))
        want = sorted(hashlib.sha256(np.array(whole.encode(t), "<i4").tobytes()).hexdigest() for t in texts)
        rows = P.piece_report(docs, chunk=chunk).collect()
        assert sorted(r.pieces_sha256 for r in rows) == want
        assert all(r.round_trip for r in rows)
        assert sorted(r.n_chars for r in rows) == sorted(map(len, texts))
    assert P.piece_report(empty, chunk=chunk).collect() == []


def test_decoding(model, awkward):
    rows = P.decode_documents(P.encode_documents(awkward, chunk=300)).collect()
    assert sorted(r.text for r in rows) == sorted((r.text or "").replace("▁", " ") for r in awkward.collect())
