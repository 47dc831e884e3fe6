"""Runs against their definition, word by word."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from parchment.llm import kernels as K
from parchment.llm import periodic_runs as R


def runs_of(words):
    """All (start, length, period) by the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def report_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
        sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def texts():
    """Words of small alphabets with repeats of many periods, nested ones too."""
    rng = np.random.default_rng(3)
    out = ["", "a", "a " * 5, "a " * 6, "a " * 400, "a b " * 3 + "a", "a b " * 4, "b " * 7 + "a b " * 9 + "c", "x y z " * 40 + "x y"]
    for _ in range(60):
        words = []
        while len(words) < rng.integers(1, 260):
            unit = [str(x) for x in rng.integers(0, rng.integers(1, 5), rng.integers(1, 24))]
            words += unit * int(rng.integers(1, 9)) + unit[: rng.integers(0, len(unit) + 1)]
        out.append(" ".join(words))
    out.append(" ".join((["a"] * 9 + ["b"]) * 6 + ["c"] + (["a", "b"] * 4 + ["d"]) * 5))
    return out


def hashed(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return K.word_hashes(raw, np.array([0, len(raw)]), lower=False)[0]


def test_batches_and_strips_give_the_definition():
    all_texts = texts()
    want = [runs_of(t.split()) for t in all_texts]
    hashes = [hashed(t) for t in all_texts]
    rows = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    got = [[] for _ in all_texts]
    for d, *run in zip(*map(list, R.batch_runs(np.concatenate(hashes), rows)), strict=True):
        got[d].append(tuple(map(int, run)))
    assert got == want


@pytest.mark.parametrize("strip", [4, 32])
def test_stitched_strips_give_the_definition(spark, table, strip):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    out = R.periodic_runs(table(rows), long_bytes=0, strip_words=strip).collect()
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in out} == {i: runs_of(t.split()) for i, t, _ in rows}
    assert {r.doc_id: r.collapsed for r in out} == {r.doc_id: r.collapsed for r in R.periodic_runs(table(rows)).collect()}


def test_a_tile_gives_one_lag():
    w = hashed("a " * 5000)
    assert sum(len(R.strip_stretches(w, s, a, b)[0]) for s, a, b in R.strips(len(w), 512)) < 400


def test_report_equals_definition(table, awkward, empty, documents):
    rows = [tuple(r) for r in R.run_report(documents.where("n_chars < 9000")).collect()]
    want = [report_of(r.doc_id, r.text) for r in documents.where("n_chars < 9000").select("doc_id", "text").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert any(r[1] for r in rows)
    small = awkward.where("text is null or length(text) < 9000")
    got = sorted((tuple(r) for r in R.run_report(small).collect()), key=str)
    assert got == sorted((report_of(r.doc_id, r.text) for r in small.collect()), key=str)
    assert R.run_report(awkward).count() == awkward.count()
    assert R.run_report(empty).count() == 0
