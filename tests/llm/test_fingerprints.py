import hashlib

import pytest

from parchment.llm.fingerprints import fingerprint_documents, near_counts


def brute(docs):
    """Edited texts by walking the documents in order."""
    rows = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in docs), key=lambda r: r)
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        n = len(t) // 4
        out.append((d, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_edited_texts_and_neighbours(request, name):
    docs = request.getfixturevalue(name)
    got = fingerprint_documents(docs).collect()
    low = lambda d: d if d is not None else -(1 << 63)
    if name == "documents":
        assert sorted((low(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count()
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        assert r.n_near == sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in prints)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert same.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint


def test_edits_stay_near(documents):
    got = fingerprint_documents(documents.where("n_chars > 800")).collect()
    assert sum(r.near_edited for r in got) / len(got) > 0.6
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)


def test_block_tables_find_all(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & ((1 << 64) - 1) for b in base for _ in range(20)]
    prints += prints[:50]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    got = {r.fp: r.n_near for r in near_counts(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    for x, s in zip(prints, signed, strict=True):
        assert got[s] == sum((x ^ y).bit_count() <= 3 for y in prints)


def test_empty_and_single(empty, table):
    assert fingerprint_documents(empty).collect() == []
    (row,) = fingerprint_documents(table([(9, "one two three four", "s")])).collect()
    assert row.near_next == 1.0 and row.n_near == 1
