import zlib
from collections import defaultdict

import pytest

from parchment.llm import token_counts as C
from parchment.llm.sharding import shard_documents


def test_length_sums(documents, awkward, empty):
    pytest.importorskip("tiktoken")
    with open(C.RANKS, "rb") as f:
        encoding = C._encoding(f.read())
    for docs in (documents, awkward):
        lengths = sorted(len(encoding.encode_ordinary(r.text)) if r.text else 0 for r in docs.collect())
        sums = C.length_sums(C.length_histogram(docs))
        for r in sums.collect():
            n = r.n_tokens
            assert r.docs == lengths.count(n) and r.docs_over == sum(x > n for x in lengths)
            assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.total_tokens == sum(lengths)
            assert r.tokens_upto == sum(x for x in lengths if x <= n)
        for limit in (0, 3, 100, 10**6):
            assert C.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
        assert C.length_quantile(sums, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    assert C.length_histogram(empty).collect() == []


@pytest.mark.parametrize("name", ["documents", "awkward", "copies", "empty"])
def test_shards(request, name, table):
    docs = table([(i, "same text of a large group", "s") for i in range(3000)] + [(5000 + i, f"text {i}", "s") for i in range(3000)]) if name == "copies" else request.getfixturevalue(name)
    rows = shard_documents(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    slots, sizes, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            where[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    if name == "documents":
        mean = sum(sizes.values()) / 24
        largest = max(r.size for r in rows)
        assert len(sizes) == 24 and max(sizes.values()) <= 1.1 * mean + largest
    if name == "copies":
        mean = sum(sizes.values()) / 24
        assert all(0.95 * mean < x < 1.05 * mean for x in sizes.values())
        assert sum(len(s) > 1 for s in where.values()) == 1


def test_sizes_and_checksums(documents):
    """Sizes and CRCs of the shard query against plain ones, and bytes of shards near equal."""
    import zlib
    from collections import Counter

    from parchment.llm.sharding import shard_documents

    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    rows = shard_documents(documents).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    bytes_of = Counter()
    for r in rows:
        bytes_of[r.shard] += r.size
    mean = sum(bytes_of.values()) / 24
    assert set(bytes_of) <= set(range(24)) and max(bytes_of.values()) <= mean + max(map(len, texts.values())) + 8 + 0.01 * mean
