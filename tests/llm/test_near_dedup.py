import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from parchment.llm import near_dedup
from parchment.llm.components import star_components
from parchment.llm.near_dedup import near_duplicates


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{id: (component)} by all pairs that share a shingle."""
    where = defaultdict(set)
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].add(k)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {p for ks in where.values() for p in combinations(sorted(ks), 2)}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(sets_of(t)))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_documents(documents):
    check(documents)


def test_awkward(awkward, empty):
    check(awkward)
    assert near_duplicates(empty).collect() == []


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [256, 3])
def test_chains_and_crowds(table, monkeypatch, block):
    """Near copies about the threshold, a shared passage, and chains; small blocks split the buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [edited(rng, base, rng.randrange(6)) for _ in range(60)]
    texts += [passage + " " + " ".join(f"u{k}_{i}" for i in range(30)) for k in range(40)]
    chain = list(base)
    for k in range(12):
        chain = [f"c{k}"] * 3 + chain[:-3]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    check(table([(i, t, "s") for i, t in enumerate(texts)]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (None, 3)]
    got = {r.node: r.component for r in star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_one_id_with_two_texts_joins_their_sets(table):
    rows = [(5, "a b c d e f", "s"), (1, "a b c d e f", "s"), (5, "k l m n o p", "s"), (9, "k l m n o p", "s")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(table(rows)).collect()}
    assert got == {(1, 1), (5, 1), (9, 1)}


def test_beyond_the_broadcast_of_ids(monkeypatch, documents):
    """With more candidate ids than may be broadcast, texts are exchanged; the components are the same."""
    from parchment.llm import near_dedup

    rows = lambda: sorted(map(tuple, near_dedup.near_duplicates(documents).collect()))
    want = rows()
    monkeypatch.setattr(near_dedup, "MOST_IDS", 0)
    assert rows() == want
