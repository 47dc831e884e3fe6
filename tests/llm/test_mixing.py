import re
from collections import defaultdict

from parchment.llm.mixing import weighted_mix


def targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    """Share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    got, open_, left = {}, set(order), budget * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not full:
            return got | {s: left * w[s] / total for s in open_}
        for s in full:
            got[s] = cap * sizes[s]
        left -= sum(got[s] for s in full)
        open_ -= full
    return got


def check(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = targets(sizes)
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(most.values(), default=0)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_targets_and_reruns(documents):
    a = sorted(weighted_mix(documents).collect())
    check(a)
    assert a == sorted(weighted_mix(documents.repartition(5)).collect())
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) for r in a)


def test_awkward(awkward, empty):
    rows = weighted_mix(awkward).collect()
    assert len(rows) == awkward.count()
    check(rows)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert weighted_mix(empty).collect() == []


def test_single_document(table):
    (row,) = weighted_mix(table([(1, "a b c", "s")])).collect()
    assert (row.size, row.target, row.taken) == (3, 4.5, 3)


def test_slices_of_sources_change_nothing(monkeypatch, documents):
    """Running sums in many small slices of a source give the mix of one slice."""
    from parchment.llm import mixing

    rows = lambda: sorted(map(tuple, mixing.weighted_mix(documents).collect()))
    want = rows()
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)
    assert rows() == want
