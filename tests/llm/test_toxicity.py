import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parchment.llm import toxicity
from parchment.llm.toxicity import BlockMaxIndex, fit_toxicity, toxicity_scores, unit_weights


def test_held_out(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no driver tables")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_scores(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    yes, no = ([s for s, y in held if y == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no)) > 0.8


def test_awkward(awkward, empty, labels, spark):
    rows = toxicity_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_scores(empty, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity_scores(awkward, none).collect()} == {0.5}


@pytest.mark.parametrize("block", [3, 64])
def test_index_is_exact(monkeypatch, block):
    """Skipping blocks changes nothing: the cosines of the nearest examples are those of a full search."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(4)
    n_terms, idf = 40, 3 * rng.random(40)
    chosen = [np.sort(rng.choice(n_terms, rng.integers(1, 9), replace=False)) for _ in range(200)]
    ends = np.append(0, np.cumsum([len(c) for c in chosen]))
    places = np.concatenate(chosen)
    weights = unit_weights(places, rng.integers(1, 4, len(places)), ends, idf)
    every = np.zeros((200, n_terms))
    every[np.repeat(np.arange(200), np.diff(ends)), places] = weights
    labels = rng.integers(0, 2, 200)
    index = BlockMaxIndex.build(np.arange(200) + 1000, labels, places, weights, ends, n_terms)
    assert {i: y for i, y in zip(index.ids, index.labels, strict=True)} == {i + 1000: y for i, y in enumerate(labels)}
    upto = ends[40]
    for leave in (False, True):
        got, done = index.search(places[:upto], weights[:upto], ends[:41], 10, leave)
        assert block > 3 or done.mean() < 0.6
        full = every[:40] @ every.T
        full = np.where(leave & (full > 1 - 1e-5), -1.0, full)[:, index.ids - 1000]
        tenth = np.sort(full, axis=1)[:, -10, None]
        assert np.allclose(np.where(full >= tenth - 1e-6, got, 0), np.where(full >= tenth - 1e-6, full, 0), atol=2e-6)
        assert np.allclose(np.sort(got, axis=1)[:, -10:], np.sort(full, axis=1)[:, -10:], atol=2e-6)


def odds_of(cosines, k):
    """vote_odds in plain Python, from (label, cosine) of all examples."""
    base, top = sum(y for y, _ in cosines) / len(cosines), max(max(c for _, c in cosines), 0)
    k = min(k, len(cosines))
    last = sorted((c for _, c in cosines), reverse=True)[k - 1]
    left = (k - sum(c > last for _, c in cosines)) / sum(c == last for _, c in cosines)
    votes = [sum((1 if c > last else left) * max(c, 0) / (top or 1) for y, c in cosines if c >= last and y == label) for label in (0, 1)]
    share = (votes[1] + 3 * base) / (sum(votes) + 3)
    return math.log(share / (1 - share))


def test_votes_against_plain_version():
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 2, 60).astype(float)
    cosines = rng.integers(-1, 8, (50, 60)) / 10  # many ties
    for k in (1, 5, 20, 60, 90):
        got = toxicity.vote_odds(cosines, labels, k)
        assert np.allclose(got, [odds_of(list(zip(labels, row, strict=True)), k) for row in cosines.tolist()])


def test_more_toxic_neighbours_never_lower_the_score(documents, labels):
    slopes = fit_toxicity(documents, labels, "doc_id", "text", "toxic", 4000, 48 << 20).slopes
    assert min(slopes) >= 0 < max(slopes)


def test_long_texts_draw_fewer_examples(documents, labels):
    """The bytes of the examples are bounded, whatever their number."""
    few = fit_toxicity(documents, labels, "doc_id", "text", "toxic", 4000, 100_000)
    full = fit_toxicity(documents, labels, "doc_id", "text", "toxic", 4000, 48 << 20)
    assert 0 < sum(few.examples.value.sizes) < sum(full.examples.value.sizes) / 2


def test_scores_are_those_of_a_full_search(documents, labels):
    """Features and scores of real texts, from TF-IDF vectors of whole texts in plain Python."""
    texts = [(r.doc_id, Counter(re.findall("[a-z0-9\\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")))) for r in documents.collect()]
    df = Counter(t for _, c in texts for t in c)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    idf = {t: math.log((1 + len(texts)) / (1 + n)) for t, n in df.items()}

    def vector(counts):
        out = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in out.values())) or 1
        return {t: w / length for t, w in out.items()}

    examples = [(i, truth[i], vector(c)) for i, c in texts if i in truth and zlib.crc32(str(i).encode()) % 5]
    model = fit_toxicity(documents, labels, "doc_id", "text", "toxic", 4000, 48 << 20)
    assert model.examples.value.sizes == tuple(sum(y == k for _, y, _ in examples) for k in (0, 1))
    got = {r.doc_id: r for r in toxicity_scores(documents, labels).collect()}
    for i, counts in texts:
        v = vector(counts)
        cosines = [(y, round(sum(w * e.get(t, 0) for t, w in v.items()), 9), j) for j, y, e in examples]
        best = max(c for _, c, _ in cosines)
        if best <= 0:
            assert got[i].evidence == [] and got[i].score == model.base
            continue
        near = {j: c for _, c, j in cosines}
        assert abs(near[got[i].evidence[0]] - best) < 1e-4
        near = [(y, round(c, 6)) for y, c, _ in cosines]
        total = model.intercept + sum(w * odds_of(near, k) for w, k in zip(model.slopes, toxicity.NEAREST, strict=True))
        assert abs(got[i].score - 1 / (1 + math.exp(-total))) < 1e-2
        assert got[i].predicted == (got[i].score >= 0.5)


def test_whole_texts_count(table, spark):
    """A near copy of a single toxic example finds it, though its other words are new."""
    rng = np.random.default_rng(7)
    word = lambda: f"w{int(rng.zipf(1.3)) % 400}"
    texts = {i: " ".join(word() for _ in range(rng.integers(3, 60))) for i in range(120)}
    rare = " ".join(f"odd{j}" for j in range(12))
    texts |= {1001: rare + " w1 w2", 1003: rare + " w3 new1 new2", 1004: "only here", 1005: ""}
    assert zlib.crc32(b"1001") % 5
    toxic = {i: int(i % 4 == 0) for i in range(60)} | {1001: 1}
    rows = toxicity_scores(table([(i, t, "s") for i, t in texts.items()]), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1003].evidence[0] == 1001
    assert got[1004].evidence == [] and got[1004].score == got[1005].score


def test_bound_on_examples(documents, labels):
    """Fewer examples than labels: the classes weigh by their rates of drawing."""
    model = fit_toxicity(documents, labels, "doc_id", "text", "toxic", 20, 48 << 20)
    assert 0 < sum(model.examples.value.sizes) < 60
    full = fit_toxicity(documents, labels, "doc_id", "text", "toxic", 4000, 48 << 20)
    assert abs(model.base - full.base) < 0.1
