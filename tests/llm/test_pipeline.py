import pytest

import corpus_pipeline
from parchment.llm.mixing import weighted_mix
from parchment.llm.near_dedup import near_duplicates
from parchment.llm.pieces import MODEL
from parchment.llm.quality_classifier import quality_scores
from parchment.llm.storage import materialize


def test_stages(spark, documents, labels, sf):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), name)
        seen[name] = before, docs
        if name != "encode":
            assert docs.columns == before.columns
    before, after = seen["quality"]
    want = {r.doc_id for r in quality_scores(before, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = seen["near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in near_duplicates(before).where("kept").collect())
    before, after = seen["secrets"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["mix"]
    want = sorted(r.doc_id for r in weighted_mix(before).collect() for _ in range(r.taken // r.size if r.size else 0))
    assert sorted(r.doc_id for r in after.collect()) == want
    before, after = seen["encode"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())


def test_awkward_stages(spark, awkward, empty, sf):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            if docs is empty:
                assert rows == []
            elif name in ("secrets", "encode"):
                assert sorted(r.doc_id or -1 for r in rows) == sorted(r.doc_id or -1 for r in docs.collect())
            elif name == "near_dedup":
                assert sorted(r.doc_id or -1 for r in rows) == [-1, -1, 1, 2, 3, 4, 6, 7]
            elif name == "mix":
                assert all(r.text.strip() for r in rows) and sum(r.doc_id == 4 for r in rows) <= 2
            if name != "encode":
                assert out.columns == docs.columns


def test_repeated_rows(spark, table, sf):
    """Exact repeats are one document to near_dedup, and the mix takes each of them by itself."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(1, text(1), "a"), (1, text(1), "a"), (1, text(9), "a"), (2, text(1), "a"), (3, text(3), "b"), (None, text(1), "a"), (None, None, "a"), (4, "", "b")]
    kept = corpus_pipeline.near_dedup(spark, table(rows), sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept)[1:3] == [(False, 3, text(3)), (False, 4, "")]
    assert [r.doc_id for r in kept].count(1) == 1 and [r.doc_id for r in kept].count(None) == 2 and len(kept) == 5
    rows = [(1 + i // 2, text(i // 2), "abc"[i % 3]) for i in range(300)] + [(None, text(i), "a") for i in range(20)]
    docs = table(rows)
    want = sorted((r.doc_id or -1, r.taken) for r in weighted_mix(docs).collect())
    got = corpus_pipeline.mix(spark, docs, sf).collect()
    assert len(got) * 40 == sum(t for _, t in want)
    for i in {i for i, _ in want}:
        assert sum(r.doc_id == i or (i == -1 and r.doc_id is None) for r in got) * 40 == sum(t for j, t in want if j == i)
    assert {r.key for r in got} == {"k"}


def test_encode_stage(spark, documents, awkward, sf):
    """Pieces and decoded texts are the library's, and round_trip is true just where the text comes back."""
    sentencepiece = pytest.importorskip("sentencepiece")
    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (documents, awkward):
        key = lambda r: (-1 if r[0] is None else r[0], r[1])
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = sorted(((i, whole.decode(p := whole.encode(t)), p, whole.decode(p) == t) for i, t in texts), key=key)
        rows = corpus_pipeline.encode(spark, docs, sf).collect()
        got = sorted(((r.doc_id, r.text, r.pieces, r.round_trip) for r in rows), key=key)
        assert got == want and all(r.n_pieces == len(r.pieces) for r in rows)
    assert [r.round_trip for r in rows if r.doc_id == 7] == [False]


def test_null_ids_are_many_keys(spark, table, sf):
    """Rows without ids are told apart by their texts, so no task gets them all."""
    docs = table([(None, " ".join(f"w{i}x{j}" for j in range(10)), "ab"[i % 2]) for i in range(400)])
    taken = weighted_mix(docs, with_turn=True)
    assert taken.select("turn").distinct().count() == 400
    got = corpus_pipeline.mix(spark, docs, sf).collect()
    assert len(got) * 10 == taken.agg({"taken": "sum"}).first()[0]
    want = sorted((r.turn, r.taken // r.size) for r in taken.where("taken > 0").collect())
    from collections import Counter

    from parchment.llm.mixing import turn_of

    turns = {r.text: r.turn for r in docs.select("text", turn_of(docs.doc_id, docs.text).alias("turn")).collect()}
    assert sorted(Counter(turns[r.text] for r in got).items()) == want


def test_whole_run_against_plain_version(spark, sf):
    """run() on the smallest tables, stage by stage in plain Python from what the operators' own reports say of the same rows."""
    sentencepiece = pytest.importorskip("sentencepiece")
    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    from parchment.llm.secrets import scan_secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}

    def shingles(text):
        import re

        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, kept = {i: shingles(r.text) for i, r in rows.items()}, {}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(rows)
    for a, i in enumerate(order):
        for j in order[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    kept = [rows[i] for i in order if find(i) == i]
    frame = spark.createDataFrame(kept, docs.schema)
    masked = {}
    for r in scan_secrets(frame, whole=True).collect():
        text, end, out = r.doc.text, 0, ""
        for s in sorted((s for s in r.spans or () if s.live), key=lambda s: s.start):
            if s.start >= end:
                out += text[end : s.start] + "<secret>"
            end = max(end, s.stop)
        masked[r.id] = out + (text or "")[end:] if end else text
    frame = spark.createDataFrame([r.asDict() | {"text": masked[r.doc_id]} for r in kept], docs.schema)
    want = sorted((r.doc_id, masked[r.doc_id]) for r in weighted_mix(frame).collect() for _ in range(r.taken // r.size if r.size else 0))
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(i, whole.decode(whole.encode(t))) for i, t in want]
    assert all(r.pieces == whole.encode(masked[r.doc_id]) for r in out)
