"""The comment scanner in chunks against one scan, literals against their pattern, and spans against a plain join."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parchment.functions.text import HAN
from parchment.operators import comments as C
from parchment.plans import jobs

HAN_LETTERS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HAN) + "]")
TOKENS = ["/*", "*/", "<!--", "-->", "'''", '"""', "`", "\n", "\n", "\n", "中", "a", "x", "=", "//", "#", "--", " ", "/", "[", "]", "\\", ";", "(", ")", "const ", '"', "'", "{", "url(", ":", "b"]


def some_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(TOKENS) for _ in range(rng.randrange(5, 120))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 12, 40])
def test_chunks_give_what_one_scan_gives(spark, chunk):
    texts = some_texts(250) + ["", "a // 中", "/* 中\n" * 30, ("/* 中 */ x\n" + "`\n中`\n") * 20, ("<!--\n" * 5 + "x\n-->\n") * 3 + "// 中"]
    texts += texts[:5]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8]), (9000, None)], "k int, text string")
    got, want = {}, {}
    for r in C.comment_spans(docs, "k", "text", chunk=chunk).collect():
        got.setdefault(r.k, []).append((r.start, r.stop, r.kind, r.reason))
    for r in docs.collect():
        spans, doubts = C.scan_comments(r.text or "", HAN_LETTERS)
        rows = [(*s, "") for s in spans] + [(a, a, "uncertain", w) for a, w in doubts]
        if rows:
            want.setdefault(r.k, []).extend(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_literals_end_where_the_pattern_says():
    rng = random.Random(4)
    for _ in range(4000):
        line = "".join(rng.choice("/[]\\ab") for _ in range(rng.randrange(1, 14))) + rng.choice(["", "\n x/"])
        eol = line.find("\n") if "\n" in line else len(line)
        known = C._Literals(line)
        for i in (i for i in range(eol) if line[i] == "/"):
            found = C.REGEX_LITERAL.match(line, i)
            assert known.end(i, eol) == (found.end() if found else -1)


@pytest.mark.parametrize("unit", ["= /[ ", '"', "`", "' ", "/ ", "-", "--中", "=/a[/ ", "= /\\", "#{", " #,", "/*", "x\n`"])
def test_a_megabyte_is_scanned_in_linear_time(unit):
    took = []
    for size in (250_000, 1_000_000):
        began = time.perf_counter()
        C.scan_comments(unit * (size // len(unit)), HAN_LETTERS)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1 and took[1] < 20


def plain_strip(paras, spans):
    out, at = [], 0
    for p in paras:
        cuts = [(max(a - at, 0), min(b - at, len(p))) for a, b in spans if a < at + len(p) and b > at and b > a]
        keep = [c for i, c in enumerate(p) if not any(a <= i < b for a, b in cuts)]
        text = "".join(keep).rstrip(" ") if cuts else p
        out.append((text, len(cuts), bool(cuts) and not text.strip(" ")))
        at += len(p) + 1
    return out


@pytest.mark.parametrize("bucket", [3, 4096])
def test_strip_spans_against_plain_version(spark, monkeypatch, bucket):
    monkeypatch.setattr(C, "BUCKET", bucket)
    monkeypatch.setattr(C.overlapping, "__defaults__", (bucket,))
    rng = random.Random(5)
    docs, cuts = {}, {}
    for d in range(25):
        docs[d] = ["".join(rng.choice("ab 😀") for _ in range(rng.randrange(0, 15))) for _ in range(rng.randrange(1, 12))]
        n = sum(map(len, docs[d])) + len(docs[d])
        cuts[d] = [tuple(sorted((rng.randrange(n + 1), rng.randrange(n + 1)))) for _ in range(rng.randrange(0, 6))]
    paras = spark.createDataFrame([(d, i, p) for d, ps in docs.items() for i, p in enumerate(ps)], "d int, i int, t string")
    spans = spark.createDataFrame([(d, a, b) for d, xs in cuts.items() for a, b in xs], "d int, start int, stop int")
    got = {(r.d, r.i): (r.t, r.removed, r.emptied) for r in C.strip_spans(paras, spans, "d", "i", "t").collect()}
    assert got == {(d, i): x for d in docs for i, x in enumerate(plain_strip(docs[d], cuts[d]))}


def test_very_many_paragraphs_and_spans(spark):
    n = 100_000
    paras = spark.range(n).select(F.lit(1).alias("d"), F.col("id").cast("int").alias("i"), F.lit("abc # def").alias("t"))
    spans = spark.range(n).select(F.lit(1).alias("d"), (F.col("id") * 10 + 4).cast("int").alias("start"), (F.col("id") * 10 + 9).cast("int").alias("stop"))
    spans = spans.union(spark.createDataFrame([(1, 0, 10 * n // 2)], "d int, start int, stop int"))
    began = time.perf_counter()
    out = C.strip_spans(paras, spans, "d", "i", "t").groupBy("t", "removed").count().collect()
    assert sorted((r.t, r.removed, r["count"]) for r in out) == [("", 2, n // 2), ("abc", 1, n // 2)]
    assert time.perf_counter() - began < 60


def test_findings(spark):
    lines = ["int a; // 甲", "", "/* 乙", "丙 */ x", "v = n // 数", "`open"]
    paras = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, i int, text string")
    got = sorted(tuple(r) for r in jobs.comment_findings(paras, "doc", "i", "text", HAN).collect())
    assert got == [
        ("d", 0, "deleted", "int a; // 甲", "int a;", "comment in the script"), ("d", 2, "deleted", "/* 乙", "", "comment in the script"),
        ("d", 3, "deleted", "丙 */ x", " x", "comment in the script"), ("d", 4, "uncertain", "v = n // 数", "v = n // 数", "comment or division"),
        ("d", 5, "uncertain", "`open", "`open", "unclosed template"),
    ]
