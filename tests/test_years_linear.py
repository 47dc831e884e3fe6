"""Splicing and contexts against plain Python, and their time on texts with very many matches."""

import random
import time

from pyspark.sql import functions as F

from parchment.functions import years


def test_cut_and_splice(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("aé😀\nb ") for _ in range(5000))
    spans, at = [], 0
    while at < 4900:
        at += rng.randrange(0, 40)
        size = rng.randrange(0, 5)
        spans.append((at, size, rng.choice(["", "x", "日本"])))
        at += size
    df = spark.createDataFrame([(text, spans), (text, []), ("", []), ("ab", [(0, 2, "z")])], "c string, s array<struct<at:int,size:int,text:string>>")

    def plain(c, s):
        out, end = "", 0
        for a, n, t in s:
            out, end = out + c[end:a] + t, a + n
        return out + c[end:]

    for r in df.withColumn("out", years.splice(F.col("c"), F.col("s"))).collect():
        assert r.out == plain(r.c, r.s)
    places = [(a, n) for a in (0, 1, 1023, 1024, 1025, 3000, 4999, 5000) for n in (-1, 0, 1, 30, 1024, 2100, 9000)]
    cuts = spark.createDataFrame([(text, a, n) for a, n in places], "c string, a int, n int")
    for r in cuts.withColumn("out", years.cut(years.text_blocks(F.col("c")), F.col("a"), F.col("n"))).collect():
        assert r.out == r.c[r.a : r.a + max(r.n, 0)]


def test_running(spark):
    values = [[], [3], [5, 1, 7, 0, 9, 2] * 100]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for block in (4, 256):
        for r in df.select("v", years.running_sum(F.col("v"), block).alias("s"), years.running_max(F.col("v"), block).alias("m")).collect():
            assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.m == [max(r.v[: i + 1]) for i in range(len(r.v))]


def test_very_many_matches(spark):
    n = 100_000
    text = "current 1998-02-03 x " * n
    df = spark.createDataFrame([(text,)], "c string").repartition(1)
    began = time.perf_counter()
    got = df.select(years.rewrite_date_years(F.col("c"), 2025).alias("d"), years.rewrite_years(F.col("c"), 2025, (), ("(?:current).{0,16}YEAR",))["text"].alias("y")).first()
    assert got.d == text.replace("1998", "2025") and got.y == got.d
    assert time.perf_counter() - began < 60


def test_reasons(spark):
    df = spark.createDataFrame([("截至2023年",), ("成立于2001年",), ("x 2001 y",), ("2030",)], "c string")
    got = [r.r for r in df.select(F.get(years.rewrite_years(F.col("c"), 2025)["decisions"], F.lit(0))["reason"].alias("r")).collect()]
    assert got == ["context of the present", "context of a fixed record", "context says too little", "target year or later"]
