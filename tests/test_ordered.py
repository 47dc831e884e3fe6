"""Places and digest trees of small, odd and large groups."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from parchment.operators import gates, inventory, ordered
from parchment.plans import jobs
from parchment.plans.queries import ORACLE, QUERIES


def table(spark):
    rows = [("a", i * 7 % 23, f"v{i}") for i in range(23)] + [("b", 1, "x"), (None, 2, "y"), (None, 1, None), ("c", None, "z"), ("c", 5, "w")]
    return spark.createDataFrame(rows, "k string, o int, v string")


@pytest.mark.parametrize("window_rows", [100, 1, 0])
def test_places(spark, window_rows):
    got = ordered.places(table(spark), ["k"], ["o"], window_rows).collect()
    want = {}
    for k, o, v in sorted((tuple(r) for r in table(spark).collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
        want.setdefault(k, []).append((o, v))
    assert {(r.k, r.o, r.v): (r.place, r.total) for r in got} == {(k, *x): (i, len(xs)) for k, xs in want.items() for i, x in enumerate(xs)}
    assert ordered.places(table(spark).where("false"), ["k"], ["o"], window_rows).count() == 0


def tree(values, chunk):
    sha = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    level = [sha(v for v in values[i : i + chunk] if v is not None) for i in range(0, len(values), chunk)]
    while len(level) > 1:
        level = [sha(level[i : i + chunk]) if i or len(level) > 1 else level[0] for i in range(0, len(level), chunk)]
    return level[0]


@pytest.mark.parametrize("chunk", [2, 3, 5, 100])
@pytest.mark.parametrize("window_rows", [100, 1])
def test_digest_tree(spark, chunk, window_rows):
    rows = [("a", i, f"v{i}") for i in range(15)] + [("b", 1, None), ("b", 2, "x"), (None, 1, "y")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {r.k: (r.n, r.total, r.fingerprint) for r in ordered.digest_tree(df, ["k"], ["o"], F.col("v"), {"total": F.col("o")}, chunk, window_rows).collect()}
    want = {}
    for k, _, v in rows:
        want.setdefault(k, []).append(v)
    assert {k: x[2] for k, x in got.items()} == {k: tree(v, chunk) for k, v in want.items()}
    assert got["a"][:2] == (15, 105)


def test_a_large_group_is_sampled_and_digested(spark):
    big = spark.range(0, 1_200_000, 1, 6).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("v"))
    big = big.union(spark.createDataFrame([("cold", 1, "a")], "k string, o long, v string"))
    began = time.perf_counter()
    got = gates.equidistant_sample(big, "k", ["o"]).agg(F.count("*").alias("n"), F.max("o").alias("top"), F.sum("o").alias("sum")).first()
    n = 300_000
    want = sum(round(i * 1_199_999 / (n - 1)) for i in range(n))
    assert (got.n, got.top, got.sum) == (n + 1, 1_199_999, want + 1)
    prints = {r.key: r.fingerprint for r in inventory.fingerprint(big.withColumnRenamed("k", "key"), "key", "o", "v").collect()}
    assert prints["hot"] == tree([str(i) for i in range(1_200_000)], ordered.CHUNK) and prints["cold"] == tree(["a"], 9)
    assert time.perf_counter() - began < 120


def test_delivery_manifest_of_equal_paths(spark):
    files = spark.createDataFrame([("b", "B/f", "B/f/x.txt", 3, "1"), ("b", "B/f", "B/f/X.txt", 4, "2"), ("b", "B/g", "B/g/y.txt", 1, "3")], "batch string, folder string, path string, length long, sha256 string")
    chosen = spark.createDataFrame([("b", "b/F"), ("b", "b/f")], "batch string, folder string")
    got = jobs.delivery_manifest(files, chosen).collect()
    assert [tuple(r) for r in got] == [("b", "B/f", 2, 7, tree(["2", "1"], 9))]


@pytest.mark.parametrize("window_rows", [10_000, 1])
def test_digest_chain(spark, window_rows):
    """One SHA-256 over all values, over pieces and batches; null values are left out, also where they fill a piece."""
    rows = [("a", i, f"v{i}é") for i in range(15)] + [("b", i, None if i < 7 else "" if i == 7 else "x") for i in range(9)] + [(None, 1, "y"), ("n", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    want = {}
    for k, _, v in rows:
        want.setdefault(k, []).append(v)
    for piece in (1, 3, 64):
        got = {r.k: (r.n, r.total, r.fingerprint) for r in ordered.digest_chain(df, ["k"], ["o"], F.col("v"), {"total": F.col("o")}, piece, window_rows).collect()}
        assert {k: (x[0], x[2]) for k, x in got.items()} == {k: (len(v), tree(v, 100)) for k, v in want.items()} and got["a"][1] == 105
    assert ordered.digest_chain(df.where("false"), ["k"], ["o"], F.col("v")).count() == 0


def one_host(spark, folder, n=13_000):
    pages = spark.range(0, n, 1, 4).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example/x"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    pages.write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def equals_sql(spark, name, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, folder).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_batch_fingerprint_of_a_large_host(spark, tmp_path):
    assert equals_sql(spark, "batch_fingerprint", one_host(spark, tmp_path))


def test_delivery_manifest_of_a_large_folder(spark, tmp_path):
    assert equals_sql(spark, "delivery_manifest", one_host(spark, tmp_path))
