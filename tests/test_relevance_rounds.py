"""The best reference by rounds over the rarest tokens, against the index of all references."""

import random

from pyspark.sql import functions as F

from parchment.operators import similarity


def tables(spark, n_texts, n_refs, seed):
    rng = random.Random(seed)
    common = [f"of{i}" for i in range(6)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 400}x"
    text = lambda n: " ".join(word() for _ in range(n))
    refs = [(i, text(rng.randrange(1, 30))) for i in range(n_refs)]
    texts = [(i, rng.choice([rng.randrange(n_refs + 3), None]), text(rng.randrange(0, 40))) for i in range(n_texts)]
    texts += [(1000 + i, 0, refs[i % n_refs][1] + " extra") for i in range(15)] + [(2000, 1, " ".join(common)), (2001, 1, None), (2002, 1, "nothing-known")]
    refs += [(n_refs + 1, refs[2][1]), (n_refs + 2, refs[2][1])]  # ties
    return spark.createDataFrame(texts, "k int, own int, t string"), spark.createDataFrame(refs, "ref int, rt string")


def test_rounds_give_what_the_index_gives(spark):
    for seed in (1, 2):
        texts, refs = tables(spark, 120, 40, seed)
        run = lambda **o: sorted(map(tuple, similarity.batch_relevance(texts, refs, "k", "own", "ref", "t", "rt", (), **o).collect()), key=str)  # noqa: E731, B023
        assert run() == run(most_tokens=0)


def test_pairs_are_bounded(spark):
    """Texts that each have a near reference look up their rare tokens only, though all share frequent ones with every reference."""
    n = 400
    common = " ".join(f"of{i}x" for i in range(8))
    own = lambda i: " ".join(f"w{i}p{j}" for j in range(30))
    refs = spark.createDataFrame([(i, f"{own(i)} {common}") for i in range(n)], "ref int, rt string")
    texts = spark.createDataFrame([(i, (i + 1) % n, f"{own(i)} {common} more{i}") for i in range(n)], "k int, own int, t string")
    tokens = lambda c: similarity.semantic_tokens(F.col(c), ())
    sets = refs.select("ref", F.col("ref").cast("string").alias("name"), tokens("rt").alias("tokens"))
    rows = texts.select(F.struct("k").alias("row"), F.col("own").cast("string").alias("own"), tokens("t").alias("tokens"))
    emitted = []
    got = similarity._scored_by_rounds(rows, sets, emitted).collect()
    assert {r.row.k: r.best_ref for r in got} == {i: i for i in range(n)}
    assert sum(emitted) == n  # of n * n pairs that share a token
