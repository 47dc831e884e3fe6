"""Changes rebuild both texts with the least edits, and large texts take little time."""

import random
import time

import pytest

from parchment.operators import diff


def least_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def edits(found):
    return sum(len(a) + len(b) for op, a, b in found if op != "equal")


def check(a, b, found):
    assert "".join(x for _, x, _ in found) == a and "".join(x for _, _, x in found) == b
    for op, x, y in found:
        assert op == ("equal" if x == y else "delete" if not y else "insert" if not x else "replace") and (x or y)
    assert all("equal" in (p[0], q[0]) and p[0] != q[0] for p, q in zip(found, found[1:], strict=False))


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_least_edits(letters):
    rng = random.Random(len(letters))
    for _ in range(1500):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randrange(len(a) + 1)] + b[:4] + a[rng.randrange(len(a) + 1) :]
        found = diff.changes(a, b)
        check(a, b, found)
        assert edits(found) == least_edits(a, b)


def test_beyond_the_bound():
    rng = random.Random(2)
    line = lambda: "".join(rng.choice("abcdef") for _ in range(20)) + "\n"
    shared = [line() for _ in range(30)]
    a = "".join(line() + x for x in shared)
    b = "".join(x + line() for x in shared)
    for most in (0, 3, 10_000):
        found = diff.changes(a, b, most)
        check(a, b, found)
        assert edits(found) <= 31 * 21 * 2


def test_large_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghij \n") for _ in range(200_000))
    parts = list(a)
    for _ in range(300):
        parts[rng.randrange(len(parts))] = rng.choice(["", "x", "yz"])
    b = "".join(parts)
    began = time.perf_counter()
    found = diff.changes(a, b)
    took = time.perf_counter() - began
    check(a, b, found)
    assert edits(found) <= 900 and took < 5
    other = "".join(rng.choice("klmnopqrst \n") for _ in range(200_000))
    began = time.perf_counter()
    check(a, other, diff.changes(a, other, 200))
    assert time.perf_counter() - began < 20


def test_table(spark):
    rows = [(1, "abc", "axc"), (1, None, "b"), (None, "same", "same"), (2, "", ""), (3, "x" * 50_000, "x" * 49_999 + "y")]
    got = diff.text_diff(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect()
    assert sorted((r.k or 0, r.distance, r.edits, len(r.changes)) for r in got) == [(0, 0, 0, 1), (1, 1, 1, 1), (1, 1, 2, 3), (2, 0, 0, 0), (3, 1, 2, 2)]
