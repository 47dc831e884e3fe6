"""Least edits between two texts, and the changes of each pair of a table."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.runtime import ship

#: edits that are looked for before a pair of stretches is parted at lines that both hold once
MOST_EDITS = 2000


def _shared(equal, n: int) -> int:
    """The greatest length up to n for which equal(0, length) holds, in growing steps, then by halves: slices compare far quicker than characters."""
    good, step = 0, 16
    while good < n and equal(good, min(good + step, n)):
        good, step = min(good + step, n), 4 * step
    bad = min(good + step, n)
    while good < bad:
        middle = (good + bad + 1) // 2
        good, bad = (middle, bad) if equal(good, middle) else (good, middle - 1)
    return good


class _Pair:
    """Two texts, of which stretches a[low:high] and b[low_b:high_b] are compared."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b

    def front(self, i: int, j: int, n: int) -> int:
        """How many of n characters from i and j on are equal."""
        a, b = self.a, self.b
        return _shared(lambda x, y: a[i + x : i + y] == b[j + x : j + y], n) if n > 0 and a[i] == b[j] else 0

    def back(self, i: int, j: int, n: int) -> int:
        """How many of n characters before i and j are equal."""
        a, b = self.a, self.b
        return _shared(lambda x, y: a[i - y : i - x] == b[j - y : j - x], n) if n > 0 and a[i - 1] == b[j - 1] else 0

    def middle(self, low: int, high: int, low_b: int, high_b: int, most: int) -> tuple[int, int] | None:
        """A place that a way of least edits passes, about half of them before it; None beyond ``most`` edits.

        Two searches, from the start and from the end, keep for each diagonal k = x - y the furthest x that d edits reach, or -1 where
        that is outside; where they meet on a diagonal, the way goes through. Only the two frontiers are kept.
        """
        n, m = high - low, high_b - low_b
        delta = n - m
        forth, back = {1: 0}, {1: 0}
        for d in range(most // 2 + 1):
            for mine, theirs, ahead in ((forth, back, True), (back, forth, False)):
                for k in range(-d, d + 1, 2):
                    down, right = mine.get(k + 1, -1), mine.get(k - 1, -1)
                    x = max(down, right + 1 if 0 <= right < n else -1)
                    y = x - k
                    if x < 0 or not 0 <= y <= m:
                        mine[k] = -1
                        continue
                    left = min(n - x, m - y)
                    x += self.front(low + x, low_b + y, left) if ahead else self.back(high - x, high_b - y, left)
                    mine[k] = x
                    # the other search is one step behind in the first half of a round, level in the second
                    reach = d - 1 if ahead else d
                    other = theirs.get(delta - k, -1) if abs(delta - k) <= reach and (delta - k - reach) % 2 == 0 else -1
                    if other >= 0 and x + other >= n:
                        return (low + x, low_b + x - k) if ahead else (high - x, high_b - x + k)
        return None

    def anchors(self, low: int, high: int, low_b: int, high_b: int) -> list[tuple[int, int, int]]:
        """(place, place, length) of lines that both stretches hold just once, the most that stand in one order on both sides."""

        def lines(text: str, at: int, end: int) -> dict[str, int]:
            found = text[at:end].splitlines(keepends=True)
            once, places = Counter(found), {}
            for x in found:
                if once[x] == 1:
                    places[x] = at
                at += len(x)
            return places

        mine, theirs = lines(self.a, low, high), lines(self.b, low_b, high_b)
        both = [(i, theirs[x], len(x)) for x, i in mine.items() if x in theirs]
        tops: list[int] = []
        ends: list[int] = []
        before = [-1] * len(both)
        for p, (_, j, _) in enumerate(both):
            k = bisect_left(tops, j)
            before[p] = ends[k - 1] if k else -1
            tops[k : k + 1], ends[k : k + 1] = [j], [p]
        out, p = [], ends[-1] if ends else -1
        while p >= 0:
            out.append(both[p])
            p = before[p]
        return out[::-1]

    def hunks(self, most: int) -> Iterator[tuple[int, int, int, int]]:
        """(low, high, low_b, high_b) of what differs, in order."""
        todo = [(0, len(self.a), 0, len(self.b))]
        while todo:
            low, high, low_b, high_b = todo.pop()
            n = self.front(low, low_b, min(high - low, high_b - low_b))
            low, low_b = low + n, low_b + n
            n = self.back(high, high_b, min(high - low, high_b - low_b))
            high, high_b = high - n, high_b - n
            if low == high or low_b == high_b:
                if low < high or low_b < high_b:
                    yield low, high, low_b, high_b
            elif at := self.middle(low, high, low_b, high_b, most):
                todo += [(at[0], high, at[1], high_b), (low, at[0], low_b, at[1])]
            elif marks := self.anchors(low, high, low_b, high_b):
                parts, i, j = [], low, low_b
                for x, y, n in marks:
                    parts.append((i, x, j, y))
                    i, j = x + n, y + n
                todo += [(i, high, j, high_b), *parts[::-1]]
            else:
                yield low, high, low_b, high_b


def changes(before: str, after: str, most: int = MOST_EDITS) -> list[tuple[str, str, str]]:
    """(op, before, after) in order: equal, delete, insert or replace; both sides joined give the texts.

    Edits (characters deleted plus inserted) are as few as can be, where there are at most ``most`` of them. Stretches with more are
    first parted at lines that both hold once, in the longest common order, and where there is none they are one replacement.
    """
    found: list[list[int]] = []
    for low, high, low_b, high_b in _Pair(before, after).hunks(most):
        if found and found[-1][1] == low and found[-1][3] == low_b:
            found[-1][1], found[-1][3] = high, high_b
        else:
            found.append([low, high, low_b, high_b])
    out, i, j = [], 0, 0
    for low, high, low_b, high_b in found:
        if i < low:
            out.append(("equal", before[i:low], after[j:low_b]))
        out.append(("delete" if low_b == high_b else "insert" if low == high else "replace", before[low:high], after[low_b:high_b]))
        i, j = high, high_b
    if i < len(before):
        out.append(("equal", before[i:], after[j:]))
    return out


def text_diff(pairs: DataFrame, key: str, before: str, after: str, most: int = MOST_EDITS) -> DataFrame:
    """(key, changes, distance, edits): pairs' changes, see changes(); null texts are empty.

    edits counts the characters deleted and inserted, distance the greater side of each change. Equal texts have no edits, and empty
    ones no changes; repeated keys are rows of their own.
    """
    kind = pa.list_(pa.struct([("op", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [changes(a.as_py() or "", b.as_py() or "", most) for a, b in zip(part.column(1), part.column(2), strict=True)]
                cells = pa.array([[dict(zip(("op", "before", "after"), c, strict=True)) for c in row] for row in rows], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), cells], [key, "changes"])

    ship(pairs.sparkSession)
    out = pairs.select(key, before, after).mapInArrow(diff, f"`{key}` {pairs.schema[key].dataType.simpleString()}, changes array<struct<op:string,before:string,after:string>>")
    unlike = F.filter("changes", lambda x: x["op"] != "equal")
    total = lambda f: F.aggregate(unlike, F.lit(0), lambda s, x: s + f(F.length(x["before"]), F.length(x["after"])))
    return out.withColumn("distance", total(lambda a, b: F.greatest(a, b))).withColumn("edits", total(lambda a, b: a + b))
