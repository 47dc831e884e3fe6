"""Column functions over image bytes and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_signature_ok(content: Column, suffix: Column) -> Column:
    """Whether the first bytes agree with the suffix; suffixes without a known signature are refused."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    s = F.lower(suffix)
    webp = (head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    ok = F.when(s == ".png", head(8) == "89504E470D0A1A0A").when(s.isin(".jpg", ".jpeg"), head(3) == "FFD8FF").when(s == ".webp", webp)
    return F.coalesce(ok, F.lit(False))


def gradient_hash(values: Column, width: int | None = None) -> Column:
    """A bit for each value that exceeds the next one, first bit highest; with ``width``, neighbours in rows of so many values.

    The bits must fit a long; null if the array is null or has a null.
    """
    n = F.size(values)
    steps = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (i < n - 1) & (F.lit(True) if width is None else (i + 1) % width != 0))
    bits = F.transform(steps, lambda i: F.get(values, i) > F.get(values, i + 1))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b))


def substantial(length: Column, hash_: Column, least: int = 10_000) -> Column:
    """Images large enough to compare, with a hash."""
    return (length >= least) & hash_.isNotNull()
