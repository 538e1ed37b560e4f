"""Scalar Column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where either is null or b is 0."""
    return F.when(b != 0, a / b)


def between_closed(c: Column, low: float, high: float) -> Column:
    """False for null, unlike a bare comparison."""
    return F.coalesce(c.between(low, high), F.lit(False))


def at_least(flags: list[Column], k: int) -> Column:
    """Whether k of the flags hold; k = 1 is ANY and k = len(flags) ALL."""
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags]) >= k


def edge_bucket(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Half-open buckets from each edge to the next; anything else that isn't null gets the last label."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = out.when((c >= low) & (c < high), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def session_bucket(minute: Column) -> Column:
    """Part of the day by minute since midnight."""
    return F.when(minute < 570, "pre").when(minute < 720, "morning").when(minute < 960, "afternoon").otherwise("post")


def rank_bin(rank: Column, n: Column, bins: int) -> Column:
    """Equal-count bin of an ordinal rank from 1."""
    return F.least(F.floor((rank - 1) / n * bins), F.lit(bins - 1)).cast("int")


def chunks(quantity: Column, most: int) -> Column:
    """Array of sizes of at most ``most`` that add up to quantity."""
    n = F.ceil(quantity / most).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.lit(most).cast("long"), quantity - i * most))
