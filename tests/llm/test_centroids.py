"""Centroid clustering against brute force with whole Python integers."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from tickloom.llm import centroids as op

SCHEMA = "vec_id long, embedding array<float>, cluster string, label int"


def brute(rows, clusters=op.CLUSTERS, rounds=op.ROUNDS):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), k in zip(kept, of, strict=True) if k == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in kept]
    inertia = {j: sum(d for d, k in last if k == j) for j in range(len(c))}
    fits = lambda x: x if x < 1 << 63 else None
    digest = [sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), digest[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


def held(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], kw.pop("schema", SCHEMA)).repartition(3)
    got = [tuple(r) for r in op.cluster_vectors(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted(got, key=key), sorted(brute(rows), key=key)


def vector(rng, spread=0.3):
    return [float(np.float32(rng.gauss(0, spread))) for _ in range(64)]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, vector(rng)) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65), (204, [0.5] * 63 + [None]), (205, [float("nan")] * 64), (206, [float("-inf")] + [0.0] * 63)]
    rows += [(None, vector(rng)), (7, rows[7][1]), (7, rows[7][1]), (300, [-0.0] * 64)]
    got, want = held(spark, rows)
    assert got == want and len(got) == 124


@pytest.mark.parametrize("rows", [[], [(1, [0.25] * 64)], [(i, [0.5] * 64) for i in range(30)], [(5, [0.1] * 64), (5, [0.2] * 64), (6, [0.1] * 64)]])
def test_few_equal_and_no_vectors(spark, rows):
    """Equal centroids: all vectors go to the lowest number, the other clusters stay empty."""
    got, want = held(spark, rows)
    assert got == want


def test_ties_between_centroids(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0])] + [0.0] * 63) for i in range(60)]
    got, want = held(spark, rows)
    assert got == want


def test_vectors_of_any_size(spark):
    rng = random.Random(4)
    rows = [(i, vector(rng, 10.0 ** rng.choice([-3, 0, 3, 6, 12, 30]))) for i in range(60)] + [(99, [float(np.float32(3.4e38))] * 64), (98, [float(np.float32(-1e-45))] * 64)]
    got, want = held(spark, rows)
    assert got == want and any(r[2] is None for r in got) and any(r[2] is not None for r in got)
    doubles = [(i, [1.7e308 if i % 3 == 0 else -1e-310] * 63 + [float(i)]) for i in range(12)]
    got, want = held(spark, doubles, schema=SCHEMA.replace("float", "double"))
    assert got == want


def test_screening_never_decides_wrongly():
    """Centroids that differ in one unit only, near the points: intervals overlap and integers decide."""
    rng = np.random.default_rng(3)
    for size in (10, 1000, 1 << 20, op.TAME - 2):
        base = rng.integers(-size, size + 1, 64)
        cs = [[int(x) for x in base + rng.integers(-1, 2, 64)] for _ in range(8)]
        points = base + rng.integers(-2, 3, (300, 64))
        best, exact = op.nearest(points, cs)
        d = ((points[:, None, :] - np.array(cs)[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all()
        assert exact or size == 10


def test_screening_settles_most(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    points = np.array([[op.scaled(x) for x in r["embedding"]] for r in rows])
    best, exact = op.nearest(points, points[:8].tolist())
    assert exact < 0.1 * len(points)
    assert (best == ((points[:, None, :] - points[None, :8]) ** 2).sum(axis=2).argmin(axis=1)).all()
