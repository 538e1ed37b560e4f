"""Centroid clustering of integer vectors: float32 screening with rounding-error intervals, exact integers where they overlap.

A matrix product in float32 gives x.c for all centroids at once. Whatever order it adds in, it is off by at most
g * |x| * |c| with g = m u / (1 - m u), u = 2^-24 and m the number of roundings on the way, so that every centroid's
distance lies in a known interval. A centroid whose interval lies below all others is the nearest. Where intervals
overlap, the distances to those centroids are recomputed in integers, and ties go to the lower number. Sums of a
round are exact integers, made by each task and added up by Spark: a row for each centroid and task is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, discard

DIM, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3:"
#: Up to this size integers and their squared distances are exact in float32, float64 and int64.
TAME = 1 << 24
#: Sums travel as digits of this base, each a long, so that vectors of any finite size add up exactly.
LIMB = 40
LONG_MAX = (1 << 63) - 1
#: Vectors of an Arrow batch that are multiplied together.
SLICE = 4096


def whole_vectors(vectors: DataFrame, column: str, dim: int = DIM) -> DataFrame:
    """The rows whose vector has exactly ``dim`` components, none null or not finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter((F.size(column) == dim) & ~bad)


def scaled(x: float) -> int:
    """floor(SCALE * x) of a finite x, without overflow."""
    y = x * SCALE
    return math.floor(y) if math.isfinite(y) else int(x) * SCALE


def integers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors, and whether each is tame; rows that aren't hold zeros."""
    with np.errstate(over="ignore"):
        floors = np.floor(values * float(SCALE))
    tame = (np.abs(floors) <= TAME).all(axis=1)
    floors[~tame] = 0
    return floors.astype(np.int64), tame


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, int]:
    """The number of each tame point's nearest centroid, and how many points needed exact integers."""
    c = np.array(centroids, dtype=np.float64)
    squares = (c * c).sum(axis=1)
    dot = points.astype(np.float32) @ c.astype(np.float32).T
    roundings = points.shape[1] + 2
    g = roundings * 2.0**-24 / (1 - roundings * 2.0**-24)
    lengths = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    # squares and lengths are themselves rounded in float64: the margin of 2^-30 is far above that
    error = (2 * g * np.outer(lengths, np.sqrt(squares)) + 2.0**-40 * squares) * (1 + 2.0**-30)
    middle = squares - 2 * dot.astype(np.float64)
    error += np.abs(middle) * 2.0**-50
    low, high = middle - error, middle + error
    close = low <= high.min(axis=1, keepdims=True)
    best = close.argmax(axis=1)
    open_rows = np.flatnonzero(close.sum(axis=1) > 1)
    if len(open_rows):
        rows, columns = np.nonzero(close[open_rows])
        exact = np.full((len(open_rows), len(centroids)), LONG_MAX)
        exact[rows, columns] = ((points[open_rows[rows]] - np.array(centroids, dtype=np.int64)[columns]) ** 2).sum(axis=1)
        best[open_rows] = exact.argmin(axis=1)  # the first of equal ones
    return best, len(open_rows)


def assign(values: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
    """(places, clusters, integer vectors) of the rows of values: int64 vectors of tame rows, then lists of the others."""
    points, tame = integers(values)
    if max(abs(x) for c in centroids for x in c) > TAME:
        tame[:] = False
    places = np.flatnonzero(tame)
    if len(places):
        yield places, nearest(points[places], centroids)[0], points[places]
    wild = np.flatnonzero(~tame)
    if len(wild):
        exact = [[scaled(float(x)) for x in values[i]] for i in wild]
        distances = [[sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centroids] for p in exact]
        yield wild, np.array([d.index(min(d)) for d in distances]), exact


def limbs(x: int) -> list[int]:
    """Digits of an integer to the base 2^LIMB, lowest first, all of its sign."""
    sign, x, out = (1, x, []) if x >= 0 else (-1, -x, [])
    while x:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, SLICE):
            yield whole.slice(first, SLICE)


def _sums(vectors: DataFrame, column: str, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """For each cluster that has any: the number of its vectors and their sums. A few rows reach the driver."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, [[0] * dim for _ in range(k)]
        for batch in _slices(batches):
            for _, clusters, points in assign(_matrix(batch.column(0), dim), centroids):
                for j in np.unique(clusters):
                    mine = np.flatnonzero(clusters == j)
                    counts[j] += len(mine)
                    own = points[mine].sum(axis=0).tolist() if isinstance(points, np.ndarray) else [sum(x) for x in zip(*(points[i] for i in mine), strict=True)]
                    totals[j] = [a + b for a, b in zip(totals[j], own, strict=True)]
        rows = []
        for j in range(k):
            digits = [limbs(x) for x in totals[j]]
            for limb in range(max(map(len, digits), default=0) or 1 if counts[j] else 0):
                rows.append((j, limb, 0 if limb else counts[j], [d[limb] if limb < len(d) else 0 for d in digits]))
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())]
        sums = [pa.array([r[3][i] for r in rows], pa.int64()) for i in range(dim)]
        yield pa.RecordBatch.from_arrays(columns + sums, ["cluster", "limb", "n", *(f"s{i}" for i in range(dim))])

    schema = "cluster int, limb int, n long, " + ", ".join(f"s{i} long" for i in range(dim))
    parts = vectors.select(column).mapInArrow(run, schema)
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(dim))).collect():
        n, total = found.get(r["cluster"], (0, [0] * dim))
        found[r["cluster"]] = (n + r["n"], [t + (r[f"s{i}"] << (LIMB * r["limb"])) for i, t in enumerate(total)])
    return found


def fit(vectors: DataFrame, id_column: str, column: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> list[list[int]]:
    """The centroids after ``rounds`` rounds; as many as there are vectors at most."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), F.col(column).alias("vector")).orderBy("key", "vector").limit(clusters).collect()
    centroids = [[scaled(float(x)) for x in r["vector"]] for r in first]
    for _ in range(rounds if centroids else 0):
        sums = _sums(vectors, column, centroids)
        centroids = [[x // sums[j][0] for x in sums[j][1]] if j in sums else c for j, c in enumerate(centroids)]
    return centroids


def cluster_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, salt: str = SALT) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector of the table.

    Vectors of another length, null ones and those with a null or non-finite component are left out; other columns are
    not read. Centroids start as the vectors whose salted id has the least SHA-256; equal ids are ordered by vector, a
    null id counts as an empty one. Repeated rows count, and are returned, each on their own. Equal distances go to the
    lower number, empty clusters keep their centroid. With fewer vectors than clusters there are fewer centroids; an
    empty table gives an empty result. Finite components of any size are exact; a distance or inertia beyond a long is
    null. The vectors are read once a round, without a shuffle.
    """
    kept = whole_vectors(vectors, column, dim)
    if dict(vectors.dtypes)[column] not in ("array<float>", "array<double>"):
        kept = kept.withColumn(column, F.col(column).cast("array<double>"))
    centroids = fit(kept, id_column, column, clusters, rounds, salt)
    kind = dict(vectors.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.num_rows
            cluster, distance, wide = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), [None] * n
            for places, found, points in assign(_matrix(batch.column(1), dim), centroids):
                cluster[places] = found
                if isinstance(points, np.ndarray):
                    distance[places] = ((points - np.array(centroids, dtype=np.int64)[found]) ** 2).sum(axis=1)
                    continue
                for i, j, p in zip(places, found, points, strict=True):
                    exact = sum((a - b) ** 2 for a, b in zip(p, centroids[j], strict=True))
                    distance[i], wide[i] = (exact, None) if exact <= LONG_MAX else (0, True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance), pa.array(wide, pa.bool_())], [id_column, "cluster", "distance", "wide"])

    found = kept.select(id_column, column).mapInArrow(run, f"`{id_column}` {kind}, cluster int, distance long, wide boolean")
    rows = cut(found)
    fits = F.count("wide") == 0
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["total"]) if r["fits"] else None for r in rows.groupBy("cluster").agg(exact.alias("total"), fits.alias("fits")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    long = lambda x: x if x is not None and x <= LONG_MAX else None
    digest = lambda c: sha256(",".join(map(str, c)).encode()).hexdigest()
    table = [(j, long(sums.get(j)), long(whole), digest(c)) for j, c in enumerate(centroids)]
    facts = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    distance = F.when(F.col("wide").isNull(), F.col("distance")).alias("distance")
    return rows.join(F.broadcast(facts), "cluster").select(id_column, "cluster", distance, "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB, on components in rows: q(vec_id, i, x) and c<round>(cluster, i, y)."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "q AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(q) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT cluster, i, x AS y FROM q JOIN (SELECT r, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS cluster FROM v) USING (r) WHERE cluster < {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, arg_min(cluster, d * {clusters} + cluster) AS cluster, min(d) AS distance
  FROM (SELECT r, cluster, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM q JOIN c{n} USING (i) GROUP BY ALL) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM q JOIN a{n} USING (r) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT cluster, i, CASE WHEN m IS NULL THEN y ELSE (s - ((s % m) + m) % m) // m END AS y FROM c{n} LEFT JOIN s{n} USING (cluster, i))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN (SELECT cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)"""
