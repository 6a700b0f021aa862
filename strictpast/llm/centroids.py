"""Centroids of integer vectors by Lloyd's rounds over a vantage-point tree.

The tree over the centroids is built anew each round and broadcast: a node has a vantage centroid,
and its others are halved by their distance from it; a few are kept in leaves. Every vector runs its
own best-first search: of the nodes it has yet to see it opens the one with the least lower bound,
until no bound is within its best distance (inclusive, as an equal distance with a smaller number
wins). All vectors of a batch search at once, each with its own row of bounds. Distances to centroids
are exact integers; square roots only bound, with a margin for their rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.whitening import finite, grid
from strictpast.llm.workers import importable, one_by_one, typed
from strictpast.session import stage

#: Centroids that a leaf holds, rows that search at once, relative margin of a bound.
LEAF, ROWS, MARGIN = 2, 8192, 1e-9
LONG = 2**63 - 1


@dataclass
class Node:
    """Centroids whose distances are taken here, and children with their distance ranges from the first."""

    members: list[int]
    children: list[tuple[int, float, float]]


def squared(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Exact squared distances of rows to one centroid, in longs where these must suffice."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    largest += max(map(abs, centre), default=0)
    if len(centre) * largest * largest < LONG:
        gap = x - np.array(centre, np.int64)
    else:
        gap = x.astype(object) - np.array(centre, object)
    return (gap * gap).sum(axis=1)


def build(centroids: list[list[int]]) -> list[Node]:
    """The vantage-point tree; node 0 is its root."""
    nodes: list[Node] = []

    def grow(members: list[int]) -> int:
        at = len(nodes)
        nodes.append(Node(members, []))
        if len(members) > LEAF:
            first, rest = members[0], members[1:]
            far = {m: float(sum((a - b) ** 2 for a, b in zip(centroids[first], centroids[m]))) ** 0.5 for m in rest}
            rest = sorted(rest, key=lambda m: (far[m], m))
            nodes[at].members = [first]
            for part in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
                nodes[at].children.append((grow(part), far[part[0]], far[part[-1]]))
        return at

    if centroids:
        grow(list(range(len(centroids))))
    return nodes


def nearest(x: np.ndarray, centroids: list[list[int]], nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (the smaller number of equals) and its squared distance."""
    m = len(x)
    best, who = np.full(m, np.inf), np.full(m, len(centroids), np.int32)
    exact = np.zeros(m, object if x.dtype == object else np.int64)
    wide = False
    bound = np.full((m, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    rows = np.arange(m)
    while len(rows):
        opened = bound[rows].argmin(axis=1)
        least = bound[rows, opened]
        with np.errstate(invalid="ignore"):
            inclusive = (least < np.inf) & (least <= np.sqrt(best[rows]) * (1 + MARGIN) + MARGIN)
        rows, opened = rows[inclusive], opened[inclusive]
        for at in np.unique(opened).tolist():
            mine, node = rows[opened == at], nodes[at]
            floor = bound[mine, at]
            bound[mine, at] = np.inf
            for place, c in enumerate(node.members):
                d = squared(x[mine], centroids[c])
                if d.dtype == object and not wide:
                    exact, wide = exact.astype(object), True
                closer = (who[mine] == len(centroids)) | (d < exact[mine]) | ((d == exact[mine]) & (c < who[mine]))
                took = mine[closer]
                exact[took], who[took] = d[closer], c
                best[took] = d[closer].astype(np.float64)
                if place == 0 and node.children:
                    far = np.sqrt(d.astype(np.float64))
                    for child, low, high in node.children:
                        gap = np.maximum(low - far, far - high) - MARGIN * (far + high)
                        bound[mine, child] = np.maximum(np.maximum(gap, floor), 0.0)
    return who, exact


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def first_centroids(vectors: DataFrame, k: int, label: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of ``label:key``; equal hashes go by vector."""
    named = F.sha2(F.concat(F.lit(f"{label}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    chosen = vectors.select("x", named.alias("h"), F.col("key").isNull().alias("nameless"))
    return [list(r.x) for r in chosen.orderBy("nameless", "h", "x").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], d: int) -> list[list[int]]:
    """One round: assign every vector, then put every centroid at the floor of its vectors' mean."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, build(centroids)))
    schema = T.StructType.fromDDL("cluster int, i int, n long, high long, low long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, nodes = shared.value
        count = np.zeros(len(centres), np.int64)
        high, low = np.zeros((2, len(centres), d), np.int64)
        for batch in one_by_one(batches, ROWS):
            x = rows_of(batch.column(0), d)
            who, _ = nearest(x, centres, nodes)
            for c in np.unique(who).tolist():
                mine = x[who == c]
                count[c] += len(mine)
                high[c] += (mine >> 32).sum(axis=0)
                low[c] += (mine & 0xFFFFFFFF).sum(axis=0)
        used = np.flatnonzero(count)
        c, i = np.repeat(used, d), np.tile(np.arange(d), len(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (c.astype(np.int32), i.astype(np.int32), count[c], high[c, i], low[c, i])], names=schema.names)

    parts = vectors.select("x").mapInArrow(run, schema).groupBy("cluster", "i")
    # At most one row for each component of each centroid.
    sums = parts.agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low"))).collect()
    out = [list(c) for c in centroids]
    for r in sums:
        out[r.cluster][r.i] = ((int(r.high) << 32) + int(r.low)) // r.n
    shared.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]], d: int) -> DataFrame:
    """``(key, cluster, distance)`` of every vector; the distance is null beyond a long."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, build(centroids)))
    schema = T.StructType([typed(vectors, "key"), *T.StructType.fromDDL("cluster int, distance long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, nodes = shared.value
        for batch in one_by_one(batches, ROWS):
            who, exact = nearest(rows_of(batch.column(1), d), centres, nodes)
            within = pa.array([e if e <= LONG else None for e in exact.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who), within], names=schema.names)

    return vectors.select("key", "x").mapInArrow(run, schema)


def fit_clusters(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", d: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, label: str = "3"
) -> tuple[DataFrame, list[list[int]]]:
    """``(key, cluster, distance)`` of every kept row, and the final centroids.

    Kept are vectors of exactly ``d`` components, none null or non-finite; a component ``x`` becomes
    ``floor(scale * x)``, cut at the ends of a long. The first centroids are the ``k`` kept vectors whose key
    has the smallest hash (null keys last, equal hashes by vector), fewer if there are fewer vectors. Each of
    ``rounds`` rounds assigns every vector to its nearest centroid by squared distance, the smaller number of
    equals, and then puts every centroid at the floor of its vectors' mean; empty ones stay. ``distance`` is
    exact, and null beyond a long.

    Repeated keys and rows are rows like others; other columns are not read, whatever their names; an empty
    table gives an empty result and no centroids. The driver and the broadcast hold ``k * d`` numbers.
    """
    importable(table.sparkSession)
    kept = table.where(finite(vector) & (F.size(vector) == d))
    vectors = stage(kept.select(F.col(key).alias("key"), grid(vector, scale).alias("x")), "grid-vectors")
    centroids = first_centroids(vectors, k, label)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, d)
    return assigned(vectors, centroids, d).withColumnRenamed("key", key), centroids


def with_inertia(clusters: DataFrame, centroids: list[list[int]], key: str = "vec_id") -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` (of the centroid's decimals, joined by commas).

    Inertia is the sum of distances, of the cluster and of all; null if it or a distance is beyond a long.
    """
    clusters = stage(clusters, "clusters")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    # One row for each centroid: the driver joins them to the digests.
    found = {r.cluster: r.s for r in clusters.groupBy("cluster").agg(whole.alias("s")).collect()}
    total = None if None in found.values() else sum(found.values())
    within = lambda v: int(v) if v is not None and v <= LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, within(s), within(total), digests[c]) for c, s in found.items()]
    sums = clusters.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = clusters.join(F.broadcast(sums), "cluster")
    return out.select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
