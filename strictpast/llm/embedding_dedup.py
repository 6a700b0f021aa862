"""Near-duplicate vectors by randomised-rotation binary codes.

Unit vectors are turned by one random rotation; the signs of the coordinates are the code of a
vector, and the inner product of the code (as a unit vector) with the vector itself is stored
as its correction factor. The inner product of a code with another turned vector, divided by
the factor, estimates their cosine ``c`` without bias, with an error of at most ``DEVIATIONS *
sqrt((1 - f * f) / f / f / (d - 1)) * sqrt(1 - c * c)`` but for a chance of about 1e-6. A pair
whose estimate no cosine at the threshold or above allows is dropped; all others are computed exactly.

Vectors go to the cell of their nearest pivot (a bounded sample), cells are split into blocks of
some BLOCK vectors, so a crowded cell is many blocks, and a block of vectors meets the codes
of those blocks whose cells can hold a vector within reach: by the triangle inequality of angles, cells
further apart than their radii and the threshold's angle cannot. All pairs within reach are
estimated inside tasks as matrix products; only pairs that need exact computation become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.graph import components
from strictpast.llm.workers import importable, typed
from strictpast.session import stage

#: Vectors of a block, pivots, standard deviations of the confidence bound.
BLOCK, PIVOTS, DEVIATIONS = 4096, 64, 5.0
SEED = 20


def rotation(d: int) -> np.ndarray:
    """The random rotation of ``d`` dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: str):
    """Vectors that can link: not null, not zero, all components present and finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    """Directions in double precision; scaled by the largest component first."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``(node, d, cell, angle, turned, code, factor)`` of ``(node, v)``."""
    schema = T.StructType([typed(vectors, "node"), *T.StructType.fromDDL("d int, cell int, angle double, turned binary, code binary, factor double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in rows], np.int64)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = unit([rows[i] for i in at])
                near = np.clip(x @ pivots[d].T, -1, 1)
                cell = near.argmax(axis=1)
                turn = turns.setdefault(d, rotation(d))
                turned = x @ turn.T
                factor = np.abs(turned).sum(axis=1) / np.sqrt(d)
                code = np.packbits(turned > 0, axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32)),
                    pa.array(np.arccos(near[np.arange(len(at)), cell])), pa.array([t.tobytes() for t in turned.astype(np.float32)], pa.binary()),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor)], names=schema.names)

    return vectors.select("node", "v").mapInArrow(run, schema)


def block_lists(cells: list, pivots: dict[int, np.ndarray], reach: float) -> list[tuple]:
    """``(d, cell, blocks, partners)``: block counts of the cells and the cells they can reach."""
    out = []
    for d, cell, n, radius in cells:
        near = []
        for e, other, _, far in cells:
            if d == e:
                apart = np.arccos(np.clip(pivots[d][cell] @ pivots[d][other], -1, 1)) if cell != other else 0.0
                if apart - radius - far <= reach + 1e-6:
                    near.append(other)
        out.append((d, cell, n // BLOCK + 1, near))
    return out


def estimated(coded: DataFrame, lists: list[tuple], threshold: float) -> DataFrame:
    """``(a, b)`` with ``a < b`` whose upper confidence bound reaches ``threshold``."""
    spark = coded.sparkSession
    counts = {(d, c): n for d, c, n, _ in lists}
    first, total = {}, 0
    for d, c, n, _ in lists:
        first[d, c], total = total, total + n
    # At most PIVOTS cells of a dimension, each with its block numbers and partner blocks.
    ranges = [(d, c, first[d, c], n, [[first[d, o], first[d, o] + counts[d, o] - 1] for o in near]) for d, c, n, near in lists]
    cells = spark.createDataFrame(ranges, "d int, cell int, base int, n int, near array<array<int>>")
    placed = coded.join(F.broadcast(cells), ["d", "cell"])
    block = (F.col("base") + F.pmod(F.xxhash64("node"), F.col("n"))).cast("int")
    partners = F.flatten(F.transform("near", lambda r: F.sequence(r[0], r[1])))
    placed = placed.withColumn("own", block).withColumn("other", F.explode(F.filter(partners, lambda o: o >= F.col("own"))))
    # A block is the query of pairs with blocks not before it, and lends its codes to the others.
    queries = placed.select("own", "other", "node", "d", "turned")
    lent = coded.join(F.broadcast(cells), ["d", "cell"]).withColumn("other", block)
    lent = lent.withColumn("own", F.explode(F.filter(partners, lambda o: o <= F.col("other"))))
    codes = lent.select(*(F.col(c).alias(c) for c in ("own", "other", "node", "code", "factor")))

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        a, b = [one["node"].slice(0, 0)], [two["node"].slice(0, 0)]
        if one.num_rows and two.num_rows:
            d = one["d"][0].as_py()
            turned = np.frombuffer(b"".join(one["turned"].to_pylist()), np.float32).reshape(-1, d)
            bits = np.frombuffer(b"".join(two["code"].to_pylist()), np.uint8).reshape(two.num_rows, -1)
            signs = (np.unpackbits(bits, axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
            factor = two["factor"].to_numpy()
            # Only the part of a vector that is orthogonal to the other one errs; at a cosine of
            # the threshold or more it is at most sqrt(1 - threshold ** 2) long.
            error = np.sqrt(np.maximum(0, 1 - factor**2) / max(1, d - 1)) / factor
            slack = DEVIATIONS * error * np.sqrt(1 - threshold**2)
            least = ((threshold - slack) * factor - 1e-5).astype(np.float32)
            ids = [x["node"].combine_chunks() for x in (one, two)]
            ids = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in ids]
            order = [x.to_numpy(zero_copy_only=False) for x in ids]
            for start in range(0, len(turned), 256):
                i, j = np.nonzero(turned[start : start + 256] @ signs.T >= least)
                i += start
                if one["own"][0].as_py() == one["other"][0].as_py():
                    once = order[0][i] < order[1][j]
                    i, j = i[once], j[once]
                a.append(pa.chunked_array([ids[0].take(pa.array(i))]))
                b.append(pa.chunked_array([ids[1].take(pa.array(j))]))
        return pa.table({"a": pa.chunked_array([c for x in a for c in x.chunks], a[0].type), "b": pa.chunked_array([c for x in b for c in x.chunks], b[0].type)})

    schema = T.StructType([typed(coded, "node", "a"), typed(coded, "node", "b")])
    return queries.groupBy("own", "other").cogroup(codes.groupBy("own", "other")).applyInArrow(meet, schema)


def exact(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.empty(0, np.int64)]
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes = np.array([len(v) for v in one], np.int64)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                cosine = np.einsum("ij,ij->i", unit([one[i] for i in at]), unit([two[i] for i in at]))
                good.append(at[cosine >= threshold])
            yield pa.RecordBatch.from_arrays([c.take(pa.array(np.concatenate(good))) for c in batch.columns[:2]], names=["a", "b"])

    met = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("one")), "a")
    met = met.join(vectors.select(F.col("node").alias("b"), F.col("v").alias("two")), "b")
    return met.select("a", "b", "one", "two").mapInArrow(run, T.StructType([typed(pairs, "a"), typed(pairs, "b")]))


def near_vectors(table: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Rows link when the cosine of their vectors reaches ``threshold``; vectors that are null, zero
    or hold null or non-finite components link with nothing, nor do vectors of different length
    or rows without a key. Equal vectors fold into one before any comparison and count one link
    for each other row. ``component_id`` is the least key reachable; ``kept`` marks it. Rows that
    repeat a key count as rows, each with the links of its own vector. Other columns are not read; an empty table gives an empty result.
    """
    importable(table.sparkSession)
    marks = [F.xxhash64(F.lit(seed), vector).alias(f"_f{seed}") for seed in (1, 2)]
    good = table.where(usable(vector) & F.col(key).isNotNull()).select(key, F.col(vector).alias("v"), *(m for m in marks))
    classes = good.groupBy("_f1", "_f2").agg(F.min(F.struct(key, "v")).alias("_least"), F.count("*").alias("weight"))
    # Classes get numbers of their own, fixed by writing them: a key may stand for several vectors.
    numbered = classes.select("_f1", "_f2", F.monotonically_increasing_id().alias("node"), F.col(f"_least.{key}").alias("least"), F.col("_least.v").alias("v"), "weight")
    classes = stage(numbered, "vector-classes")
    vectors = classes.select("node", "v")
    sample = vectors.select(F.size("v").alias("d"), "v").withColumn("_h", F.xxhash64("v"))
    dims = [r[0] for r in sample.groupBy("d").count().select("d").collect()]
    pivots = {d: unit([r[0] for r in sample.where(F.col("d") == d).orderBy("_h").limit(PIVOTS).select("v").collect()]) for d in dims}
    coded = stage(encode(vectors, pivots), "vector-codes")
    cells = coded.groupBy("d", "cell").agg(F.count("*"), F.max("angle")).orderBy("d", "cell").collect()
    lists = block_lists([tuple(r) for r in cells], pivots, float(np.arccos(threshold)))
    maybe = stage(estimated(coded, lists, threshold), "vector-candidates")
    links = stage(exact(maybe, vectors, threshold).distinct(), "vector-links")

    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    weights = classes.select(F.col("node").alias("other"), F.col("weight").alias("w"))
    degree = both.join(weights, "other").groupBy("node").agg(F.sum("w").alias("far"))
    told = classes.select("_f1", "_f2", "node", "least", "weight").join(degree, "node", "left").join(components(links), "node", "left")
    told = told.withColumn("component", F.coalesce("component", "node"))
    roots = told.groupBy("component").agg(F.min("least").alias("c"))
    told = told.join(roots, "component").select("_f1", "_f2", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n"), "c")
    told = stage(told, "vector-answers")
    valid = usable(vector) & F.col(key).isNotNull()
    rows = table.select(key, *(F.when(valid, m).alias(f"_f{i + 1}") for i, m in enumerate(F.xxhash64(F.lit(s), vector) for s in (1, 2))))
    out = rows.join(told, ["_f1", "_f2"], "left")
    out = out.select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", key).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
