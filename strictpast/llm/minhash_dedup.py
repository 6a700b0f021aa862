"""Near-duplicates by banded MinHash with sequential Bayesian verification.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its
   shingle set, the keys of its bands and a sketch of 16-bit minima.
2. Documents with equal sets fold into a class; one representative goes on.
3. In a band bucket every member meets a few centres, the least members under several hash
   orders, which are found by aggregation. The pairs are verified and contracted to components.
4. Only buckets whose members lie in more than one component stay open. In these, members outside
   the largest component meet the sketches of all members of others; pairs that the posterior
   does not prune tie their documents, of which a spanning forest is returned.
5. What is tied but left apart is compared in full. Tied documents form a family, and in it members outside the largest component meet all
   members of other components on full sets, inside tasks that get two chunks of the family. So
   every pair that shares a bucket is connected already, pruned or compared, and the pairs of a
   group of copies are never listed.

Verification reads the sketches batch by batch. After n hashes with m matches the similarity
has the posterior Beta(m + 1, n - m + 1) under a flat prior; a pair is pruned as soon as the
posterior gives the threshold a probability below the chosen miss probability, and such that all
batches together prune a pair at the threshold with at most that probability. Survivors are
compared exactly on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.arrays import LOWER, WHITE, blocks, mix, odd_numbers, pieces, range_hashes, windows
from strictpast.llm.graph import components, in_parts
from strictpast.llm.workers import fresh, importable, let_go, typed
from strictpast.session import stage

#: Bands, rows of a band, hashes of the sketch and of one batch of it.
BANDS, ROWS, SKETCH, BATCH = 32, 5, 96, 16
#: Probability at which verification may prune a pair that reaches the threshold.
MISS = 1e-6
#: Centres that every member of a bucket meets first.
CENTRES = 4
#: Documents and bytes of text of a chunk of a family, sketches of a task of small buckets.
CHUNK, CHUNK_BYTES, CELL = 512, 8 << 20, 8192
#: Parts into which the rows of a family or component are dealt when they are joined with its facts.
PARTS = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, not yet distinct: ``(hashes, first)``.

    A text of fewer words than a shingle has its whole sequence as the only one; a text
    without words has none.
    """
    first, starts, ends = pieces(data, offsets, WHITE)
    hashes = range_hashes(data, starts, ends, LOWER)
    count = np.diff(first)
    sizes = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    out = windows(padded, words)[at]
    for t in np.flatnonzero((count > 0) & (count < words)):
        whole = np.concatenate([hashes[first[t] : first[t + 1]], np.zeros(words - count[t], np.uint64)])
        out[sizes[:t].sum()] = windows(whole, words, seed=2)[0]
    return out, np.concatenate([[0], np.cumsum(sizes)])


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """Matches that each batch must have reached for the pair to live on.

    For whole numbers the Beta tail is a binomial one: with m matches of n,
    P(similarity >= t) = P(Binomial(n + 1, t) <= m). A pair at the threshold itself is pruned by a batch
    with P(Binomial(n, t) < bound), which is the larger number: each batch gets an equal part of
    ``miss``, so all of them together stay below it, and the posterior's bound holds as well.
    """
    steps = SKETCH // BATCH
    out = []
    for n in range(BATCH, SKETCH + 1, BATCH):
        tail, m = 0.0, 0
        while tail + comb(n, m) * threshold**m * (1 - threshold) ** (n - m) <= miss / steps:
            tail += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
            m += 1
        out.append(m)
    return out


def sign(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """``(key, n_shingles, f1, f2, bands, sketch)`` of every row."""
    importable(docs.sparkSession)
    schema = T.StructType([typed(docs, key), *T.StructType.fromDDL("n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        orders, salts = odd_numbers(BANDS * ROWS, 3), odd_numbers(BANDS, 4)
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                hashes, first = shingle_sets(data, offsets, words)
                sets = distinct_sets(hashes, first)
                n = np.array([len(s) for s in sets], np.int64)
                f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                f2 = np.array([mix(s ^ np.uint64(0x5555)).sum(dtype=np.uint64) for s in sets], np.uint64)
                full = np.flatnonzero(n)
                minima = np.zeros((len(n), BANDS * ROWS), np.uint64)
                if len(full):
                    for j, odd in enumerate(orders):
                        minima[full, j] = np.minimum.reduceat(hashes * odd, first[full])
                minima = mix(minima)
                keys = np.empty((len(n), BANDS), np.uint64)
                for band in range(BANDS):
                    group = minima[:, band * ROWS : (band + 1) * ROWS]
                    keys[:, band] = mix((group * odd_numbers(ROWS, 5)).sum(axis=1, dtype=np.uint64) + salts[band])
                sketch = (minima[:, :SKETCH] & np.uint64(0xFFFF)).astype(np.uint16)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(n)), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, pa.array([s.tobytes() for s in sketch], pa.binary())],
                    names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _sequential(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs that the posterior bounds do not prune."""
    bounds = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SKETCH) for i in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for step, bound in enumerate(bounds):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (one[alive, part] == two[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= bound]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], names=["a", "b"])

    met = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("one")), "a")
    met = met.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("two")), "b")
    return met.select("a", "b", "one", "two").mapInArrow(run, T.StructType([typed(pairs, "a"), typed(pairs, "b")]))


def _exact(pairs: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` on their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows lie by ``a``: its text is read where it changes, those of ``b`` side by side.
            names, good, held = batch.column(0).to_numpy(), [], None
            changes = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            ones = sets_of(batch.column(2).take(pa.array(changes)), words)
            new = set(changes.tolist())
            for i, other in enumerate(sets_of(batch.column(3), words)):
                held = next(ones) if i in new else held
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    met = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("two")), "b")
    met = met.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("one")), "a")
    return met.select("a", "b", "one", "two").mapInArrow(run, T.StructType([typed(pairs, "a"), typed(pairs, "b")]))


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of every text, a block of texts at once."""
    for _, data, offsets in blocks(column):
        yield from distinct_sets(*shingle_sets(data, offsets, words))


def near_duplicates(docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; documents are linked
    when their sets of ``words``-word shingles have a Jaccard similarity of at least ``percent``
    in a hundred. A text of fewer words counts as one shingle, null and blank texts have none and
    are linked with nothing. ``component_id`` is the least key reachable. Rows that repeat a key
    are the same document and linked; rows without a key take no part and are kept. Other columns
    are not read; an empty table gives an empty result.
    """
    signed = stage(sign(docs, words, key, text), "signatures")
    alike = ["n_shingles", "f1", "f2"]
    part = signed.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    classes = stage(part.groupBy(*alike).agg(F.min(key).alias("node")), "set-classes")
    members = stage(part.select(key, *alike).join(classes, alike).select(F.col(key).alias("_key"), "node").distinct(), "set-members")
    links = _links(docs, signed, classes, words, percent, key, text)
    # Rows of one key may lie in several classes: their classes are linked as well.
    shared = members.groupBy("_key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    several = members.join(shared.select("_key", "a"), "_key").select("a", F.col("node").alias("b"))
    found = components(links.unionByName(several))
    own = members.groupBy("_key").agg(F.min("node").alias("node"))
    placed = own.join(found, "node", "left").select("_key", F.coalesce("component", "node").alias("component"))
    rows = signed.select(key, "n_shingles")
    out = rows.join(placed, F.col(key) == F.col("_key"), "left").select(key, "n_shingles", F.coalesce("component", key).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _links(docs: DataFrame, signed: DataFrame, classes: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Verified links ``(a, b)`` between class representatives that connect all near-duplicates."""
    nodes = classes.select(F.col("node").alias("_node")).distinct()
    reps = signed.where("n_shingles > 0").join(nodes, F.col(key) == F.col("_node")).select(F.col("_node").alias("node"), "bands", "sketch")
    entries = reps.select("node", F.explode("bands").alias("bucket"))

    def order(i: int):
        return F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node"))["node"]

    # Most buckets hold one document: only those of others are written again with their centres.
    shared = stage(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    held = stage(entries.join(shared, "bucket"), "shared-entries")
    buckets = stage(held.groupBy("bucket").agg(F.array(*(order(i) for i in range(CENTRES))).alias("centres")), "buckets")
    crowded = stage(held.join(buckets, "bucket"), "bucket-members")
    involved = stage(crowded.select("node").distinct(), "bucket-nodes")
    sketches = stage(reps.select("node", "sketch").join(involved, "node"), "sketches")
    written = docs.where(F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    bodies = written.select(F.col(key).alias("node"), F.col(text).alias("body")).join(involved, "node")
    bodies = stage(bodies, "bodies")

    met = crowded.select("node", F.explode(F.array_distinct("centres")).alias("centre")).where("node != centre")
    first = met.select(F.greatest("node", "centre").alias("b"), F.least("node", "centre").alias("a")).distinct()
    first = stage(first.select("a", "b"), "centre-pairs")
    survivors = stage(_sequential(first, sketches, percent / 100), "survivors")
    links = stage(_exact(survivors, bodies, words, percent), "links")
    # Every document of a shared bucket with its verified component.
    state = involved.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    state = stage(state, "states")
    ties = stage(_tied(crowded, state, sketches, percent / 100).distinct(), "ties")
    # What is verified goes on as one link from each document to the least of its component.
    known = state.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return known.unionByName(_rest(ties, state, reps, bodies, words, percent))


def _tied(crowded: DataFrame, state: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Ties ``(a, b)`` between the components of outsiders and of members of buckets that are still open.

    An outsider is a member that is not in its bucket's largest component. Small buckets share a
    task, some CELL rows together; a large one is dealt to tasks by chunks of both sides. Rows
    carry a sketch, no text.
    """
    work = _forest(threshold)
    entries = crowded.select("bucket", "node").join(state, "node")
    parts = entries.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.max("n").alias("n_main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    whole = stage(whole.where("parts > 1"), "open-buckets")
    total = whole.agg(F.sum("n")).first()[0] or 0  # one number
    small = F.col("n") <= CHUNK
    cell = F.when(small, F.pmod(F.xxhash64("bucket"), F.lit(total // CELL + 1))).otherwise(F.col("bucket"))
    chunks = lambda n: F.when(small, 1).otherwise(F.ceil(n / CHUNK)).cast("int")
    whole = whole.select("bucket", "main", small.alias("small"), cell.alias("cell"), chunks(F.col("n") - F.col("n_main")).alias("outs"), chunks(F.col("n")).alias("ins"))
    rows = entries.join(whole, "bucket").join(sketches, "node")
    facts = ["bucket", "component", "node", "sketch"]

    def dealt(side: str, others: str):
        own = F.pmod(F.xxhash64("node"), F.col(side)).cast("int").alias(side[0])
        return "small", "cell", own, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others[0])

    keys = ["small", "cell", "o", "i"]
    outsiders = rows.where("component != main").select(*dealt("outs", "ins"), *facts)
    members = rows.select(*dealt("ins", "outs"), *facts)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        found = [[], []]
        if one.num_rows and two.num_rows:
            sides = []
            for t in (one, two):
                bucket = t["bucket"].to_numpy()
                order = np.argsort(bucket, kind="stable")
                sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(-1, SKETCH)
                sides.append((bucket[order], t["node"].to_numpy()[order], t["component"].to_numpy()[order], sketch[order]))
            (bucket, *a), (other, *b) = sides
            for first in np.unique(bucket, return_index=True)[1].tolist():
                mine = slice(first, int(np.searchsorted(bucket, bucket[first], "right")))
                theirs = slice(*(int(np.searchsorted(other, bucket[first], side)) for side in ("left", "right")))
                lies = dict(zip([*a[0][mine].tolist(), *b[0][theirs].tolist()], [*a[1][mine].tolist(), *b[1][theirs].tolist()]))
                for x, y in {(lies[x], lies[y]) for x, y in work(*(c[mine] for c in a), *(c[theirs] for c in b))}:
                    found[0].append(x)
                    found[1].append(y)
        kind = one.schema.field("node").type
        return pa.table({"a": pa.array(found[0], kind), "b": pa.array(found[1], kind)})

    schema = T.StructType([typed(state, "node", "a"), typed(state, "node", "b")])
    met = outsiders.groupBy(*keys).cogroup(members.select(*(F.col(c).alias(c) for c in (*keys, *facts))).groupBy(*keys))
    return met.applyInArrow(meet, schema)


def _forest(threshold: float):
    """A spanning forest of the pairs of different components that no batch prunes."""
    bounds = least_matches(threshold)

    def work(node, component, sketch, others, theirs, sketches):
        group = np.arange(len(others))
        place = {n: i for i, n in enumerate(others.tolist())}
        for i, own_node in enumerate(node.tolist()):
            near = np.flatnonzero(theirs != component[i])
            for step, least in enumerate(bounds):
                part = slice(0, (step + 1) * BATCH)
                near = near[(sketch[i, part] == sketches[near, part]).sum(axis=1) >= least]
            if len(near):
                at = place.get(own_node)
                own = -1 - i if at is None else group[at]
                roots, which = np.unique(group[near], return_index=True)
                for root, k in zip(roots.tolist(), near[which].tolist()):
                    if root != own:
                        yield min(node[i], others[k]), max(node[i], others[k])
                group[np.isin(group, np.append(roots, own))] = roots[0]

    return work


def _rest(ties: DataFrame, state: DataFrame, reps: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between tied documents of different components.

    A family holds the components that ties connect. In each, the members outside
    its largest component meet all members of other components, chunk by chunk: a task gets
    two chunks, prunes the pairs that share no band, then by sequential batches of the sketches,
    counts the intersections of the survivors, and returns for each outsider one link to each
    component that it reaches. Pairs never become rows.
    """
    families = components(ties).select(F.col("node").alias("component"), F.col("component").alias("family"))
    state = stage(in_parts(state, families, "component", "node", PARTS).select("node", "family", "component"), "family-members")
    sized = state.join(bodies.select("node", F.octet_length("body").alias("bytes")), "node")
    parts = sized.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = parts.groupBy("family").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.max("n").alias("n_main"), F.count("*").alias("parts"),
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))

    def chunks(n):
        return F.greatest(F.ceil(n / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")

    whole = whole.where("parts > 1").select("family", "main", chunks(F.col("n") - F.col("n_main")).alias("outs"), chunks(F.col("n")).alias("ins"))
    rows = in_parts(state, whole, "family", "node", PARTS).join(reps, "node").join(bodies, "node")
    rows = stage(rows.select("family", "component", "main", "outs", "ins", "node", "bands", "sketch", "body"), "family-rows")
    facts = ["component", "node", "bands", "sketch", "body"]

    def dealt(side: str, others: str):
        own = F.pmod(F.xxhash64("node"), F.col(side)).cast("int").alias(side[0])
        return "family", own, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others[0])

    outsiders = rows.where("component != main").select(*dealt("outs", "ins"), *facts)
    members = rows.select(*dealt("ins", "outs"), *facts)
    bounds = least_matches(percent / 100)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        a, b = (_Chunk(t, words) for t in (one, two))
        found = [[], []]
        if a.n and b.n:
            mark = np.zeros(len(b.vocabulary) + 1, np.int64)
            for i in range(a.n):
                near = np.flatnonzero((a.bands[i] == b.bands).any(axis=1) & (b.component != a.component[i]))
                for step, least in enumerate(bounds):
                    part = slice(0, (step + 1) * BATCH)
                    near = near[(a.sketch[i, part] == b.sketch[near, part]).sum(axis=1) >= least]
                if len(near):
                    own = np.searchsorted(b.vocabulary, a.sets[i])
                    own = own[b.vocabulary[np.minimum(own, len(b.vocabulary) - 1)] == a.sets[i]]
                    mark[own] = 1
                    both = np.add.reduceat(mark[b.places], b.starts)[near]
                    mark[own] = 0
                    near = near[100 * both >= percent * (len(a.sets[i]) + b.sizes[near] - both)]
                    near = near[np.unique(b.component[near], return_index=True)[1]]
                    found[0] += [a.node[i]] * len(near)
                    found[1] += b.node[near].tolist()
        kind = one.schema.field("node").type
        return pa.table({"a": pa.array(found[0], kind), "b": pa.array(found[1], kind)})

    keys = ["family", "o", "i"]
    schema = T.StructType([typed(state, "node", "a"), typed(state, "node", "b")])
    met = outsiders.groupBy(*keys).cogroup(members.select(*(F.col(c).alias(c) for c in (*keys, *facts))).groupBy(*keys))
    return met.applyInArrow(meet, schema)


class _Chunk:
    """A chunk of documents as arrays; ``places`` lists the shingles of all as vocabulary numbers."""

    def __init__(self, rows: pa.Table, words: int):
        self.n = rows.num_rows
        self.node, self.component = (rows[c].to_numpy() for c in ("node", "component"))
        self.bands = np.array(rows["bands"].to_pylist(), np.int64).reshape(self.n, BANDS)
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(self.n, SKETCH)
        self.sets = list(sets_of(rows["body"].combine_chunks(), words))
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.vocabulary, self.places = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]), return_inverse=True)


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the least key.

    Of rows that repeat a kept key one stays; rows without a key all stay. Other columns go through
    unchanged, whatever their names.
    """
    inner = fresh(docs, "key")
    found = stage(near_duplicates(docs, words, percent, key, text), "near-duplicates")
    gone = found.where("not kept").select(F.col(key).alias(inner)).distinct()
    several = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(inner)).agg(F.count("*").alias("n")).where("n > 1").select(inner)
    # Stored, so that their size is known: the texts are shuffled only where these keys are too many to broadcast, and then once.
    chosen = stage(several.join(gone, inner, "left_anti"), "repeated-keys")
    marked = stage(gone.unionByName(chosen), "marked-keys")
    same = F.col(key) == F.col(inner)
    return docs.join(marked, same, "left_anti").unionByName(docs.join(chosen, same, "left_semi").dropDuplicates([key]))
