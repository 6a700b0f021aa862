"""Passages that repeat across documents, by sparse suffix arrays.

1. Of all suffixes (in words) those are retained that start at minimisers: positions whose
   k-word hash is the least in some window of SPAN of them. A passage of LENGTH words holds a
   minimiser among its first SPAN positions, the same wherever the passage occurs, and from
   there at least PREFIX = LENGTH - SPAN + 1 words of it follow.
2. The retained suffixes are sorted by the fingerprint of their first PREFIX words and compared
   with their neighbours in that order; an equal neighbour is a match of PREFIX words.
3. Matches are extended to the left and to the right: the suffixes that matched are sorted
   once more, by prefix and then by the words before it, backwards, and by prefix and then by
   the words after it, and the longest common run with the nearest suffix of another document
   before and after, whatever copies of the own document lie between, is the extension. SPAN - 1 words to either side suffice, as a longer match holds another minimiser
   there. Extended matches that overlap or touch unite; those of LENGTH words or more are told.

Sorting is by range partitions over (fingerprint, context, document, place), so the suffixes of a
very frequent passage are spread over partitions like any others; the runs at their borders are
compared in a second step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strictpast.llm.arrays import WHITE, blocks, pieces, range_hashes, windows
from strictpast.llm.workers import importable, typed
from strictpast.session import stage

#: Words of a passage, words of the hash that selects positions, positions of its windows.
LENGTH, KMER, SPAN = 50, 6, 13


def minimisers(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least hash of every window of ``span``; of equal ones the rightmost."""
    if len(hashes) < span:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(np.arange(len(view)) + span - 1 - np.argmin(view[:, ::-1], axis=1))


class Suffixes:
    """The retained suffixes of a block of texts: positions ``at``, prefix keys ``prefix``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, kmer: int, span: int):
        size = length - span + 1
        self.first, self.starts, self.ends = pieces(data, offsets, WHITE)
        self.words = range_hashes(data, self.starts, self.ends)
        count = np.diff(self.first)
        padded = np.concatenate([self.words, np.zeros(length, np.uint64)])
        kmers = windows(padded, kmer, seed=3)
        at, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for t in np.flatnonzero(count >= length):
            a = self.first[t]
            found = a + minimisers(kmers[a : a + count[t] - kmer + 1], span)
            found = found[found + size <= self.first[t + 1]]
            at.append(found)
            of.append(np.full(len(found), t))
        self.at, self.of = np.concatenate(at), np.concatenate(of)
        self.prefix = windows(padded, size, seed=4)[self.at].view(np.int64)

    def around(self, at: np.ndarray, of: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of the ``reach`` words before (backwards) and after each prefix; 0 beyond the text."""
        short = np.concatenate([(self.words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(1, np.uint32)])
        steps = np.arange(1, reach + 1)
        before = at[:, None] - steps
        before[before < self.first[of][:, None]] = -1
        after = at[:, None] + size - 1 + steps
        after[after >= self.first[of + 1][:, None]] = -1
        return short[before], short[after]


Scorer = Callable[[pa.RecordBatch], Callable[[np.ndarray, np.ndarray], np.ndarray]]
Finish = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array], tuple[list[pa.Array], np.ndarray]]


def runs(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where runs of consecutive rows begin that are equal in the columns ``names``."""
    n = rows.num_rows
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for name in names:
        column = rows.column(name)
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


def compared(
    rows: DataFrame, order: list[str], same: list[str], key: str, bulky: list[str], wanted: str, told: list[T.StructField],
    scorer: Scorer, finish: Finish, label: str,
) -> DataFrame:
    """The ``wanted`` rows with what ``finish`` adds to each from its neighbours in ``order``.

    Neighbours are the nearest row before and the nearest after that differ in a column of
    ``same``, whatever lies between: the rows next to the run of equal ones. ``scorer`` gets rows
    with the columns ``order`` and gives a function of two arrays of places in them: the scores
    of these pairs, negative if they do not match. ``finish`` gets rows, their scores before and
    after and the key of the row before if it matches, and gives the added columns and a mask of
    the rows to keep. Rows in which the column ``wanted`` is null are neighbours only. Those in
    ``bulky`` are null in the result.

    Rows of the first and last run of a partition may have neighbours in other partitions: they
    are told once more beside these. To find them four rows of a partition are gathered, its ends
    and the rows next to its first and last run.
    """
    given, before_open, after_open, first_row, inner_row, last_row = rows.columns, 1, 2, 4, 5, 6
    key_type = rows.schema[key].dataType
    half = [T.StructField("_before", T.LongType()), T.StructField("_after", T.LongType()), T.StructField("_previous", key_type, True)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.schema.fields), *told, *half,
                           *T.StructType.fromDDL("_state int, _part int").fields])
    ends = [T.StructField(p + n, rows.schema[n].dataType, True) for p in ("_b_", "_a_") for n in order]

    def nulls(fields: list[T.StructField], n: int) -> list[pa.Array]:
        return [pa.nulls(n, f) for f in to_arrow_schema(T.StructType(fields)).types]

    def finished(part: pa.RecordBatch, before: np.ndarray, after: np.ndarray, previous: pa.Array) -> pa.RecordBatch:
        added, keep = finish(part, before, after, previous)
        n = part.num_rows
        columns = [pa.nulls(n, c.type) if name in bulky else c for name, c in zip(given, part.columns)]
        state = [pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *added, *nulls(half, n), *state], names=schema.names).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def end(row: pa.RecordBatch, state: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*row.columns, *nulls([*told, *half], 1), pa.array([state], pa.int32()), pa.array([number], pa.int32())], names=schema.names)

        def tell(part: pa.RecordBatch, starts: np.ndarray, skip: int, stop: int, begun: bool, over: bool) -> Iterator[pa.RecordBatch]:
            at = skip + np.flatnonzero(part.column(wanted).slice(skip, stop - skip).is_valid().to_numpy(zero_copy_only=False))
            mine = np.searchsorted(starts, at, "right") - 1
            others = (starts[mine] - 1, np.append(starts[1:], -1)[mine])
            score = scorer(part.select(order))
            scores = []
            for other in others:
                known = np.flatnonzero(other >= 0)
                scores.append(np.full(len(at), -1))
                scores[-1][known] = score(at[known], other[known])
            previous = part.column(key).take(pa.array(others[0], mask=scores[0] < 0))
            state = np.where((mine == 0) & (not begun), before_open, 0) | np.where((mine == len(starts) - 1) & over, after_open, 0)
            done = pa.array(state == 0)
            own = part.take(pa.array(at))
            yield finished(own.filter(done), *(x[state == 0] for x in scores), previous.filter(done))
            if state.any():
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *nulls(told, len(at)), pa.array(scores[0]), pa.array(scores[1]), previous,
                     pa.array(state.astype(np.int32)), pa.array(np.full(len(at), number, np.int32))],
                    names=schema.names).filter(pa.array(state > 0))

        # Held are the row before the last run, if any, and that run.
        held: list[pa.RecordBatch] = []
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not held:
                yield end(batch.slice(0, 1), first_row)
            elif len(runs(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch]), same)) == 1:
                held.append(batch)
                continue
            part = pa.concat_batches([*held, batch])
            starts = runs(part, same)
            if len(starts) > 1 + begun:
                if not begun:
                    yield end(part.slice(starts[1], 1), inner_row)
                yield from tell(part, starts, int(begun), int(starts[-1]), begun, False)
                begun, part = True, part.slice(starts[-1] - 1)
            held = [part]
        if held:
            part = pa.concat_batches(held)
            starts = runs(part, same)
            if begun:
                yield end(part.slice(0, 1), inner_row)
            yield from tell(part, starts, int(begun), part.num_rows, begun, True)
            yield end(part.slice(part.num_rows - 1), last_row)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = [b for b in batches if b.num_rows]
        if gathered:
            part = pa.concat_batches(gathered)
            starts, state, number = runs(part, same), part.column("_state").to_numpy(), part.column("_part").to_numpy()
            mine = np.searchsorted(starts, np.arange(part.num_rows), "right") - 1
            columns = []
            for kind, other in ((first_row, starts[mine] - 1), (last_row, np.append(starts[1:], -1)[mine])):
                at = np.flatnonzero(state == kind)
                at = at[np.argsort(number[at])]
                near = pa.array(other[at], mask=other[at] < 0)
                columns += [part.column(n).take(near) for n in order]
            yield pa.RecordBatch.from_arrays([part.column("_part").take(pa.array(at)), *columns], names=["_part", *(f.name for f in ends)])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, state = batch.select(given), batch.column("_state").to_numpy()
            scores, previous = [], batch.column("_previous")
            for prefix, bit, name in (("_b_", before_open, "_before"), ("_a_", after_open, "_after")):
                there = batch.column(prefix + key).is_valid().to_numpy(zero_copy_only=False)
                at = np.flatnonzero((state & bit > 0) & there)
                near = batch.select([prefix + n for n in order]).take(pa.array(at))
                both = [pa.concat_arrays([part.column(n).take(pa.array(at)), c]) for n, c in zip(order, near.columns)]
                values = np.array(batch.column(name).to_numpy())
                values[at] = scorer(pa.RecordBatch.from_arrays(both, names=order))(np.arange(len(at)), np.arange(len(at)) + len(at))
                scores.append(values)
                if bit == before_open:
                    met = np.zeros(len(values), bool)
                    met[at] = values[at] >= 0
                    previous = pc.if_else(pa.array(met), batch.column(prefix + key), previous)
            yield finished(part, *scores, previous)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    first = stage(dealt.mapInArrow(run, schema), label)
    edges = first.where(F.col("_state") >= first_row).select(*order, "_part", "_state")
    links = edges.repartition(1).sortWithinPartitions(*order, "_part", "_state").mapInArrow(link, T.StructType([schema["_part"], *ends]))
    border = first.where(F.col("_state").between(1, 3)).join(links, "_part").mapInArrow(again, schema)
    return first.where(F.col("_state") == 0).unionByName(border).drop("_before", "_after", "_previous", "_state", "_part", *bulky)


def suffix_rows(docs: DataFrame, key: str, text: str, length: int, kmer: int, span: int) -> DataFrame:
    """``(prefix, key)`` of the retained suffixes, each once in a row of ``docs``."""
    schema = T.StructType([T.StructField("prefix", T.LongType()), typed(docs, key)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                found = Suffixes(data, offsets, length, kmer, span)
                rows = np.stack([found.prefix, found.of])
                rows = rows[:, np.lexsort(rows)]
                rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))[: rows.shape[1]]]
                ids = batch.column(0).slice(row, len(offsets) - 1).take(pa.array(rows[1]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), ids], names=schema.names)

    return docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(run, schema)


def matched(suffixes: DataFrame, key: str) -> DataFrame:
    """``(prefix, key, earlier)``: prefixes that another document has too.

    ``earlier`` is the key of the row before in order of prefix and document, if it matches.
    """

    def scorer(cells: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        prefix = cells.column(0).to_numpy()
        return lambda a, b: np.where(prefix[a] == prefix[b], 0, -1)

    def finish(rows: pa.RecordBatch, before: np.ndarray, after: np.ndarray, previous: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        return [previous], (before >= 0) | (after >= 0)

    told = [typed(suffixes, key, "earlier")]
    return compared(suffixes.select("prefix", key), ["prefix", key], ["prefix", key], key, [], "prefix", told, scorer, finish, "suffix-order")


def extended(sides: DataFrame, key: str) -> DataFrame:
    """``(side, key, earlier, chain, w, more, byte)`` of the rows of ``sides`` that have a ``chain``.

    ``more`` counts the words of ``context`` that some row of another document with this prefix
    and side has as well, ``byte`` is the entry of ``reach`` at it.
    """

    def scorer(cells: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        n = cells.num_rows
        prefix, side = (cells.column(i).to_numpy() for i in (0, 1))
        context = np.frombuffer(b"".join(cells.column(2).to_pylist()), np.uint32).reshape(n, -1) if n else np.empty((0, 1), np.uint32)

        def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            equal = (context[a] == context[b]) & (context[a] != 0)
            return np.where((prefix[a] == prefix[b]) & (side[a] == side[b]), np.cumprod(equal, axis=1).sum(axis=1), -1)

        return score

    def finish(rows: pa.RecordBatch, before: np.ndarray, after: np.ndarray, previous: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        n, best = rows.num_rows, np.maximum(np.maximum(before, after), 0)
        reach = rows.column("reach").flatten().to_numpy().reshape(n, -1) if n else np.empty((0, 1), np.int32)
        return [pa.array(best), pa.array(reach[np.arange(n), best].astype(np.int64))], np.ones(n, bool)

    order, same = ["prefix", "side", "context", key, "w"], ["prefix", "side", key]
    told = [T.StructField("more", T.LongType()), T.StructField("byte", T.LongType())]
    return compared(sides, order, same, key, ["prefix", "context", "reach"], "chain", told, scorer, finish, "suffix-sides")


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, kmer: int = KMER, span: int = SPAN
) -> DataFrame:
    """``(key, first_word, n_words, first_byte, end_byte, earlier)`` of all repeated spans.

    Every passage of ``length`` words or more that another document holds too is part of a
    span, and every word of a span lies in a run of at least ``length - span + 1`` words that
    another document holds. Words are separated by ASCII white space and compared byte by byte;
    ``end_byte`` is exclusive. ``earlier`` is a smaller key whose document holds part of the
    span, null if it occurs here first: deleting the spans with ``earlier`` keeps every passage
    in the document of the smallest key. Repeats inside one document are no matches: a passage
    that only one document holds, however often, is not reported, and the document of the
    smallest key keeps all of its own copies. Null, empty and shorter texts have no spans; rows without a key take no part;
    rows that repeat a key are one document, searched row by row; other columns are not read;
    an empty table gives an empty result.
    """
    size, reach = length - span + 1, span - 1
    if not kmer <= size:
        raise ValueError("the hashed words must lie within the common prefix")
    importable(docs.sparkSession)
    hits = matched(suffix_rows(docs, key, text, length, kmer, span), key)
    hits = hits.groupBy(key).agg(F.collect_list("prefix").alias("prefixes"), F.collect_list(F.coalesce("earlier", key)).alias("earlier"))
    hits = hits.withColumnRenamed(key, "_key")
    bodies = docs.select(key, text).join(hits, F.col(key) == F.col("_key")).select(key, text, "prefixes", "earlier")
    schema = T.StructType([
        T.StructField("prefix", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("context", T.BinaryType()),
        typed(docs, key), typed(docs, key, "earlier"), *T.StructType.fromDDL("chain int, w int, reach array<int>").fields])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                block = Suffixes(data, offsets, length, kmer, span)
                bounds = np.searchsorted(block.of, np.arange(len(offsets)))
                keep, earlier = [np.empty(0, np.int64)], []
                for t in range(len(offsets) - 1):
                    known = batch.column(2)[row + t].values.to_numpy()
                    order = np.argsort(known, kind="stable")
                    own = block.prefix[bounds[t] : bounds[t + 1]]
                    place = np.minimum(np.searchsorted(known[order], own), len(known) - 1)
                    there = np.flatnonzero(known[order][place] == own)
                    keep.append(bounds[t] + there)
                    earlier.append(batch.column(3)[row + t].values.take(pa.array(order[place[there]])))
                keep = np.concatenate(keep)
                at, of = block.at[keep], block.of[keep]
                ids = batch.column(0).slice(row, len(offsets) - 1).take(pa.array(of))
                before = pa.concat_arrays(earlier) if earlier else ids
                before = pc.if_else(pc.equal(before, ids), pa.scalar(None, ids.type), before)
                # Suffixes whose prefixes overlap or touch are a chain; only those that can reach
                # beyond its ends are told, the others are neighbours for other documents.
                fresh = np.append(True, (np.diff(at) > size) | (np.diff(of) != 0))[: len(at)]
                number = np.cumsum(fresh) - 1
                head = at[fresh][number]
                tail = at[np.append(fresh[1:], True)[: len(at)]][number]
                # Byte offsets of the words to which an extension may reach.
                steps = np.arange(reach + 1)
                lefts = block.starts[np.maximum(at[:, None] - steps, block.first[of][:, None])] - offsets[of][:, None]
                rights = block.ends[np.minimum(at[:, None] + size - 1 + steps, block.first[of + 1][:, None] - 1)] - offsets[of][:, None]
                told = (at - head <= reach, tail - at <= reach)
                for side, (context, bytes_) in enumerate(zip(block.around(at, of, size, reach), (lefts, rights))):
                    sizes = np.where(told[side], reach + 1, 0)
                    bounds_ = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(~told[side], False))
                    shown = pa.ListArray.from_arrays(bounds_, pa.array(bytes_[told[side]].reshape(-1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.prefix[keep]), pa.array(np.full(len(at), side, np.int32)), pa.array([c.tobytes() for c in context], pa.binary()),
                         ids, before, pa.array((head - block.first[of]).astype(np.int32), mask=~told[side]), pa.array((at - block.first[of]).astype(np.int32)), shown],
                        names=schema.names)

    runs = extended(bodies.mapInArrow(sides, schema), key)
    left, right = F.col("side") == 0, F.col("side") == 1
    chains = runs.groupBy(key, "chain").agg(
        F.min(F.when(left, F.col("w") - F.col("more"))).alias("w0"), F.max(F.when(right, F.col("w") + size + F.col("more"))).alias("w1"),
        F.min(F.when(left, F.col("byte"))).alias("b0"), F.max(F.when(right, F.col("byte"))).alias("b1"), F.min("earlier").alias("earlier"))

    order = Window.partitionBy(key).orderBy("w0", "w1")
    reached = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = chains.withColumn("_new", F.coalesce(F.col("w0") > reached, F.lit(True)).cast("int"))
    marked = marked.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    united = marked.groupBy(key, "_span").agg(
        F.min("w0").cast("bigint").alias("first_word"), (F.max("w1") - F.min("w0")).cast("bigint").alias("n_words"),
        F.min("b0").alias("first_byte"), F.max("b1").alias("end_byte"), F.min("earlier").alias("earlier"))
    return united.where(F.col("n_words") >= length).drop("_span")
