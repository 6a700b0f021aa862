"""Removal of repeated runs of lines by winnowing.

A document is the sequence of its non-blank lines, each hashed without white space at its ends.
Winnowing selects, in every window of ``run`` lines, the line with the least hash (the rightmost
of equal ones): any run of that many lines is guaranteed to hold the same selected line wherever
it occurs. Each selected position is written once, with the lines around it and the windows that
selected it. Positions whose line occurs once are dropped by a count; the others are joined with
the first position, in order of document and line, that a window of equal lines selected. From
there the match is extended line by line both ways, and the later side of it is deleted.
Matches longer than the lines written around a position hold further selected positions, which
go on from there; overlapping deleted runs unite, so longer repeats go as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.arrays import WHITE, blocks, inside, mix, owners, pieces, range_hashes, windows
from strictpast.llm.workers import fresh, importable, let_go, one_by_one, packed, typed, unpacked
from strictpast.session import stage

#: Lines of the shortest run that is deleted, which is also the window of selection.
RUN = 2
#: Lines that are written before and after a selected position, as multiples of the run.
REACH = 1

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, first, words)`` of the stripped non-blank lines of each text."""
    first, starts, ends = pieces(data, offsets, NEWLINE)
    text = owners(first)
    _, word_starts, word_ends = pieces(data, offsets, WHITE)
    # A line reaches from the start of its first word to the end of its last one.
    a = np.searchsorted(word_starts, starts)
    b = np.searchsorted(word_starts, ends)
    full = b > a
    hashes = range_hashes(data, word_starts[a[full]], word_ends[b[full] - 1])
    return hashes, np.searchsorted(text[full], np.arange(len(offsets))), (b - a)[full]


def selected(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``run`` lines, the offset of its selected line."""
    view = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return run - 1 - np.argmin(view[:, ::-1], axis=1)


def around(hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, steps: np.ndarray) -> pa.ListArray:
    """Hashes of the lines ``steps`` away from each position, as far as they lie in ``low:high``."""
    place = at[:, None] + steps
    there = (place >= low[:, None]) & (place < high[:, None])
    offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[place[there]].view(np.int64)))


def fingerprints(docs: DataFrame, run: int, key: str, text: str, alone: int | None = None) -> DataFrame:
    """``(key, at, line, before, after, picks)``: one row for each selected position of a document.

    ``line`` is the hash of the line at ``at``; ``before`` and ``after`` are those of the lines next to it,
    nearest first, up to ``REACH * run`` and the document's ends. ``picks`` are the windows that
    selected it: ``start``, ``print`` (the hash of all their lines) and ``lone``. A line of ``alone`` words
    or more is a window by itself, which selects it and is marked ``lone``.
    """
    importable(docs.sparkSession)
    pick = "array<struct<start: int, print: bigint, lone: boolean>>"
    schema = T.StructType([typed(docs, key), *T.StructType.fromDDL(f"at int, line bigint, before array<bigint>, after array<bigint>, picks {pick}").fields])
    steps = np.arange(1, REACH * run + 1)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                hashes, first, words = line_hashes(data, offsets)
                start = inside(first, run)
                at, prints = start, np.empty(0, np.uint64)
                if len(start):
                    at = start + selected(mix(hashes ^ np.uint64(0xA5A5)), run)[start]
                    prints = windows(hashes, run)[start]
                single = np.flatnonzero(words >= alone) if alone is not None else np.empty(0, np.int64)
                lone = np.arange(len(start) + len(single)) >= len(start)
                start, at = np.append(start, single), np.append(at, single)
                prints = np.append(prints, windows(hashes, 1, 5)[single] if len(single) else prints[:0])
                order = np.argsort(at, kind="stable")
                places, begin = np.unique(at[order], return_index=True)
                of = owners(first)[places]
                low, high = first[of], first[of + 1]
                own = np.repeat(low, np.diff(np.append(begin, len(order))))
                picks = pa.StructArray.from_arrays(
                    [pa.array((start[order] - own).astype(np.int32)), pa.array(prints[order].view(np.int64)), pa.array(lone[order])],
                    names=["start", "print", "lone"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(offsets) - 1).take(pa.array(of)), pa.array((places - low).astype(np.int32)),
                     pa.array(hashes[places].view(np.int64)), around(hashes, places, low, high, -steps), around(hashes, places, low, high, steps),
                     pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)).astype(np.int32)), picks)],
                    names=schema.names)

    return docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(run_task, schema)


def equal_lines(a: str, b: str) -> Column:
    """How many entries two arrays share from their start on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def repeated_runs(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", alone: int | None = None) -> DataFrame:
    """``(key, runs)``: for each document with later repeats, their extended matches.

    A match is ``low`` and ``high``, its first and last line; positions count non-blank lines from 0.
    It has ``run`` lines or more, or is one line of ``alone`` words or more.
    """
    prints = stage(fingerprints(docs, run, key, text, alone), "line-fingerprints")
    # Lines that are selected at two places or more. Hot lines are counted before the shuffle.
    seeds = prints.groupBy("line").agg(F.min(F.struct(key, "at")).alias("a"), F.max(F.struct(key, "at")).alias("b"))
    seeds = stage(seeds.where("a != b").select("line"), "line-seeds")
    met = prints.join(seeds, "line").select(key, "at", "line", "before", "after", F.inline("picks"))
    met = stage(met, "line-positions")
    # The first position of each window of equal lines; equal windows are folded before the shuffle.
    place = F.struct(F.col(key).alias("key"), "start")
    head = F.struct(place.alias("place"), F.col("before").alias("b"), F.col("after").alias("a"))
    heads = met.groupBy("line", "print").agg(F.min(head).alias("head"), F.count("*").alias("n"))
    heads = stage(heads.where("n > 1").select("line", "print", "head.*"), "line-heads")
    later = met.join(heads, ["line", "print"]).where(place > F.col("place"))
    left, right = equal_lines("before", "b"), equal_lines("after", "a")
    matches = later.select(key, "at", left.alias("left"), right.alias("right"))
    whole = F.col("left") + F.col("right") + 1 >= run
    low, high = (F.when(whole, c).otherwise(F.col("at")) for c in (F.col("at") - F.col("left"), F.col("at") + F.col("right")))
    return matches.groupBy(key).agg(F.collect_set(F.struct(low.alias("low"), high.alias("high"))).alias("runs"))


def without_lines(text: str, runs: list[dict]) -> tuple[str, int]:
    """A text without the non-blank lines in ``runs``, and how many went."""
    gone = {i for r in runs for i in range(r["low"], r["high"] + 1)}
    kept, place, white = [], 0, " \t\n\r\x0b\x0c"
    for line in text.split("\n"):
        if line.strip(white):
            if place not in gone:
                kept.append(line)
            place += 1
        else:
            kept.append(line)
    return "\n".join(kept), len(gone)


def drop_repeated_lines(
    docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", alone: int | None = None
) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``n_lines`` and ``n_removed`` added.

    Both count non-blank lines, which alone are compared and deleted. A run goes where an
    equal run of ``run`` lines stands earlier, in order of ``key`` and line, in any document.
    With ``alone``, a single line of that many words goes too where an equal line stands
    earlier, whatever its neighbours; without it, single lines stay.
    Rows that repeat a key are one document whose repeats count from each row's own start, and
    are treated alike. Null texts stay null with zero lines; rows without a key take no part. Columns
    named like the added ones are replaced; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    names = {n: fresh(docs, n) for n in ("key", "runs")}
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = repeated_runs(slim, run, "key", "text", alone).toDF(names["key"], names["runs"])
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_lines bigint, n_removed bigint").fields])
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches, 1000):
            column = batch.column(at)
            lines = [np.diff(line_hashes(data, offsets)[1]) for _, data, offsets in blocks(column)]
            values, removed = column.to_pylist(), []
            for i, runs in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if runs and values[i] is not None:
                    values[i], n = without_lines(values[i], runs)
                    removed.append(n)
                else:
                    removed.append(0)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(values, pa.string())
            counts = np.concatenate(lines) if lines else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(removed, pa.int64())], names=schema.names)

    met = docs.join(found, F.col(key) == F.col(names["key"]), "left").select(*docs.columns, names["runs"])
    return met.mapInArrow(clean, schema)


def deduplicated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", alone: int | None = None) -> DataFrame:
    """Pipeline stage: texts without repeated runs; documents that lose every line go.

    ``n_chars``, where there is one, follows the text; ``alone`` is as above. All other columns go
    through unchanged, whatever their names.
    """
    done = drop_repeated_lines(packed(docs, key=key, text=text), RUN, "key", "text", alone)
    done = done.where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" not in docs.columns:
        return unpacked(done, docs, key=key, text=text)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    chars = F.when(F.col("n_removed") > 0, length).otherwise(F.col("rest").getField("n_chars"))
    return unpacked(done.withColumn("rest", F.col("rest").withField("n_chars", chars)), docs, key=key, text=text)
