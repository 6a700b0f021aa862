"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item is far smaller than a document, so the Jaccard similarity of the two says little. Items
are therefore partitioned by the size of their shingle set, and for each partition documents
are read in windows of fitting size: twice the largest item of the partition, overlapping by
half, so that any passage as long as an item lies in one of them. There, a contained item is
at a similarity of at least 0.8 / 4.2, and a MinHash index of single rows misses it with
probability 0.81 ** HASHES, some 1e-12. Every candidate is verified: the share of the item's
shingles that the whole document holds is counted exactly. An item of fewer words than a shingle
has, if asked for, its whole word sequence as its only shingle, which is looked up among the
document's runs of that many words.

Items of one text are one class, indexed once; keys are joined to what was found. The distinct
texts are broadcast in blocks of bounded size; a larger benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.arrays import LOWER, WHITE, blocks, mix, odd_numbers, pieces, range_hashes, windows
from strictpast.llm.workers import importable, packed, unpacked

#: Words of a shingle, share of an item in a hundred, hash functions of the index.
WORDS, PERCENT, HASHES = 5, 80, 128
#: Bytes of item texts that are broadcast at once.
ITEM_BYTES = 8 << 20
LEAKS = "leaks"


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order and ``first``: text t has the shingles ``first[t]:first[t + 1]``."""
    first, starts, ends = pieces(data, offsets, WHITE)
    hashes = windows(np.concatenate([range_hashes(data, starts, ends, LOWER), np.zeros(words, np.uint64)]), words)
    sizes = np.maximum(np.diff(first) - words + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    return hashes[at], bounds


class Index:
    """MinHash index of a block of items."""

    def __init__(self, texts: list[str | None], words: int, hashes: int = HASHES, short: bool = False):
        self.words, self.odd = words, odd_numbers(hashes, 8)
        self.salts = odd_numbers(hashes, 9)
        self.sets: list[np.ndarray] = []
        brief: dict[int, list[tuple[int, int]]] = {}
        for row, data, offsets in blocks(pa.array(texts, pa.string())):
            found, first = shingles(data, offsets, words)
            self.sets += [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:])]
            counts = np.diff(pieces(data, offsets, WHITE)[0])
            for n in np.unique(counts[(counts > 0) & (counts < words)]).tolist() if short else []:
                found, first = shingles(data, offsets, n)
                items = np.flatnonzero(counts == n)
                brief.setdefault(n, []).extend(zip(found[first[items]].tolist(), (row + items).tolist()))
        #: Items of fewer words than a shingle by their number of words: sorted hashes, items.
        self.brief = {}
        for n, pairs in brief.items():
            pairs.sort()
            self.brief[n] = (np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64))
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        there = np.flatnonzero(self.sizes)
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]))
        classes = np.array([int(n).bit_length() - 1 for n in self.sizes])
        self.partitions = {}
        for c in np.unique(classes[there]).tolist():
            items = there[classes[there] == c]
            keys = np.concatenate([self._signature(self.sets[i]) for i in items])
            owner = np.repeat(items, len(self.odd))
            order = np.argsort(keys, kind="stable")
            self.partitions[c] = (keys[order], owner[order])
        for _, items in self.brief.values():
            self.sizes[items] = 1

    def _signature(self, members: np.ndarray) -> np.ndarray:
        return mix((members[:, None] * self.odd).min(axis=0) + self.salts)

    def known(self, found: np.ndarray) -> np.ndarray:
        """Which shingles belong to some item; only these can share a minimum with one."""
        if not len(self.vocabulary):
            return np.zeros(len(found), bool)
        place = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        return self.vocabulary[place] == found

    def candidates(self, own: np.ndarray, hits: np.ndarray) -> set[int]:
        """Items that share a minimum with some window of one document."""
        out: set[int] = set()
        for c, (keys, owner) in self.partitions.items():
            step = 2 << c  # the size below which all items of the partition stay
            # A shingle lies in the windows that start at its step and at the one before.
            steps = np.unique(np.concatenate([hits // step, np.maximum(hits // step - 1, 0)]))
            for s in steps.tolist():
                signature = self._signature(own[s * step : (s + 2) * step])
                a, b = np.searchsorted(keys, signature, "left"), np.searchsorted(keys, signature, "right")
                for i in np.flatnonzero(b > a):
                    out.update(owner[a[i] : b[i]].tolist())
        return out

    def search(self, data: np.ndarray, offsets: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
        """``(text, item, shared)`` of the contained items of a block of texts."""
        found, first = shingles(data, offsets, self.words)
        known = np.flatnonzero(self.known(found))
        cuts = np.searchsorted(known, first)
        for t in np.flatnonzero(np.diff(cuts)).tolist():
            hits = known[cuts[t] : cuts[t + 1]]
            held = np.unique(found[hits])
            for i in sorted(self.candidates(found[first[t] : first[t + 1]], hits - first[t])):
                shared = len(np.intersect1d(held, self.sets[i], assume_unique=True))
                if 100 * shared >= percent * self.sizes[i]:
                    yield t, i, shared
        for n, (keys, items) in self.brief.items():
            found, first = shingles(data, offsets, n)
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hits = np.flatnonzero(keys[place] == found)
            text = np.searchsorted(first, hits, "right") - 1
            for t, a in np.unique(np.stack([text, place[hits]]), axis=1).T.tolist():
                for i in items[a : np.searchsorted(keys, keys[a], "right")].tolist():
                    yield t, i, 1


def item_blocks(items: DataFrame, text: str, limit: int) -> Iterator[list]:
    """``(text class, text)`` of the distinct texts, in blocks that hold ``limit`` bytes at most on average."""
    slim = items.where(F.col(text).isNotNull()).select(text_class(text).alias("class"), F.col(text).alias("text")).distinct()
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = total // limit + 1
    for part in range(parts):
        rows = slim if parts == 1 else slim.where(F.pmod(F.xxhash64("class"), F.lit(parts)) == part)
        yield rows.collect()


def text_class(text: str) -> Column:
    """What stands for all items of one text."""
    return F.sha2(F.col(text).cast("binary"), 256)


def with_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
    words: int = WORDS, percent: int = PERCENT, limit: int = ITEM_BYTES, short: bool = False,
) -> DataFrame:
    """``docs`` with ``leaks``: the item texts that each text contains, in order of their classes.

    An entry has ``class`` (:func:`text_class`), ``n_item`` (distinct shingles of the item) and ``n_shared``
    (how many of them the text holds, at least ``percent`` in a hundred). Shingles are ``words``
    lower-cased (A-Z) words. Items of fewer words are in no text, or with ``short`` in each that
    holds their words in a row: these are their only shingle. Null texts contain nothing and are
    contained nowhere. A column ``leaks`` in ``docs`` is replaced; empty tables give empty results.
    No shuffle: one pass over ``docs`` for each block of item texts.
    """
    spark = docs.sparkSession
    importable(spark)
    entry = T.StructType.fromDDL("class string, n_item bigint, n_shared bigint")
    kept = docs.drop(LEAKS)
    out = kept.withColumn(LEAKS, F.array().cast(T.ArrayType(entry)))
    for rows in item_blocks(items, item_text, limit):
        if rows:
            index = spark.sparkContext.broadcast((Index([r[1] for r in rows], words, short=short), [r[0] for r in rows]))
            out = _one_pass(out, index, text, percent, out.schema)
    return out.withColumn(LEAKS, F.array_sort(LEAKS))


def _one_pass(docs: DataFrame, shared, text: str, percent: int, schema: T.StructType) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, classes = shared.value
        for batch in batches:
            leaks = batch.column(batch.num_columns - 1).to_pylist()
            for row, data, offsets in blocks(batch.column(at)):
                for t, i, n in index.search(data, offsets, percent):
                    leaks[row + t] = [*leaks[row + t], {"class": classes[i], "n_item": int(index.sizes[i]), "n_shared": n}]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, batch.column(batch.num_columns - 1).type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def contaminations(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", **options
) -> DataFrame:
    """``(key, item_key, n_item, n_shared)``, one row for every item that a document contains.

    Items of one text are told each, as are items of one key; ``options`` are those of :func:`with_leaks`.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = with_leaks(slim, items, item_text=item_text, **options).select("key", F.inline(LEAKS))
    named = items.select(text_class(item_text).alias("class"), F.col(item_key).alias("item"))
    return found.join(named, "class").select(F.col("key").alias(key), F.col("item").alias(item_key), "n_item", "n_shared")


def clean_documents(docs: DataFrame, items: DataFrame, short: bool = False) -> DataFrame:
    """Pipeline stage: the documents that contain no item; their columns go through, whatever their names."""
    clean = with_leaks(packed(docs, text="text"), items, short=short).where(F.size(LEAKS) == 0)
    return unpacked(clean, docs, text="text")
