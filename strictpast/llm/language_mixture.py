"""Language identification by mixtures of n-gram models.

Each language has a multinomial over hashed byte trigrams of the lower-cased text, learned
from labelled rows by one distributed count. A document is a mixture: expectation-maximisation
finds the proportions of languages that explain its n-grams best, languages that do not pay
for their parameter (Bayesian information criterion) are removed one by one, and the largest
proportion of what is left is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.workers import importable, let_go, one_by_one, packed, unpacked

BUCKETS = 1 << 14
ORDER = 3
#: Languages whose dense counts a task holds at once, and with which a text's mixture starts.
LANGUAGES = 200
#: Count that every bucket has in every language before any text.
SMOOTH = 0.1
UNDETERMINED = "und"


def lowered_bytes(column: pa.Array) -> list[np.ndarray]:
    """UTF-8 bytes of each text in lower case, padded with a space on either side."""
    low = pc.utf8_lower(pc.fill_null(column, "")).to_pylist()
    return [np.frombuffer(b" " + t.encode() + b" ", np.uint8) for t in low]


def grams(text: np.ndarray) -> np.ndarray:
    """Buckets of a text's byte n-grams."""
    n = len(text) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code = code * np.uint64(257) + text[i : i + n]
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Counts of n-grams by language, those that are not zero, in order of buckets.

    ``counts[first[b]:first[b + 1]]`` belong to bucket ``b`` and to the languages ``which`` of the same
    places; ``totals`` are the counts of each language over all buckets, smoothing included.
    """

    languages: tuple[str, ...]
    first: np.ndarray
    which: np.ndarray
    counts: np.ndarray
    totals: np.ndarray

    def likelihoods(self, buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(kept, table)``: the languages a text's mixture starts with, and their probabilities of its buckets.

        These are the LANGUAGES that explain the text best by themselves (all, if there are no more), by name.
        """
        lengths = self.first[buckets + 1] - self.first[buckets]
        row = np.repeat(np.arange(len(buckets)), lengths)
        at = np.repeat(self.first[buckets] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(row))
        which, held = self.which[at], self.counts[at]
        kept = np.arange(len(self.languages))
        if len(kept) > LANGUAGES:
            gain = np.bincount(which, counts[row] * np.log1p(held / SMOOTH), minlength=len(kept))
            kept = np.sort(np.argsort(counts.sum() * np.log(self.totals) - gain, kind="stable")[:LANGUAGES])
        place = np.full(len(self.languages), -1)
        place[kept] = np.arange(len(kept))
        mine = place[which] >= 0
        table = np.full((len(buckets), len(kept)), SMOOTH)
        table[row[mine], place[which[mine]]] += held[mine]
        return kept, table / self.totals[kept]

    def mixture(self, text: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the languages in a text, and its log-likelihood per n-gram."""
        buckets, counts = np.unique(grams(text), return_counts=True)
        out = np.zeros(len(self.languages))
        if not len(buckets):
            return out, 0.0
        total = counts.sum()
        start, table = self.likelihoods(buckets, counts)
        kept = list(range(len(start)))
        shares, fit = self._maximise(table, counts, np.full(len(kept), 1 / len(kept)))
        penalty = 0.5 * np.log(total)
        while len(kept) > 1:
            weakest = int(shares.argmin())
            fewer = kept[:weakest] + kept[weakest + 1 :]
            begin = np.delete(shares, weakest) + 1e-9
            new_shares, new_fit = self._maximise(table[:, fewer], counts, begin / begin.sum())
            if new_fit < fit - penalty:
                break
            kept, shares, fit = fewer, new_shares, new_fit
        out[start[kept]] = shares
        return out, fit / total

    @staticmethod
    def _maximise(table: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions after expectation-maximisation and their log-likelihood."""
        before, total = -np.inf, counts.sum()
        for _ in range(50):
            mixed = table @ shares
            fit = float(counts @ np.log(mixed))
            if fit - before < 1e-4 * max(1.0, total ** 0.5) or len(shares) == 1:
                break
            before = fit
            shares = shares * (table.T @ (counts / mixed)) / total
        return shares, fit


def gram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, bucket, n)`` over all rows with a language. Counts are summed before the shuffle."""
    importable(labelled.sparkSession)

    def told(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang_, held in counts.items():
            there = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(there)), pa.array(there, pa.int32()), pa.array(held[there])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts: dict[str, np.ndarray] = {}
        for batch in one_by_one(batches, 1000):
            for lang_, one in zip(batch.column(1).to_pylist(), lowered_bytes(batch.column(0))):
                if lang_ not in counts and len(counts) == LANGUAGES:
                    yield from told(counts)
                    counts = {}
                held = counts.setdefault(lang_, np.zeros(BUCKETS, np.int64))
                held += np.bincount(grams(one), minlength=BUCKETS)
        yield from told(counts)

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Learn a model from every labelled row; None without any.

    The driver receives the summed counts that are not zero: at most BUCKETS rows for each label
    value, whatever the number of rows. Any number of label values is learned.
    """
    counts = gram_counts(labelled, text, lang).toArrow().sort_by([("bucket", "ascending"), ("lang", "ascending")])
    names, codes = np.unique(counts["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    if not len(names):
        return None
    held = counts["n"].to_numpy()
    totals = np.bincount(codes, held, minlength=len(names)) + SMOOTH * BUCKETS
    first = np.searchsorted(counts["bucket"].to_numpy(), np.arange(BUCKETS + 1))
    return Model(tuple(names.tolist()), first, codes.astype(np.int32), held, totals)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (its share), ``shares`` and ``explained`` to every row.

    ``lang_pred`` is ``und`` with score 0 and no shares where the text is null or has no letter,
    or when nothing could be learned; equal shares go to the first language by name.
    ``explained`` tells whether the mixture gives the text a higher likelihood than uniformly
    drawn n-grams would. Columns of these names in ``docs`` are replaced; repeated rows are
    judged each, empty tables stay empty, texts are read whole. A text's mixture starts with the
    LANGUAGES label values that are likeliest by themselves. One pass without a shuffle; the model
    is broadcast, at most BUCKETS counts for each label value.
    """
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)
    added = T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())), T.StructField("explained", T.BooleanType())])
    docs = docs.drop(*added.names)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    at = docs.columns.index(text)

    def judge(one: str | None, low: np.ndarray) -> tuple:
        known = shared.value
        if known is None or not one or not any(map(str.isalpha, one)):
            return UNDETERMINED, 0.0, {}, False
        shares, fit_ = known.mixture(low)
        best = int(shares.argmax())
        given = {known.languages[i]: float(shares[i]) for i in np.flatnonzero(shares)}
        return known.languages[best], float(min(1.0, shares[best])), given, fit_ > -np.log(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches, 1000):
            column = batch.column(at)
            found = [judge(*x) for x in zip(column.to_pylist(), lowered_bytes(column))]
            kinds = (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.bool_())
            columns = [pa.array([list(f[i].items()) if i == 2 else f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def kept_languages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose language is determined and explained.

    Null texts, texts without letters, and texts less likely under every mixture than random
    n-grams are rejected; all others stay unchanged, with all their columns, whatever their names.
    Learns from the rows not held out.
    """
    model = fit(docs.where(~held_out(key)))
    judged = identify(packed(docs, text="text"), model)
    kept = judged.where((F.col("lang_pred") != UNDETERMINED) & F.col("explained"))
    return unpacked(kept, docs, text="text")
