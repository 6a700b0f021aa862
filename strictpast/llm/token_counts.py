"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone by the library; those that come back as
exactly their own id, and that the split pattern leaves in one piece, are *proven* to count
one wherever they stand as a pre-token. Tasks look pre-tokens up in that set and merge only
the rest, each distinct one once per cache life.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strictpast.llm.byte_bpe import ByteBpe, byte_alphabet
from strictpast.llm.workers import importable, kept_by_worker, one_by_one, texts, typed


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as exactly one token."""
    library = Tokenizer.from_file(path)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    one_piece = regex.compile(public_tokenizers.PATTERN).fullmatch
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    strings, ids = [], []
    for shown, i in library.get_vocab(with_added_tokens=False).items():
        try:
            string = bytes(back[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # special strings and parts of characters stand in no text alone
        if string not in special and one_piece(string):
            strings.append(string)
            ids.append(i)
    encoded = library.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, i, e in zip(strings, ids, encoded) if e.ids == [i])


class Counter(ByteBpe):
    """Counts tokens: proven strings count one, the rest is merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(path, piece=len, join=sum)
        self.whole = whole

    def _merge(self, pre_token: str) -> int:
        return 1 if pre_token in self.whole else super()._merge(pre_token)


@kept_by_worker
def shared_counter(path: str, whole: frozenset[str]) -> Counter:
    """One counter per worker, so that its caches serve all tasks that it runs."""
    return Counter(path, whole)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each on its
    own; other columns are not read. An empty table gives an empty result. Texts of any
    length are counted whole. One pass, no shuffle; the proven strings are broadcast, at
    most the size of the vocabulary.
    """
    spark = docs.sparkSession
    importable(spark)
    proven = spark.sparkContext.broadcast(whole_tokens(path))
    schema = T.StructType([typed(docs, key), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared_counter(path, proven.value)
        for batch in one_by_one(batches, 2000):
            rows = texts(batch.column(1))
            sizes = pa.array([len(t.encode()) for t in rows], pa.int64())
            counts = pa.array([count(t) for t in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=schema.names)

    counted = docs.select(key, text).mapInArrow(run, schema)
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)
