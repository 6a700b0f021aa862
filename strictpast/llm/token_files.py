"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file: zstandard frames, each holding whole documents as little-endian unsigned
32-bit ids, then one skippable frame with the seek table: per frame its compressed size, its
decompressed size and the low 32 bits of the XXH64 of its content, and a footer with the
number of frames. Every zstandard decoder skips the table; a reader that wants some documents
reads the table from the end of the file and decompresses only their frames.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strictpast.llm.byte_bpe import ByteBpe
from strictpast.llm.workers import importable, kept_by_worker, one_by_one, texts, typed
from strictpast.session import scratch_root, stage

# Fixed values of the public seekable zstandard format.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")

#: Bytes of ids after which a frame, and compressed bytes after which a file is closed.
FRAME, FILE = 1 << 18, 64 << 20


class Writer:
    """One file; ``add`` returns where a document's ids went."""

    def __init__(self, store: fs.FileSystem, path: str, frame: int):
        self.out = store.open_output_stream(path, compression=None)
        self.pack, self.frame = zstandard.ZstdCompressor(level=3), frame
        self.table, self.held, self.size, self.written = [], [], 0, 0

    def add(self, ids: bytes) -> tuple[int, int]:
        if self.held and self.size + len(ids) > self.frame:
            self._close_frame()
        place = (len(self.table), self.size)
        self.held.append(ids)
        self.size += len(ids)
        return place

    def _close_frame(self) -> None:
        data = b"".join(self.held)
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        entries = b"".join(ENTRY.pack(*e) for e in self.table)
        body = entries + FOOTER.pack(len(self.table), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Random access to the frames of one file."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.file = path, store.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKED:
            raise ValueError(f"{path} has no seek table with checksums")
        first = end - FOOTER.size - frames * ENTRY.size
        self.table = [ENTRY.unpack_from(raw, i * ENTRY.size) for raw in [self._at(first, frames * ENTRY.size)] for i in range(frames)]
        self.starts = [0, *np.cumsum([e[0] for e in self.table]).tolist()]
        self.unpack, self.now = zstandard.ZstdDecompressor(), (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        """The content of frame ``i``, held until another one is asked for."""
        if self.now[0] != i:
            packed, size, check = self.table[i]
            data = self.unpack.decompress(self._at(self.starts[i], packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i} of {self.path} is damaged")
            self.now = (i, data)
        return self.now[1]

    def close(self) -> None:
        self.file.close()


@kept_by_worker
def shared_encoder(path: str) -> ByteBpe:
    """One encoder to packed ids per worker, so that its caches serve all its tasks."""
    return ByteBpe(path, piece=lambda ids: struct.pack(f"<{len(ids)}I", *ids), join=b"".join)


def write_token_files(
    docs: DataFrame, path: str, folder: str, end_id: int | None = None, key: str = "doc_id",
    text: str = "text", frame: int = FRAME, file: int = FILE,
) -> DataFrame:
    """Encode ``docs`` in ascending ``key`` order into files below ``folder``.

    Returns the stored index, one row per document: ``(key, part, file, frame, first, local,
    n_tokens)``; ``first`` is the byte in the frame, ``local`` the ids before it in its part,
    and parts ascend with the key. Null texts are empty, rows of one key are ordered by text,
    null keys come first, other columns are not read. A failed or repeated task leaves files
    that no index row names, so a retry needs no cleaning up. Only a document larger than
    ``frame`` makes a larger frame.
    """
    importable(docs.sparkSession)
    schema = T.StructType([typed(docs, key), *(T.StructField(n, t) for n, t in (
        ("part", T.IntegerType()), ("file", T.StringType()), ("frame", T.IntegerType()),
        ("first", T.LongType()), ("local", T.LongType()), ("n_tokens", T.LongType())))])
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared_encoder(path)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, local, number, writer = TaskContext.get().partitionId(), 0, 0, None
        attempt = uuid.uuid4().hex
        for batch in one_by_one(batches, 1000):
            places = []
            for one in texts(batch.column(1)):
                if writer is None:
                    name = f"part-{part:06d}-{number:05d}-{attempt}.zst"
                    writer, number = Writer(store, f"{root}/{name}", frame), number + 1
                ids = encode(one) + end
                places.append((part, name, *writer.add(ids), local, len(ids) // 4))
                local += len(ids) // 4
                if writer.written >= file:
                    writer.close()
                    writer = None
            columns = [pa.array(c, t) for c, t in zip(zip(*places), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)
        if writer is not None:
            writer.close()

    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    return stage(ordered.mapInArrow(run, schema), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: part totals are summed over parts."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(totals, "part").withColumn("start", F.col("_before") + F.col("local")).drop("_before")


def read_token_files(index: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids)`` of the documents in ``index``, which may be any subset.

    ``ids`` is the binary of little-endian 32-bit ids. ``index`` needs ``start``. Files are
    dealt to tasks by name; each opens a file once and decompresses only the frames named.
    """
    importable(index.sparkSession)
    schema = T.StructType([typed(index, key), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in one_by_one(batches, 1000):
            found = []
            for file, frame, first, n in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 2))):
                if file != name:
                    if reader:
                        reader.close()
                    name, reader = file, Reader(store, f"{root}/{file}")
                found.append(reader.frame(frame)[first : first + 4 * n])
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if reader:
            reader.close()

    wanted = index.select(key, "start", "n_tokens", "file", "frame", "first")
    dealt = wanted.repartition("file").sortWithinPartitions("file", "frame", "first")
    return dealt.mapInArrow(run, schema)


def with_crc32(read: DataFrame) -> DataFrame:
    """Replace ``ids`` by its unsigned crc32."""
    return read.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for token files below the shared scratch folder, as a URI."""
    root = scratch_root(spark)
    path = f"{root}/tokens-{uuid.uuid4().hex}"
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
