"""Token counts, token files and the SentencePiece codec against the libraries."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strictpast.llm import sentencepiece_codec, token_counts, token_files, workers
from strictpast.llm.byte_bpe import Bounded, ByteBpe

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", " \n", "\t", "a", "the", "word,", "don't", "é", "日本", "😀", "123", "▁", "▁▁", "<s>", "<|endoftext|>", "\x00", "...", " ", "x" * 60]


def odd_texts(n=400, seed=3):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)]
    return [None, "", " ", "  ", "▁", "\n", "plain words here, and more.", "long " * 40_000, *texts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts())] + [(None, "no id", None, None), (6, "again", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, part int")


def by_key(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_counts_equal_the_library(docs):
    library = Tokenizer.from_file(BYTE_BPE)
    want = []
    for r in docs.collect():
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r.doc_id, len(text.encode()), n, n > 1024))
    assert by_key(token_counts.count_tokens(docs, BYTE_BPE)) == sorted(want, key=str)


def test_whole_tokens_are_proven():
    library = Tokenizer.from_file(BYTE_BPE)
    whole = token_counts.whole_tokens(BYTE_BPE)
    assert len(whole) > 40_000
    assert "<|endoftext|>" not in whole
    some = sorted(whole)[::97]
    assert all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0
    assert sentencepiece_codec.digest_documents(none, PIECES).count() == 0
    folder = token_files.new_folder(spark)
    index = token_files.write_token_files(none, BYTE_BPE, folder)
    assert token_files.read_token_files(token_files.with_starts(index), folder).count() == 0


def test_a_full_cache_starts_anew():
    memo = Bounded(str.upper, limit=3)
    assert [memo[c] for c in "abcabcd"] == list("ABCABCD")
    assert len(memo) <= 3
    tiny = ByteBpe(BYTE_BPE, piece=len, join=sum)
    tiny.pieces.limit = tiny.chunks.limit = 2
    text = "many different words stand here and many different words come again"
    assert tiny(text) == len(Tokenizer.from_file(BYTE_BPE).encode(text).ids)


def test_files_round_trip(spark, docs):
    library = Tokenizer.from_file(BYTE_BPE)
    folder = token_files.new_folder(spark)
    index = token_files.write_token_files(docs, BYTE_BPE, folder, end_id=2, frame=1024, file=1000)
    index = token_files.with_starts(index)
    read = token_files.read_token_files(index, folder).collect()
    assert index.select("file").distinct().count() > 1
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in read), key=lambda r: r[1]) == want
    crc = token_files.with_crc32(token_files.read_token_files(index.where("doc_id = 6"), folder)).collect()
    assert sorted(r.ids_crc32 for r in crc) == sorted(zlib.crc32(w[3]) for w in want if w[0] == 6)


def test_a_damaged_frame_is_found(tmp_path):
    store = token_files.fs.LocalFileSystem()
    path = str(tmp_path / "one.zst")
    writer = token_files.Writer(store, path, frame=100)
    places = [writer.add(bytes([i]) * 60) for i in range(5)]
    writer.close()
    reader = token_files.Reader(store, path)
    assert [reader.frame(f)[p : p + 60] for f, p in places] == [bytes([i]) * 60 for i in range(5)]
    data = bytearray(open(path, "rb").read())
    data[reader.starts[2] + 8] ^= 0xFF
    open(path, "wb").write(bytes(data))
    damaged = token_files.Reader(store, path)
    assert damaged.frame(1) == reader.frame(1)
    with pytest.raises(Exception):
        damaged.frame(2)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)
    assert whole.read(60) == bytes([0]) * 60  # plain decoders read the frames in order


def test_pieces_equal_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.encode_documents(docs, PIECES).collect()
    want = {(r.doc_id, r.text): library.encode(r.text or "") for r in docs.collect()}
    assert sorted((str(r.doc_id), r.n_tokens, tuple(r.ids), r.decoded) for r in got) == sorted(
        (str(k[0]), len(v), tuple(v), library.decode(v)) for k, v in want.items())
    digests = {r.doc_id: r for r in sentencepiece_codec.digest_documents(docs.where("doc_id <> 6"), PIECES).collect()}
    for (key, _), ids in want.items():
        if key is not None and key != 6:
            assert digests[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert digests[key].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_wrong_segment_fails():
    codec = sentencepiece_codec.Codec(PIECES)
    ids = codec.encode_segment("▁house")
    codec.fresh.append(("▁house", ids[::-1] + ids, " house"))
    with pytest.raises(ValueError):
        codec.check()
    codec.fresh.append(("▁house", ids, " house"))
    codec.check()
    long = "▁" + "ab" * 5000
    assert codec.encode_segment(long) == codec.library.encode(long[1:])


def test_the_cache_of_segments_is_bounded(monkeypatch):
    """Two generations of a cache: what is used stays, what is not goes, and results never depend on it."""
    codec = sentencepiece_codec.Codec(PIECES)
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 100)
    monkeypatch.setattr(sentencepiece_codec, "CHARACTERS", 2000)
    for i in range(50):
        rows = ["the house " + " ".join(f"w{i}x{j}" for j in range(40)), f"the {'long' * 200}{i} \u2581\u2581 \u05d0\U0001f600{i} e\u0301 ", ""]
        for (ids, decoded), text in zip(codec(rows), rows):
            want = codec.library.encode(text)
            assert (ids, decoded) == (",".join(map(str, want)), codec.library.decode(want))
        encoded = {s for s, _, _ in codec.fresh}
        codec.check()
        assert i == 0 or not encoded & {" the", " house"}
        assert len(codec.known) + len(codec.older) <= 2 * (100 + 50)
        assert sum(len(s) + len(t) for held in (codec.known, codec.older) for s, t in held.items()) <= 2 * (2000 + 5000)
        assert not codec.altered.keys() - codec.known.keys() - codec.older.keys()


def test_unknown_characters_share_the_matrix():
    codec = sentencepiece_codec.Codec(PIECES)
    segments = ["▁", "▁house", "▁\u05d0\U0001f600", "▁ho\u0007use\U0010ffff", "\u0000▁"]
    assert codec.closed
    assert codec.encode_short(segments) == [codec.encode_segment(s) for s in segments]


def test_counts_ignore_other_columns(docs):
    plain = token_counts.count_tokens(docs.select("doc_id", "text"), BYTE_BPE)
    assert by_key(plain) == by_key(token_counts.count_tokens(docs.withColumn("over_limit", F.lit(1)), BYTE_BPE))
    assert np.isin(["n_bytes", "n_tokens", "over_limit"], plain.columns).all()


def test_batches_of_texts_are_bounded(spark):
    workers.importable(spark)
    assert spark.conf.get(workers.BATCH_KEY) == str(workers.BATCH_BYTES)
    rows = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    got = rows.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 2000 and max(r.size for r in got) < 2 * workers.BATCH_BYTES
    try:
        spark.conf.set(workers.BATCH_KEY, 1 << 20)
        workers.importable(spark)
        assert spark.conf.get(workers.BATCH_KEY) == str(1 << 20)
    finally:
        spark.conf.unset(workers.BATCH_KEY)


def test_codecs_of_a_worker_can_be_let_go():
    one = sentencepiece_codec.shared_codec(PIECES)
    assert sentencepiece_codec.shared_codec(PIECES) is one
    workers.let_go()
    assert all(held.cache_info().currsize == 0 for held in (sentencepiece_codec.shared_codec, token_files.shared_encoder, token_counts.shared_counter))
