"""SentencePiece encoding and decoding of merge-type vocabularies.

A text is escaped (a dummy space in front, spaces as U+2581) and cut before each run of
U+2581: a vocabulary is accepted only if no piece has U+2581 after another character, so no
merge crosses a cut. In each segment an agenda of adjacent symbol pairs, best score first and
leftmost among equals, is worked off; symbols that end outside the vocabulary become byte
pieces. The fresh segments of a batch work off their agendas side by side: a matrix holds the
rank of every pair, each round takes the best of every row, merges it and renews the ranks
of its two neighbours. Long segments keep a heap of their own.
Distinct segments are encoded once while the cache holds them, and each block of texts checks all
its fresh segments, ids and decoded text, against the library. The cache has two generations: what
is used moves to the younger one, and a full younger one takes the place of the older.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strictpast.llm.workers import importable, kept_by_worker, one_by_one, texts, typed

SPACE = "▁"
#: Segments, and characters of segments and ids, that one of the two generations of a worker's cache holds.
CACHE, CHARACTERS = 200_000, 8 << 20
#: Characters up to which segments share a matrix, its cells, and characters of text that are encoded together.
SHORT, CELLS, BLOCK = 48, 1 << 18, 1 << 20
NEVER = np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary must have all byte pieces")
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: Piece to what orders it in the agenda (less is sooner) and its id.
        self.vocabulary = {sp.id_to_piece(i): (-sp.get_score(i), i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.vocabulary):
            raise ValueError("a piece spans a space; segments would not be independent")
        self.pieces = {i: p for p, (_, i) in self.vocabulary.items()}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        #: Segments, with their spaces, to their ids; what decodes to another text than the segment.
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0
        self.altered: dict[str, str] = {}
        self.fresh: list[tuple[str, list[int], str]] = []
        self.texts = [str(i) for i in ids]
        self._tables(plain)

    def _tables(self, plain: list[int]) -> None:
        """Sorted keys of all mergeable pairs of pieces, with the rank and the id of what they make."""
        order = {score: rank for rank, score in enumerate(sorted({score for score, _ in self.vocabulary.values()}))}
        pairs = {}
        for piece, (score, i) in self.vocabulary.items():
            for cut in range(1, len(piece)):
                one, two = self.vocabulary.get(piece[:cut]), self.vocabulary.get(piece[cut:])
                if one and two:
                    pairs[one[1] << 32 | two[1]] = (order[score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.made = (np.array([pairs[k][j] for k in self.keys.tolist()], np.int32) for j in (0, 1))
        chars = {ord(p): i for p, (_, i) in self.vocabulary.items() if len(p) == 1}
        self.chars = np.array(sorted(chars), np.uint32)
        self.char_ids = np.array([chars[c] for c in self.chars.tolist()], np.int32)
        #: Whether characters outside the vocabulary stand in no piece, so that nothing merges with them.
        self.closed = all(ord(c) in chars for c in set().union(*self.vocabulary))

    def _pairs(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent symbols; NEVER where they do not merge."""
        if not len(self.keys):
            return np.full(one.shape, NEVER), np.zeros(one.shape, np.int32)
        key = one.astype(np.int64) << 32 | two
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (one >= 0) & (two >= 0), self.ranks[at], NEVER), self.made[at]

    def encode_short(self, segments: list[str]) -> list[list[int] | None]:
        """The ids of short segments, all agendas side by side.

        A character outside the vocabulary is a symbol beyond all ids, which no pair has; where pieces
        contain such characters, the segments that hold one give None.
        """
        n, sizes = len(segments), np.array([len(s) for s in segments])
        width = int(sizes.max())
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        unknown = len(self.texts) + codes.astype(np.int32) if self.closed else -1
        found = np.where(self.chars[at] == codes, self.char_ids[at], unknown).astype(np.int32)
        inside = np.arange(width) < sizes[:, None]
        symbols = np.full((n, width + 1), -1, np.int32)  # the last column stands for "nothing"
        symbols[:, :-1][inside] = found
        strange = ((symbols[:, :-1] < 0) & inside).any(axis=1)
        spelt = (symbols >= len(self.texts)).any(axis=1).tolist()
        rank, made = np.full((n, width + 1), NEVER), np.zeros((n, width + 1), np.int32)
        rank[:, : width - 1], made[:, : width - 1] = self._pairs(symbols[:, : width - 1], symbols[:, 1:width])
        right = np.minimum(np.arange(1, width + 2), sizes[:, None])
        right[right >= sizes[:, None]] = width
        left = np.tile(np.arange(-1, width), (n, 1))
        rows = np.flatnonzero(~strange)
        while len(rows):
            i = rank[rows].argmin(axis=1)
            more = rank[rows, i] < NEVER
            rows, i = rows[more], i[more]
            if not len(rows):
                break
            j = right[rows, i]
            after = right[rows, j]
            symbols[rows, i], symbols[rows, j] = made[rows, i], -1
            rank[rows, j] = NEVER
            right[rows, i], left[rows, after] = after, i
            rank[rows, i], made[rows, i] = self._pairs(symbols[rows, i], symbols[rows, after])
            before = left[rows, i]
            some = before >= 0
            r, b = rows[some], before[some]
            rank[r, b], made[r, b] = self._pairs(symbols[r, b], symbols[r, i[some]])
        kept = symbols >= 0
        kept[strange] = False
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat = symbols[kept].tolist()
        out = [None if odd else flat[a:b] for a, b, odd in zip([0, *ends], ends, strange.tolist())]
        return [self._spell(ids) if ids and spell else ids for ids, spell in zip(out, spelt)]

    def _spell(self, symbols: list[int]) -> list[int]:
        """Ids of symbols, byte pieces for characters outside the vocabulary."""
        most = len(self.texts)
        return [i for s in symbols for i in ((s,) if s < most else [self.byte_ids[b] for b in chr(s - most).encode()])]

    def encode_segment(self, segment: str) -> list[int]:
        """Work off the agenda of one segment.

        ``symbols[i]`` is the symbol that starts at character ``i``, empty once merged into the
        one before; ``right[i]`` is where the next one starts. An entry of the agenda is stale
        when its merged piece no longer is the two symbols that stand there.
        """
        merged = self.vocabulary.get
        symbols = list(segment)
        last = len(symbols)
        agenda = [(known[0], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if (known := merged(pair))]
        if agenda:
            heapify(agenda)
            left, right = list(range(-1, last)), list(range(1, last + 1))
            while agenda:
                _, i, pair = heappop(agenda)
                one, j = symbols[i], right[i]
                if not one or j >= last or len(one) + len(symbols[j]) != len(pair):
                    continue
                symbols[i], symbols[j] = pair, ""
                right[i] = after = right[j]
                if after < last:
                    left[after] = i
                    if known := merged(both := pair + symbols[after]):
                        heappush(agenda, (known[0], i, both))
                if (before := left[i]) >= 0 and (known := merged(both := symbols[before] + pair)):
                    heappush(agenda, (known[0], before, both))
        try:
            return [merged(s)[1] for s in symbols if s]
        except TypeError:  # some symbol is not in the vocabulary
            return [i for s in symbols if s for i in ([merged(s)[1]] if merged(s) else [self.byte_ids[b] for b in s.encode()])]

    def decode_segment(self, ids: list[int]) -> str:
        """The text of the ids of one segment, with its spaces; runs of byte pieces are UTF-8."""
        try:
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        except KeyError:  # there are byte pieces
            out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(self.pieces[i])
        return ("".join(out) + run.decode(errors="replace")).replace(SPACE, " ")

    def _learn(self, segments: list[str]) -> None:
        """Encode segments that the cache lacks; most of them in matrices of bounded size."""
        short = sorted((s for s in segments if len(s) <= SHORT), key=len)
        for at in range(0, len(short), CELLS // SHORT):
            part = short[at : at + CELLS // SHORT]
            self._keep(part, self.encode_short([s.replace(" ", SPACE) for s in part]))
        long = [s for s in segments if len(s) > SHORT]
        self._keep(long, [None] * len(long))

    def _keep(self, segments: list[str], found: list[list[int] | None]) -> None:
        known, fresh, shown = self.known, self.fresh, self.texts
        for segment, ids in zip(segments, found):
            if ids is None:
                ids = self.encode_segment(segment.replace(" ", SPACE))
            decoded = self.decode_segment(ids)
            if segment != " ":  # no text of its own gives this one; it ends texts only
                fresh.append((segment, ids, decoded))
            if decoded != segment:
                self.altered[segment] = decoded
            known[segment] = text = ",".join([shown[i] for i in ids])
            self.held += len(segment) + len(text)

    def _turn(self) -> None:
        """The younger generation of the cache is the older one from now on."""
        self.known, self.older, self.held = {}, self.known, 0
        self.altered = {s: d for s, d in self.altered.items() if s in self.older}

    def __call__(self, texts: list[str]) -> list[tuple[str, str]]:
        """The ids of each text, joined by commas, and the text they decode to."""
        if len(self.known) > CACHE or self.held > CHARACTERS:
            self._turn()
        cut = [re.findall(" +[^ ]*", " " + t.replace(SPACE, " ")) if t else [] for t in texts]
        absent = set().union(*cut).difference(self.known)
        again = absent.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.held += sum(len(s) + len(self.older[s]) for s in again)
        self._learn(list(absent.difference(again)))
        ids, decoded = self.known.__getitem__, self.altered.get
        return [(",".join(map(ids, one)), "".join(map(decoded, one, one) if self.altered else one)[1:]) for one in cut]

    def check(self) -> None:
        """Hold all segments encoded since the last call against the library."""
        if not self.fresh:
            return
        segments, ids, decoded = map(list, zip(*self.fresh))
        self.fresh.clear()
        theirs = self.library.encode([s.replace(SPACE, " ")[1:] for s in segments], num_threads=1)
        back = [" " + t for t in self.library.decode(ids, num_threads=1)]
        if theirs != ids or back != decoded:
            wrong = next(i for i in range(len(ids)) if theirs[i] != ids[i] or back[i] != decoded[i])
            raise ValueError(f"{segments[wrong]!r} is {ids[wrong]}, {decoded[wrong]!r}; the library has {theirs[wrong]}, {back[wrong]!r}")


def parts_of(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of some BLOCK characters together, or a longer one alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > BLOCK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


@kept_by_worker
def shared_codec(path: str) -> Codec:
    """One codec per worker, so that its cache serves all tasks that it runs."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids, decoded)`` of every row.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded
    each, other columns are not read, an empty table stays empty, and texts are encoded whole.
    A segment that the library encodes or decodes otherwise fails the task.
    """

    def show(rows: list[tuple[str, str]], counts: np.ndarray) -> list[pa.Array]:
        flat = [np.fromstring(ids, np.int32, sep=",") for ids, _ in rows if ids]
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return [pa.ListArray.from_arrays(bounds, np.concatenate([np.empty(0, np.int32), *flat])), pa.array([d for _, d in rows], pa.string())]

    return _encoded(docs, path, key, text, "ids array<int>, decoded string", show)


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like :func:`encode_documents` with the SHA-256 of the decimal ids, joined by commas, and
    of the decoded text."""

    def show(rows: list[tuple[str, str]], counts: np.ndarray) -> list[pa.Array]:
        return [pa.array([hashlib.sha256(r[i].encode()).hexdigest() for r in rows], pa.string()) for i in (0, 1)]

    return _encoded(docs, path, key, text, "ids_sha256 string, decoded_sha256 string", show)


def _encoded(docs: DataFrame, path: str, key: str, text: str, shown: str, show: Callable) -> DataFrame:
    importable(docs.sparkSession)
    schema = T.StructType([typed(docs, key), T.StructField("n_tokens", T.LongType()), *T.StructType.fromDDL(shown).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for batch in one_by_one(batches, 1000):
            bodies, rows = texts(batch.column(1)), []
            for part in parts_of(bodies):
                rows += codec(part)
                codec.check()
            counts = np.array([ids.count(",") + 1 if ids else 0 for ids, _ in rows], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *show(rows, counts)], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
