"""Token ids as wavelet matrices, one succinct shard per bounded run of tokens.

A wavelet matrix keeps a sequence of ids as one bit-plane per binary digit, most significant first;
after each plane the sequence is stably parted by that bit. With a running count of ones every
BLOCK_BITS bits, ``access``, ``rank``, ``count`` and ``select`` read a few words a plane.

A shard is one self-contained byte string: header, document directory, zeros and running counts of each
plane, offsets, and the planes in pieces of PIECE_BITS bits, each compressed on its own. ``open_shard``
reads header, directory and counts only; a lookup then unpacks the pieces that it meets, at most a few
a plane, so "token at i", "how often" and "where" are answered from the file without unpacking the rest.

Writing: documents are range-partitioned and sorted by doc_id (ties by a hash of the text), tokenised
in that order, and every run of about SHARD_TOKENS ids becomes one shard: a self-contained byte string
(header, document directory, planes, counts). Shards travel as rows of a Parquet table, because
Spark's own writer is what reaches every store, commits whole tasks and survives lost executors.

Defined results: null text counts as empty and yields the end id alone; every row keeps its own
entry, repeated rows included (rows of one doc_id are neighbours); null doc_id sorts first; a document
longer than a shard gets a longer shard; ties of doc_id are in the order of the texts' hashes; an empty table gives an empty result; of the input only
doc_id and text are read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

MAGIC, END_ID, SHARD_TOKENS, BLOCK_BITS, PIECE_BITS = b"KWM2", 1, 1 << 20, 512, 1 << 17
#: Remembered pieces a worker and bytes of their ids; a full table is emptied.
MOST_PIECES, MOST_BYTES = 800_000, 32 << 20
#: Places in the table of pieces: words to be asked whole, and the empty piece.
ALONE, NOTHING = 0, 1
TEXT_AT_ONCE, ROWS_AT_ONCE = 6 << 20, 512
#: ASCII punctuation that no contraction begins with.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class PackedPlane:
    """A bit-plane in compressed pieces, unpacked when met; slices must lie within a piece, as blocks do."""

    def __init__(self, data: bytes, at: np.ndarray, size: int):
        self.data, self.at, self.size = data, at, size
        self.pieces: dict[int, np.ndarray] = {}

    def piece(self, i: int) -> np.ndarray:
        if i not in self.pieces:
            size = min(PIECE_BITS // 8, self.size - i * PIECE_BITS // 8)
            raw = zstandard.ZstdDecompressor().decompress(self.data[self.at[i] : self.at[i + 1]], max_output_size=size)
            self.pieces[i] = np.frombuffer(raw, np.uint8)
        return self.pieces[i]

    def __getitem__(self, key: int | slice) -> np.ndarray:
        if isinstance(key, slice):
            i, low = divmod(key.start, PIECE_BITS // 8)
            return self.piece(i)[low : low + key.stop - key.start]
        i, low = divmod(key, PIECE_BITS // 8)
        return self.piece(i)[low]

    def whole(self) -> np.ndarray:
        return np.concatenate([self.piece(i) for i in range(len(self.at) - 1)])


class WaveletMatrix:
    """Bit-planes over ids, with rank and select."""

    def __init__(self, n: int, planes: list, zeros: list[int], counts: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.counts = [self._count(p) for p in planes] if counts is None else counts

    @staticmethod
    def _count(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane.view(np.uint64)).astype(np.int64).reshape(-1, BLOCK_BITS // 64).sum(axis=1)
        return np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        at = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in reversed(range(levels)):
            bit = (at & at.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            plane = np.zeros(-(-max(len(ids), 1) // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
            plane[: len(packed)] = packed
            planes.append(plane)
            low = at[~bit]
            zeros.append(len(low))
            at = np.concatenate([low, at[bit]])
        return cls(len(ids), planes, zeros)

    def tokens(self) -> np.ndarray:
        """The whole sequence, rebuilt plane by plane from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for shift, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            whole = plane.whole() if isinstance(plane, PackedPlane) else plane
            bit = np.unpackbits(whole, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[~bit] = out[:z]
            up[bit] = out[z:] | kind(1 << shift)
            out = up
        return out

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        if not rest:
            return int(self.counts[level][block])
        at = block * BLOCK_BITS // 8
        tail = self.planes[level][at : at + -(-rest // 8)]
        if rest % 8:
            tail = np.append(tail[:-1], tail[-1] & ((1 << rest % 8) - 1))
        return int(self.counts[level][block]) + int(np.bitwise_count(tail).sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        out = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = z + ones if bit else i - ones
        return out

    def _walk(self, token: int, i: int, j: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (z + a, z + b) if token >> (len(self.planes) - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        a, b = self._walk(token, 0, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of token."""
        first, last = self._walk(token, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        at = first + k
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, at - self.zeros[level] if bit else at, bit)
        return at

    def _place(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) bit of a kind in a plane."""
        counts = self.counts[level] if bit else np.arange(len(self.counts[level])) * BLOCK_BITS - self.counts[level].astype(np.int64)
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard file; see the module's text for its parts."""
    m = WaveletMatrix.build(ids)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    step, z = PIECE_BITS // 8, zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
    pieces = [[z.compress(p[i : i + step].tobytes()) for i in range(0, len(p), step)] for p in m.planes]
    at = np.cumsum([0, *(len(x) for plane in pieces for x in plane)]).astype("<u8")
    head = MAGIC + struct.pack("<QQI", len(doc_ids), m.n, len(m.planes))
    body = [has, named, np.array(lengths, "<i8"), np.array(m.zeros, "<i8"), *(c.astype("<u8") for c in m.counts), at]
    return b"".join([head, *(x.tobytes() for x in body), *(x for plane in pieces for x in plane)])


def open_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix, whose planes stay packed."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    docs, n, levels = struct.unpack_from("<QQI", data, 4)
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    size = -(-max(n, 1) // BLOCK_BITS) * BLOCK_BITS // 8
    each = -(-size // (PIECE_BITS // 8))
    has, named, lengths, zeros = take("u1", docs), take("<i8", docs), take("<i8", docs), take("<i8", levels)
    counts = [take("<u8", size * 8 // BLOCK_BITS + 1) for _ in range(levels)]
    places = take("<u8", levels * each + 1).astype(np.int64)
    places = places + at
    planes = [PackedPlane(data, places[i * each : (i + 1) * each + 1], size) for i in range(levels)]
    return [int(d) if h else None for d, h in zip(named, has, strict=True)], lengths, WaveletMatrix(n, planes, zeros.tolist(), counts)


class PieceTokenizer:
    """The tokenizers library, asked once for each distinct piece of a word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words. Texts are split into words as Arrow columns, and only the different words of a batch meet Python. A
    word of letters and then punctuation is two pre-tokens; such halves are sent many at a
    time, and the end-of-word mark on each pre-token's last id tells them apart again (checked: as
    many marks as halves, else one by one). Runs of ASCII letters go in small ones, so that normaliser and
    pre-tokenizer have nothing to do for them but cut at the blanks. Other words are sent alone, and texts with the control characters that only Python and Arrow count as white space go whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.small = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.small.normalizer, self.small.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        """Empties the table: packed ids by number, with the numbers of halves (ALONE: the whole word must be asked) and of whole words."""
        self.table = pa.array([b"", b""], pa.large_binary())
        self.halves: dict[str, int] = {"": NOTHING}
        self.whole: dict[str, int] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], small: bool = False) -> list[bytes]:
        out: list[bytes] = []
        ask = (self.small if small else self.tokenizer).encode_batch_fast
        for at in range(0, len(words), 256):
            group = words[at : at + 256]
            ids = np.array(ask([" ".join(group)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(group):
                out += self._alone(group)
                continue
            data, cut = ids.tobytes(), ((ends + 1) * self.kind.itemsize).tolist()
            out += [data[x:y] for x, y in zip([0, *cut], cut, strict=False)]
        return out

    def _learn(self, numbers: dict[str, int], names: list[str], ask: Callable[[list[str]], list[bytes]]) -> None:
        numbers.update(zip(names, range(len(self.table), len(self.table) + len(names)), strict=True))
        self.table = pa.concat_arrays([self.table, pa.array(ask(names), pa.large_binary())])

    def _packed(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Packed ids of each of some different words."""
        stem = pc.ascii_rtrim(words, PUNCTUATION)
        words = pc.if_else(pc.ascii_is_alpha(stem), pc.ascii_lower(words), words)
        first = offsets(words)
        cut = np.empty(2 * len(words) + 1, np.int32)
        cut[::2], cut[1::2] = first, first[:-1] + pc.binary_length(stem).to_numpy()
        # letters and punctuation in turn, in the words' own bytes
        coded = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(cut), words.buffers()[2]).dictionary_encode()
        names, halves = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.halves  # objects made in one call
        fresh = [(x, a) for x, a in zip(names, pc.ascii_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False).tolist(), strict=True) if x not in halves]
        self._learn(halves, [x for x, ascii_letters in fresh if ascii_letters], partial(self._together, small=True))
        others = {x: divides(x) for x, ascii_letters in fresh if not ascii_letters}
        halves.update((x, ALONE) for x, plain in others.items() if not plain)
        self._learn(halves, [x for x, plain in others.items() if plain], self._together)
        number = np.array([halves[x] for x in names], np.int64)[coded.indices.to_numpy()]
        if len(odd := np.flatnonzero(number[::2] == ALONE)):
            names = words.take(pa.array(odd)).to_pylist()
            self._learn(self.whole, [x for x in dict.fromkeys(names) if x not in self.whole], self._alone)
            number[2 * odd], number[2 * odd + 1] = [self.whole[x] for x in names], NOTHING
        return every_nth(self.table.take(pa.array(number)), np.arange(0, 2 * len(words) + 1, 2))

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.halves) + len(self.whole) > MOST_PIECES or self.table.nbytes > MOST_BYTES:
            self._forget()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ids = every_nth(self._packed(coded.dictionary).take(coded.indices), offsets(lists) - lists.offsets[0].as_py())
        data, at = (ids.buffers()[2] or b"") and ids.buffers()[2].to_pybytes(), offsets(ids).tolist()
        out = [data[x:y] for x, y in zip(at, at[1:], strict=False)]
        for i in np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._alone([texts[i].as_py()])[0]
        return out


def divides(half: str) -> bool:
    """Whether a word's part is a pre-token of its own: punctuation, or letters after whose composition and lower-casing no mark would join what follows."""
    return not half.strip(PUNCTUATION) or (half.isalpha() and (half.isascii() or unicodedata.normalize("NFC", half).lower().isalpha()))


def offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a column of strings, bytes or lists begin, and the end."""
    wide = pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)) if len(column) else np.zeros(1, np.int64)


def every_nth(column: pa.LargeBinaryArray, at: np.ndarray) -> pa.LargeBinaryArray:
    """Neighbouring values joined: those from each place to the next."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets(column)[at])), column.buffers()[2]])


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All rows in order, about TEXT_AT_ONCE bytes of text at a time, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // TEXT_AT_ONCE
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    yield from (batch.slice(x, y - x) for x, y in zip(cut, cut[1:], strict=False))


@cache
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


SHARDS = "part int, seq int, first long, n_tokens long, payload binary"


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> str:
    """Tokenises ``docs`` in ascending doc_id order and writes shards under ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tokenizer(path), TaskContext.get().partitionId()
        end = np.array([end_id], t.kind).tobytes()
        seq = first = held = 0
        doc_ids, lengths, packed = [], [], []

        def flush() -> pa.RecordBatch:
            payload = pack_shard(doc_ids, lengths, np.frombuffer(b"".join(packed), t.kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "seq", "first", "n_tokens", "payload"],
            )

        for whole in batches:
            for b in portions(whole):
                for d, x in zip(b.column("doc_id").to_pylist(), t.encode(pc.fill_null(b.column("text"), "")), strict=True):
                    n = len(x) // t.kind.itemsize + 1
                    if held and held + n > SHARD_TOKENS:
                        yield flush()
                        seq, first, held, doc_ids, lengths, packed = seq + 1, first + held, 0, [], [], []
                    doc_ids.append(d)
                    lengths.append(n)
                    packed += (x, end)
                    held += n
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    out = f"{folder}/wavelet-{uuid.uuid4().hex}"
    rows.select("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(out)
    return out


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, from the shard files alone."""
    shards = spark.read.schema(SHARDS).parquet(where)
    # one sum per written partition, in partition order
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part] = total
        total += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                doc_ids, lengths, matrix = open_shard(row["payload"])
                tokens = matrix.tokens().astype("<u4")
                ends = np.cumsum(lengths)
                start = base[row["part"]] + row["first"] + ends - lengths
                for at in range(0, len(doc_ids), ROWS_AT_ONCE):
                    to = min(len(doc_ids), at + ROWS_AT_ONCE)
                    ids = [tokens[e - n : e].tobytes() for e, n in zip(ends[at:to], lengths[at:to], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[at:to], pa.int64()), pa.array(start[at:to]), pa.array(lengths[at:to]), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def find_tokens(spark: SparkSession, where: str, tokens: list[int]) -> DataFrame:
    """``(token, doc_id, at)`` of every occurrence of a few tokens, by select on the shard files; at counts from the document's start."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column("payload"):
                doc_ids, lengths, matrix = open_shard(payload.as_py())
                ends = np.cumsum(lengths)
                for token in wanted:
                    places = np.array(matrix.locate(token), np.int64)
                    doc = np.searchsorted(ends, places, side="right")
                    ids = [doc_ids[i] for i in doc.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([token] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(places - (ends - lengths)[doc])], ["token", "doc_id", "at"]
                    )

    return spark.read.schema(SHARDS).parquet(where).select("payload").mapInArrow(run, "token long, doc_id long, at long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark))
    return read_documents(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
