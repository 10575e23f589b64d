"""Byte-level BPE encoding and decoding in linear time.

Each pre-token's bytes are read as Latin-1 text, so an Aho-Corasick automaton over the vocabulary
finds the longest token at every position in one pass. A backtracking search takes the longest
token, keeps it when it is compatible with the token before it, else tries that token's next shorter
prefix, else steps back; a position that failed once is never tried again, so the work is linear.
Two adjacent tokens are compatible when the merge procedure, run on their joined bytes, would end
in exactly these two; this is decided by undoing merges from the boundary and remembered. A token
sequence whose neighbours are all compatible is the one that the merges produce.

Text is cut at spaces that precede a non-space first (always a pre-token boundary), and the ids of
such pieces are remembered in a bounded table a worker.

Defined results: null text encodes like empty text, to no ids; every row keeps its own output row,
repeated rows included; ids are little-endian unsigned 32-bit; an empty table gives an empty result;
of the input only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from struct import Struct

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, sliced, table

#: Remembered pieces and pairs a worker; a full table is emptied. Longer pieces are not remembered.
MOST_PIECES, MOST_PAIRS, LONG = 200_000, 200_000, 48
ROWS_OUT = 512
#: Unicode White_Space, fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
U32 = Struct("<I").pack


@cache
def char_class(prop: str) -> str:
    """A property's code points as ranges for ``re``, which scans faster than property lookups."""
    test, out, start = regex.compile(rf"\p{{{prop}}}"), [], None
    for c in range(0x110001):
        hit = c < 0x110000 and not 0xD800 <= c < 0xE000 and test.match(chr(c)) is not None
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            out.append(re.escape(chr(start)) if start == c - 1 else f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(out)


@cache
def compiled(pattern: str) -> re.Pattern:
    """The tokenizer's split pattern, with its classes spelled out for ``re``."""

    def inside(m: re.Match) -> str:
        return m[0].replace(r"\s", SPACE).replace(r"\p{L}", char_class("L")).replace(r"\p{N}", char_class("N"))

    classes = re.sub(r"\[[^\]]*\]", inside, pattern)
    spelled = classes.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return re.compile(spelled.replace(r"\p{L}", f"[{char_class('L')}]").replace(r"\p{N}", f"[{char_class('N')}]"))


class Vocabulary:
    """Ranks with what the search needs: automaton, next shorter prefix, last merge of each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.sizes = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.packed = [U32(r) for r in range(len(self.tokens))]
        self.shorter = [next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t in self.tokens]
        self.halves: list[tuple[int, int]] = [(r, r) for r in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.agreed: dict[tuple[int, int], bool] = {}
        for r, t in enumerate(self.tokens):  # in rank order: each token is what two lower ones merge to
            left = self.shorter[r]
            while left >= 0:
                right = ranks.get(t[self.sizes[left] :], r)
                if left < r and right < r and self.undo(left, right):
                    self.halves[r], self.merged[left, right] = (left, right), r
                    break
                left = self.shorter[left]

    def undo(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b stops at [a, b].

        Undo the later of the merges next to the boundary, again and again: had a pair across the
        boundary been available before the merge just undone, it would have been taken first.
        """
        until = 1 << 62
        while True:
            if self.merged.get((a, b), until) < until:
                return False
            split_a, split_b = self.halves[a][1] != a, self.halves[b][0] != b
            if not split_a and not split_b:
                return True
            if split_a and (a > b or not split_b):
                until, a = a, self.halves[a][1]
            else:
                # at equal rank the left-hand merge happens first, so a crossing pair of b's own rank loses to it
                until, b = b + 1, self.halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.agreed) >= MOST_PAIRS:
            self.agreed.clear()
        known = self.agreed[a, b] = self.undo(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes, agreed = len(piece), self.sizes, self.agreed
        # ends ascend, so the last token seen at a start is the longest there
        longest = {end - sizes[r]: r for end, r in self.automaton.iter(piece.decode("latin-1"))}
        out: list[int] = []
        dead: set[int] = set()
        at, before, token = 0, -1, longest[-1]
        while True:
            end = at + sizes[token]
            fits = before < 0 or agreed.get((before, token))
            if fits is None:
                fits = self.compatible(before, token)
            if fits and end not in dead:
                out.append(token)
                if end == n:
                    return out
                at, before, token = end, token, longest[end - 1]
                continue
            token = self.shorter[token]
            while token < 0:  # nothing shorter fits here: step back and shorten the token before
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1
                token = self.shorter[token]


class Pieces(dict):
    """Packed ids of " piece" by piece."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find, self.words = vocabulary, compiled(pattern).findall, {}

    def pack(self, text: str) -> bytes:
        out, words = [], self.words
        for w in self.find(text):
            known = words.get(w)
            if known is None:
                packed = self.vocabulary.packed
                known = b"".join([packed[r] for r in self.vocabulary.encode(w.encode())])
                if len(w) <= LONG:
                    if len(words) >= MOST_PIECES:
                        words.clear()
                    words[w] = known
            out.append(known)
        return b"".join(out)

    def __missing__(self, piece: str) -> bytes:
        packed = self.pack(" " + piece)
        if len(piece) <= LONG:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.pieces = Pieces(self.vocabulary, pattern)
        self.odd = re.compile(rf" (?:[{SPACE}]|\Z)").search
        self.cut = re.compile(rf" (?![{SPACE}]|\Z)").split

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, packed."""
        first, *rest = self.cut(text) if self.odd(text) else text.split(" ")
        return self.pieces.pack(first) + b"".join(map(self.pieces.__getitem__, rest))

    def decode(self, packed: bytes) -> bytes:
        return unpack(self.vocabulary.tokens, packed)

    def forget(self) -> None:
        """Empties what was remembered, so that an idle worker holds the vocabulary only."""
        self.pieces.clear()
        self.pieces.words.clear()
        self.vocabulary.agreed.clear()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def unpack(tokens: list[bytes], packed: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, memoryview(packed).cast("I")))


@cache
def token_table(path: str) -> list[bytes]:
    """Tokens by id, all that decoding needs."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker process; its vocabulary outlives a task, what it remembers does not."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` as ``(doc_id, n_tokens, ids)``; ids is packed little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in sliced(batches, ROWS_OUT):
            ids = [e.encode(t.as_py() or "") for t in b.column("text")]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        e.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table(path)
        for b in sliced(batches, ROWS_OUT):
            decoded = pa.array([unpack(tokens, x.as_py()) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, decoded], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def coded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encode`` and then ``decode``, in one Python worker a task: two would hold two vocabularies a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in sliced(batches, ROWS_OUT):
            ids = [e.encode(t.as_py() or "") for t in b.column("text")]
            n, decoded = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(e.decode, ids), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(ids, pa.binary()), decoded], ["doc_id", "n_tokens", "ids", "decoded"])
        e.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    return coded(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
