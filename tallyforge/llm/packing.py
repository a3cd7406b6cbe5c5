"""Packing token sequences by bounded-space online best fit.

A task keeps a fixed number of open bins. Their free space is a bitset, one bit
for each possible amount, so the tightest bin that still takes a piece is found
by a shift and a lowest set bit. When all bins are open and none fits, the
fullest is closed.

Texts are tokenised where they are scanned; only each piece's place, length and
checksum go on, a few dozen bytes a piece, and are written once. Packing reads
these in id order within hashed parts of ``part_pieces`` pieces, so a lost
executor repeats the same bins.

Defined cases: a null or empty text is one piece with only the closing token; a
null id packs like any other; rows with the same id are packed separately and
their pieces numbered alike.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import id_and_text, parts_for
from tallyforge.session import settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
BATCH_TEXTS = 64
CACHED_CHUNKS = 1_000_000
END_OF_WORD = "</w>"
#: White space to str.split, but not to the tokenizer.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: ASCII punctuation that never forms a pre-token with letters; the apostrophe does.
PUNCTUATION = "".join(c for c in string.punctuation if c != "'")
#: Below this code point lower-casing a word alone equals lower-casing it in its text.
PLAIN = "\u0250"


class ChunkTokens:
    """Ids of space-separated chunks, encoded once each and kept while ``limit`` allows.

    The vocabulary's pre-tokenizer never joins characters across white space and
    splits letters from punctuation, so a text's ids are those of its chunks in
    turn, and a chunk of letters with ASCII punctuation behind is its two halves
    in turn. Every pre-token's last id stands for a token with the end-of-word
    mark, which tells a batch of words apart again. A full cache starts anew.
    """

    def __init__(self, tokenizer, limit: int = CACHED_CHUNKS):
        self.tokenizer, self.limit = tokenizer, limit
        self.known: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts."""
        get = self.known.get
        split = [t.split() if not any(c in t for c in NOT_SPACE) else None for t in texts]
        found = [list(map(get, chunks or ())) for chunks in split]
        missing = {c for chunks, f in zip(split, found) if None in f for c, x in zip(chunks, f) if x is None}
        if missing:
            self._learn(missing)
            found = [list(map(get, chunks)) if None in f else f for chunks, f in zip(split, found)]
            if len(self.known) > self.limit:
                self.known.clear()
        return [b"".join(f) if chunks is not None else self._encoded(t) for t, chunks, f in zip(texts, split, found)]

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        known, halves, whole = self.known, [], []
        for c in chunks:
            core = c.rstrip(PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < PLAIN):
                halves.append((c, core.lower(), c[len(core):]))
            else:
                whole.append(c)
        new = list({core for _, core, _ in halves if core not in known})
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(new):
                raise ValueError("the vocabulary does not mark the end of every word")
            raw = ids.tobytes()
            known.update(zip(new, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        for c in {tail for _, _, tail in halves}.union(whole):
            if c not in known:
                known[c] = self._encoded(c)
        for c, core, tail in halves:
            known[c] = known[core] + known[tail]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a document's ids, cut only beyond ``capacity``."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at:at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text, without the ids themselves."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = ChunkTokens(Tokenizer.from_file(tokenizer_path))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                rows = [(d, *p) for d, ids in zip(part.column(0).to_pylist(), tokens.ids(part.column(1).to_pylist()))
                        for p in pieces_of(ids + end, capacity)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


class OpenBins:
    """At most ``limit`` open bins; ``place`` returns (bin, offset) for a piece of ``need`` tokens."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits = 0                      # bit f is set if a bin with f free tokens is open
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def place(self, need: int) -> tuple[int, int]:
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.limit:    # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            found, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - need
        if left:
            self.by_free[left].append(found)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return found, self.capacity - free


def packed(pieces: DataFrame, capacity: int = 2048, open_bins: int = 4096, part_pieces: int = 1_000_000) -> DataFrame:
    """Each piece with its sequence and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    n = parts_for(pieces.count(), part_pieces)
    # documents in hashed order, so that no part is biased towards one source or length
    dealt = pieces.repartition(n, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id", "piece", "start", "length", "ids_crc32")
    return dealt.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   open_bins: int = 4096, part_pieces: int = 1_000_000, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "token-pieces")
    return packed(pieces, capacity, open_bins, part_pieces)
