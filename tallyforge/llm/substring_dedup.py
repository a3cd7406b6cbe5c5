"""Removal of repeated word windows by difference-cover anchors.

A window of ``window`` words is repeated if the same words also start anywhere
else. The positions of a difference cover modulo ``PERIOD`` hold, for every
distance, two positions that far apart; so two equal windows, wherever they
start, share an anchor at covered positions of both within their first
``PERIOD`` words. Only anchors are exchanged at first; only windows around
repeated anchors are then extended to their full length and exchanged by a
96-bit key. Words of repeated windows are removed.

Both exchanges combine equal keys per task and block first (see ``exchange``),
so a passage that a third of all documents share costs each task one row.

Defined cases: null and empty texts have no words; texts shorter than a window
lose none; rows repeating an id are separate documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import exchange as X
from tallyforge.llm import text_keys as K
from tallyforge.llm.columns import id_and_text, text_bytes
from tallyforge.session import settle

WINDOW = 35
#: {0, 1, 4, 14, 16} holds every distance modulo 21 exactly once.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_COVERED = np.isin(np.arange(PERIOD), COVER)


def anchors(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered positions with room for an anchor of ``length`` words, and the texts they are in."""
    at = np.arange(len(words))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[text + 1] - at >= length
    at, text = at[room], text[room]
    covered = _COVERED[(at - bounds[text]) % PERIOD]
    return at[covered], text[covered]


def window_starts(words: np.ndarray, bounds: np.ndarray, window: int, length: int, known: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor within their first PERIOD words."""
    at, _ = anchors(words, bounds, length)
    hit = at[X.among(K.range_codes(words, at, at + length), known)]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(edge, hit + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    text = np.searchsorted(bounds, starts, side="right") - 1
    return starts[bounds[text + 1] - starts >= window]


def _words(column: pa.Array) -> Iterator[tuple]:
    for first, data, offsets in K.text_buffers(column):
        starts, ends, bounds = K.words(data, offsets)
        yield first, data, offsets, starts, ends, bounds, K.word_codes(data, starts, ends)


def kept_bytes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray,
               kept: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    to = np.minimum(ends + 1, offsets[text + 1])          # with the character that follows the word
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[kept]] += 1
    np.add.at(edge, to[kept], -1)
    taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
    spaced = data.copy()
    spaced[ends[ends < offsets[text + 1]]] = 0x20
    out = spaced[taken].tobytes()
    cut = np.concatenate([[0], np.cumsum(taken)])[offsets]
    return [out[a:b].rstrip(b" ") for a, b in zip(cut[:-1], cut[1:])]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True, block_bytes: int = X.BLOCK_BYTES, common: int = X.COMMON_BLOCKS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless asked for) of every row."""
    length = window - PERIOD + 1
    if length < 1:
        raise ValueError(f"windows shorter than {PERIOD} words need a smaller period")
    rows = id_and_text(docs, id_col, text_col)
    blocks = X.block_count(text_bytes(rows, "text"), block_bytes)
    buckets = X.bucket_count(blocks)
    none = lambda keys: np.zeros(len(keys), dtype=np.uint64)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = X.Sender(buckets, common)
        for batch in batches:
            block = batch.column(0).to_numpy()
            for first, _, _, _, _, bounds, words in _words(batch.column(1)):
                at, text = anchors(words, bounds, length)
                keys = K.range_codes(words, at, at + length)
                yield from sender.add(keys, none(keys), block[first + text])
        yield from sender.flush()

    def send_windows(pieces) -> Iterator[pa.RecordBatch]:
        sender, sorted_keys = X.Sender(buckets, common, by_block=True), X.Known()
        for part, got in pieces:
            known = sorted_keys(got)
            block = part.column(0).to_numpy()
            for first, data, _, starts, ends, bounds, words in _words(part.column(4)):
                at = window_starts(words, bounds, window, length, known)
                if len(at):
                    second = K.word_codes(data, starts, ends, which=1)
                    text = np.searchsorted(bounds, at, side="right") - 1
                    yield from sender.add(K.range_codes(words, at, at + window), K.range_codes(second, at, at + window, which=1) >> np.uint64(32), block[first + text])
        yield from sender.flush()

    def cut(pieces) -> Iterator[pa.RecordBatch]:
        sorted_keys = X.Known()
        for part, got in pieces:
            known = sorted_keys(got)
            for first, data, offsets, starts, ends, bounds, words in _words(part.column(4)):
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                at = np.arange(len(words))
                at = at[bounds[text + 1] - at >= window]
                hit = at[X.among(K.range_codes(words, at, at + window), known)]
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[hit] += 1
                np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
                kept = kept_bytes(data, offsets, starts, ends, bounds, ~gone)
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).slice(first, len(kept)), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                     pa.array([k.decode("utf-8", "replace") for k in kept] if with_text else [None] * len(kept), pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    dealt = rows.select(X.block_of(blocks).alias("block"), "text").mapInArrow(send_anchors, X.SENT)
    repeated_anchors = settle(X.repeated(dealt, buckets), "repeated-anchors")
    windows = X.at_blocks(rows, repeated_anchors, blocks, send_windows, X.SENT)
    repeated_windows = settle(X.repeated(windows, buckets), "repeated-windows")
    return X.at_blocks(rows, repeated_windows, blocks, cut, RESULT)
