"""Finding keys that occur more than once, with answers routed back to blocks of documents.

Documents belong to blocks by a hash of their id. Tasks send the 64-bit keys of
their texts in packed runs, dealt by key: a key once per task and block, so
copies combine before the shuffle, and a key that a task sees in very many
blocks once for all of them. Whoever holds a key's range answers each block with
those of its keys that are repeated; very common ones are answered to all
blocks. Blocks meet their answers and their documents in one shuffle, answers
first, and are read as a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import parts_for, short_batches

#: Text bytes of a block, and blocks whose keys one holder gathers.
BLOCK_BYTES = 4 << 20
BLOCKS_PER_BUCKET = 4
#: Keys a task gathers before it sends them.
FLUSH_KEYS = 1 << 20
#: Blocks beyond which a task sends a key once for all; occurrences beyond which its holder answers to all blocks.
COMMON_BLOCKS = 256
COMMON_ENTRIES = 100_000
ALL, TWICE = 0x7FFFFFFF, 0x80000000
SENT = "bucket int, keys binary, checks binary, blocks binary, twice binary"
ANSWERED = "block int, keys binary"
#: Text bytes that a task gathers before it packs them by block.
PACKED_BYTES = 24 << 20


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return parts_for(total_bytes, block_bytes)


def block_of(blocks: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")


def bucket_count(blocks: int) -> int:
    return parts_for(blocks, BLOCKS_PER_BUCKET)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the leading bytes are mostly zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_blocks(blocks: np.ndarray) -> bytes:
    """One number if all are the same, else one each, in two bytes where they fit."""
    if len(blocks) > 1 and (blocks == blocks[0]).all():
        blocks = blocks[:1]
    return bytes([0]) + blocks.astype(np.uint32).tobytes() if blocks.max() > 0xFFFF else bytes([1]) + blocks.astype(np.uint16).tobytes()


def unpack_blocks(packed: bytes, n: int) -> np.ndarray:
    blocks = np.frombuffer(packed[1:], dtype=np.uint16 if packed[0] else np.uint32).astype(np.uint32)
    return np.repeat(blocks, n) if len(blocks) == 1 else blocks


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    first = np.ones(len(columns[0]), dtype=bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


class Sender:
    """Gathers keys of blocks and packs them for their holders.

    ``checks`` are 32 more bits of each key, or zeros: with the key, 96 bits tell
    strings apart.
    """

    def __init__(self, buckets: int, common: int = COMMON_BLOCKS, flush_keys: int = FLUSH_KEYS, by_block: bool = False):
        # a task that works on few blocks sends each one's keys apart and names it once
        self.buckets, self.common, self.flush_keys, self.by_block = buckets, common, flush_keys, by_block
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, checks: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, checks.astype(np.uint32), blocks.astype(np.uint32)))
        self.n += len(keys)
        if self.n >= self.flush_keys:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, checks, blocks = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.n = [], 0
        bucket = keys % np.uint64(self.buckets)
        order = np.lexsort((blocks, checks, keys, bucket))
        keys, checks, blocks, bucket = keys[order], checks[order], blocks[order], bucket[order]
        at = np.flatnonzero(starts_of_runs(keys, checks, blocks))
        twice = np.diff(np.append(at, len(keys))) > 1
        keys, checks, bucket = keys[at], checks[at], bucket[at]
        blocks = blocks[at] | np.where(twice, np.uint32(TWICE), np.uint32(0))
        of_key = np.flatnonzero(starts_of_runs(keys, checks))
        width = np.diff(np.append(of_key, len(keys)))
        if (width > self.common).any():
            wide = np.repeat(width > self.common, width)
            keep = ~wide
            keep[of_key] = True
            blocks[wide] = ALL | TWICE
            keys, checks, bucket, blocks = keys[keep], checks[keep], bucket[keep], blocks[keep]
        twice = blocks >= TWICE
        blocks &= np.uint32(ALL)
        if self.by_block:
            order = np.lexsort((checks, keys, blocks, bucket))
            keys, checks, bucket, blocks, twice = keys[order], checks[order], bucket[order], blocks[order], twice[order]
        cut = np.append(np.flatnonzero(starts_of_runs(bucket, blocks) if self.by_block else starts_of_runs(bucket)), len(keys))
        plain = not checks.any()
        rows = [(int(bucket[a]), pack_keys(keys[a:b]), None if plain else checks[a:b].tobytes(), pack_blocks(blocks[a:b]),
                 np.packbits(twice[a:b]).tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))],
                                         names=["bucket", "keys", "checks", "blocks", "twice"])


def _answers(parts: list[tuple[bytes, bytes | None, bytes, bytes]], entries: int) -> Iterator[tuple[int, bytes]]:
    each = [unpack_keys(p[0]) for p in parts]
    keys = np.concatenate(each)
    checks = np.concatenate([np.frombuffer(p[1], dtype=np.uint32) if p[1] is not None else np.zeros(len(k), dtype=np.uint32)
                             for k, p in zip(each, parts)])
    blocks = np.concatenate([unpack_blocks(p[2], len(k)) for k, p in zip(each, parts)])
    twice_sent = np.concatenate([np.unpackbits(np.frombuffer(p[3], dtype=np.uint8), count=len(k)) for k, p in zip(each, parts)]).astype(bool)
    order = np.lexsort((checks, keys))
    keys, checks, blocks = keys[order], checks[order], blocks[order]
    at = np.flatnonzero(starts_of_runs(keys, checks))
    width = np.diff(np.append(at, len(keys)))
    twice = np.logical_or.reduceat(twice_sent[order], at)
    repeated = np.repeat((width > 1) | twice, width)
    blocks[np.repeat((width > entries) | np.logical_or.reduceat(blocks == ALL, at), width)] = ALL
    keys, blocks = keys[repeated], blocks[repeated]
    order = np.lexsort((keys, blocks))
    keys, blocks = keys[order], blocks[order]
    cut = np.append(np.flatnonzero(starts_of_runs(blocks)), len(keys))
    for a, b in zip(cut[:-1], cut[1:]):
        yield -1 if blocks[a] == ALL else int(blocks[a]), pack_keys(np.unique(keys[a:b]))


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each value of the first column, which comes sorted."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != current:
                if held:
                    yield current, held
                current, held = row[0], []
            held.append(row[1:])
    if held:
        yield current, held


def repeated(sent: DataFrame, buckets: int, entries: int = COMMON_ENTRIES) -> DataFrame:
    """(block, keys): the repeated ones among each block's keys, in packed runs; block -1 stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in by_group(batches):
            rows = list(_answers(parts, entries))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["block", "keys"])

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWERED)


def packed_texts(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, body): the documents of each block in compressed runs, which take far less of a shuffle than rows."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        block = table.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        cut = np.append(np.flatnonzero(starts_of_runs(block[order])), len(block))
        for a, b in zip(cut[:-1], cut[1:]):
            sink = pa.BufferOutputStream()
            run = table.select([1, 2]).take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(run)
            yield pa.RecordBatch.from_arrays([pa.array([block[order[a]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["block", "body"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACKED_BYTES:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    return docs.select(block_of(blocks).alias("block"), "doc_id", "text").mapInArrow(work, "block int, body binary")


def at_blocks(docs: DataFrame, answers: DataFrame, blocks: int,
              work: Callable[[Iterator[tuple[pa.RecordBatch, list[bytes]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` over (documents, answers) of every block.

    ``docs`` is (doc_id, text), ``answers`` (block, keys). A block's answers come
    before its documents, so only these and one batch of documents are held.
    ``work`` gets batches (block, kind, keys, doc_id, text) of documents with all
    runs of keys of their block, the same list for every batch of a block.
    """
    own = answers.filter("block >= 0").select("block", F.lit(0).alias("kind"), "keys")
    common = (answers.filter("block < 0")
              .select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "keys"))
    short_batches(docs.sparkSession)
    texts = packed_texts(docs, blocks).select("block", F.lit(1).alias("kind"), F.col("body").alias("keys"))
    together = own.unionByName(common).unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        current, got = None, []
        for batch in batches:
            for block, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block != current:
                    current, got = block, []
                if kind == 0:
                    got.append(body.as_py())
                    continue
                run = pa.ipc.open_stream(body.as_buffer()).read_all().combine_chunks()
                n = run.num_rows
                if n:
                    columns = [c.chunk(0) for c in run.columns]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int32()), pa.array(np.ones(n), pa.int32()), pa.nulls(n, pa.binary()),
                                                      *columns], names=["block", "kind", "keys", "doc_id", "text"]), got

    return together.mapInArrow(lambda batches: work(pieces(batches)), schema)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Known:
    """The sorted keys of the block at hand, made once per block."""

    def __init__(self):
        self.of, self.keys = None, None

    def __call__(self, got: list[bytes]) -> np.ndarray:
        if got is not self.of:
            self.of, self.keys = got, np.unique(np.concatenate([unpack_keys(g) for g in got]) if got else np.zeros(0, dtype=np.uint64))
        return self.keys
