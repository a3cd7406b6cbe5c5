"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

A text's set is its distinct word shingles. Its minima make band keys; of the
minima themselves only the low ``BITS`` bits are kept, packed. Texts sharing a
band key are candidates of one group (each is tied to the bucket's smallest id,
so a bucket of n texts costs n rows, and groups are the components of these
ties). Within a group the packed signatures are compared by bit counts,
corrected for chance collisions, and pairs that may reach the threshold are
confirmed on their full sets. Only links that join two parts of a group leave a
task, so a group of n texts never emits more than n rows for each of its parts.

A group larger than a part is split into blocks; every pair of blocks is a part
of its own, so no task holds a large group and no pair is left out. The
number of blocks grows with the square root of the group.

Copies of a word sequence stand for one another and cost one row. Defined
cases: with fewer words than a shingle the whole sequence is the one shingle;
without words a text has an empty set and no links; a null id has no links;
rows repeating an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text_keys as K
from tallyforge.llm.columns import HOT_LEAST, hot_floor, id_and_text, join_groups
from tallyforge.llm.components import components
from tallyforge.session import settle

#: 40 bands of 6: at similarity 0.8 a pair misses every band with probability 5e-6.
BANDS, ROWS = 40, 6
BITS = 4
WORDS, SIMILARITY = 5, 0.8
#: Standard deviations that the signature estimate may lie below the threshold.
SLACK = 6.0
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "doc_id long, n_shingles long, seq_hi long, seq_lo long, bands array<long>, bits binary"


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of a text's k-word shingles."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    at = np.arange(n - size + 1)
    # a shorter sequence never equals a full shingle
    return np.unique(K.mixed(K.range_codes(words, at, at + size) ^ np.uint64(size)))


def minima(keys: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(keys), 2048):
        np.minimum(best, (keys[at:at + 2048, None] * _MULTIPLIERS).min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """One key per band, from the whole minima."""
    mixed = K.mixed(best).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = K.mixed(key ^ mixed[:, j])
    return key


def low_bits(best: np.ndarray) -> bytes:
    """The low BITS (4) bits of every minimum, two to a byte."""
    low = (K.mixed(best) & np.uint64(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


_NIBBLES_EQUAL = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], dtype=np.uint8)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature to many."""
    chance = 2.0 ** -BITS
    equal = _NIBBLES_EQUAL[one ^ many].sum(axis=-1, dtype=np.int64) / (BANDS * ROWS)
    return (equal - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    chance, n = 2.0 ** -BITS, BANDS * ROWS
    p = similarity + (1 - similarity) * chance
    return similarity - SLACK * (p * (1 - p) / n) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """Set size, word-sequence key, band keys and packed bits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in K.text_buffers(batch.column(1)):
                starts, ends, bounds = K.words(data, offsets)
                words = K.word_codes(data, starts, ends, lower=True)
                hi, lo = K.sequence_codes(words, bounds)
                sizes, bands, bits = [], [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    keys = shingles(words[a:b], k)
                    best = minima(keys)
                    sizes.append(len(keys))
                    bands.append(band_keys(best).view(np.int64) if len(keys) else np.zeros(0, dtype=np.int64))
                    bits.append(low_bits(best))
                n = len(sizes)
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(bands) if bands else [], pa.int64())),
                     pa.array(bits, pa.binary())],
                    names=["doc_id", "n_shingles", "seq_hi", "seq_lo", "bands", "bits"])

    return id_and_text(docs, "doc_id", "text").mapInArrow(run, SIGNED)


class Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                return up
            up = self.up = nxt


def overlap_with(one: np.ndarray, columns: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of one set with all: ``columns`` are all keys sorted, ``members`` whose they are."""
    at = np.searchsorted(columns, one, side="left")
    to = np.searchsorted(columns, one, side="right")
    return np.bincount(members[np.repeat(at, to - at) + K.ranges(to - at)], minlength=n)


def forest(ids: np.ndarray, sets: list[np.ndarray], bits: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Confirmed links that join the components of one part."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    members = np.repeat(np.arange(n), sizes)
    keys = np.concatenate(sets)
    order = np.argsort(keys, kind="stable")
    columns, members = keys[order], members[order]
    least, percent = least_estimate(similarity), round(similarity * 100)
    parts, links = Parts(n), []
    # sets near to most others first, so that parts grow early and later pairs are settled
    nearness = [float(estimates(bits[i], bits[:: max(1, n // 64)]).sum()) for i in range(n)] if n > 2 else [0.0] * n
    for i in sorted(range(n), key=lambda i: -nearness[i]):
        roots = parts.roots()
        open_ = (roots != roots[i]) & (np.minimum(sizes, sizes[i]) * 100 >= percent * np.maximum(sizes, sizes[i]))
        at = np.flatnonzero(open_)
        at = at[estimates(bits[i], bits[at]) >= least] if len(at) else at
        if not len(at):
            continue
        shared = (overlap_with(sets[i], columns, members, n)[at] if len(at) > 8 else
                  np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in at]))
        for j in at[100 * shared >= percent * (sizes[at] + sizes[i] - shared)]:
            a, b = parts.find(i), parts.find(int(j))
            if a != b:
                parts.up[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
    return links


def confirmed(members: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (a, b) within the parts of ``members`` (part, doc_id, bits, text), one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            links = forest(np.array([h[0] for h in held]), [h[1] for h in held],
                           np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint8).reshape(len(held), -1), similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys, ids, bits = (batch.column(c).to_pylist() for c in range(3))
            for first, data, offsets in K.text_buffers(batch.column(3)):
                starts, ends, bounds = K.words(data, offsets)
                words = K.word_codes(data, starts, ends, lower=True)
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), first):
                    if keys[i] != part:
                        if held:
                            yield done()
                        part, held = keys[i], []
                    held.append((ids[i], shingles(words[a:b], k), bits[i]))
        if held:
            yield done()

    return members.sortWithinPartitions("part").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                    similarity: float = SIMILARITY, block: int = 256, least: int = HOT_LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Sequences, buckets and nodes that hold a sizeable share of all rows, and ``least`` at least, are joined without dealing them to one task.
    """
    rows = id_and_text(docs, id_col, text_col)
    signed = settle(signatures(rows, k), "signatures")
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # copies of a word sequence: the smallest id stands for all of them
    sequences = settle(linkable.groupBy("seq_hi", "seq_lo").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "sequences")
    total = signed.count()
    classes = (linkable.select("doc_id", "n_shingles", "bands", "bits", "seq_hi", "seq_lo")
               .join(sequences.select(F.col("class_id").alias("doc_id"), "seq_hi", "seq_lo"), ["doc_id", "seq_hi", "seq_lo"], "left_semi"))
    in_band = classes.select("doc_id", F.explode("bands").alias("key"))
    buckets = settle(in_band.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
                     .filter("first != last").select("key", "first", "n"), "buckets")
    ties = join_groups(in_band, buckets, ["key"], hot_floor(total * BANDS, least=least)).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    groups = settle(components(ties, least), "candidate-groups")

    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # one part for a group within ``block``; beyond, parts and copies of a text both grow with the square root of the group
    split = sizes.select("component", F.when(F.col("n") <= block, 1).otherwise(F.ceil(3 * F.sqrt(F.col("n") / block))).cast("int").alias("blocks"))
    placed = (groups.join(split, "component")
              .join(classes.select(F.col("doc_id").alias("id"), "bits").dropDuplicates(["id"]), "id")
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    texts = rows.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id").join(placed, "id")
    # a text goes to every pair of blocks that has its own
    dealt = (texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("part"),
                     F.col("id").alias("doc_id"), "bits", "text"))
    links = confirmed(dealt.repartition("part"), k, similarity)
    found = settle(components(links, least), "components").withColumnRenamed("id", "class_id")

    # a class has its component before it meets its rows, which pass one join only
    placed_classes = sequences.join(found, "class_id", "left").select("seq_hi", "seq_lo", "class_id", "component", "n")
    linked = F.col("n_shingles") > 0
    of_row = (join_groups(signed, placed_classes, ["seq_hi", "seq_lo"], hot_floor(total, least=least), "left")
              .withColumns({c: F.when(linked & F.col("doc_id").isNotNull(), F.col(c)) for c in ("class_id", "component")}))
    component = F.coalesce("component", "class_id", "doc_id")
    return of_row.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
