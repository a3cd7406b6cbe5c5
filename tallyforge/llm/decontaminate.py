"""Benchmark passages in documents, by CGK embedding and exact edit verification.

An item is found in a document if some window of the document is within
``max_edits`` (a share of the item's words) word insertions, deletions and
substitutions of it. Words are lower-cased runs of letters and digits, so
punctuation, tables and line breaks between them do not matter; in scripts
without spaces every character is a word.

The CGK embedding walks over a word sequence, writing the current word and
moving on or not by a random bit of step and word. Two sequences a few edits
apart fall back into step soon, so their walks differ in few places: edit
distance becomes Hamming distance. A table samples a few places of one walk as
its key; ``WALKS`` x ``SAMPLES`` tables together reach the target recall. Walks
go on for two steps a word, so they use the item up, and start at its first
word as well as, backwards, at its last; the places of a table lie within a
beginning of the walk of its own scale, from all of it down to ``LEAST_STEPS``
steps, so edits may be spread or lie together anywhere. One walk from a
window's start serves all windows that start there.

Windows that share too few word pairs with all items are not walked: with k
edits an item of n words keeps n-1-2k of its word pairs, so this drops none that
could match. Candidates are confirmed with the exact edit distance.

The benchmark is read in chunks of ``items_per_pass`` items, whatever its size;
a chunk's tables go to every task, the documents are never shuffled.

Items below ``MIN_WORDS`` words allow no edit at the default share; they are
looked up as they are, whatever the share, by a key of the whole item.

Defined cases: null or empty texts hold nothing, and items without words match
nothing; rows repeating an id or item are
reported once for each pair of rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import text_keys as K
from tallyforge.llm.columns import col, parts_for, short_batches

MIN_WORDS = 5
MAX_EDITS = 0.2
#: Tables in each direction, and the least beginning of a walk that a table samples.
WALKS, SAMPLES, PLACES, LEAST_STEPS = 10, 6, 4, 6
STEPS_PER_WORD = 2
#: Bytes of texts searched at once; few windows are walked, so short runs would cost more in calls than in work.
RUN_BYTES = 4 << 20
#: Items of one size class differ in length by this factor at most.
CLASS_FACTOR = 1.25
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han and its compatibility and further planes: firsts and ends.
UNSPACED = np.array([0x0E00, 0x10A0, 0x1780, 0x1800, 0x3005, 0x3008, 0x3040, 0x3100, 0x31F0, 0x3200, 0x3400, 0x4DC0,
                     0x4E00, 0xA000, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1B000, 0x1B170, 0x20000, 0x32000])
FOUND = "doc_id long, item_id long, start_word long, n_words long, item_words long, edits long"
_SEED = 20100


def edit_distance(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int]:
    """(edits, end): the least distance of the item to a prefix of ``text`` and the shortest such prefix; beyond ``limit`` any.

    Bit-parallel: the item's words are bits of one number.
    """
    n = len(item)
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item.tolist()):
        places[w] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text[:n + limit].tolist(), 1):
        same = places.get(w, 0)
        x = same | down
        d = (((same & up) + up) ^ up) | same
        right_up, right_down = (down | ~(d | up)) & full, up & d
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up, down = (right_down | ~(x | right_up)) & full, right_up & x
        if score < best:
            best, end = score, j
    return best, end


class Walks:
    """Random bits and sampled places of all walks of a size class, from fixed seeds."""

    def __init__(self, steps: int):
        rng = np.random.default_rng(_SEED + steps)
        self.steps = steps
        self.seeds = rng.integers(1, 2**63, (WALKS, steps), dtype=np.uint64)
        scale = np.log(max(1.0, steps / LEAST_STEPS))
        lengths = np.maximum(PLACES, steps * np.exp(-rng.uniform(0, scale, (WALKS, SAMPLES)))).astype(np.int64)
        self.places = [[np.sort(rng.choice(n, PLACES, replace=False)) for n in row] for row in lengths.tolist()]

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """For every table the key of the walk from each start; past the end a walk writes nothing."""
        for walk in range(WALKS):
            at = starts.copy()
            written = np.empty((self.steps, len(starts)), dtype=np.uint64)
            for step in range(1 + max(int(sample[-1]) for sample in self.places[walk])):
                inside = at < ends
                word = np.where(inside, words[np.minimum(at, len(words) - 1)], np.uint64(0))
                written[step] = word
                at += ((word * self.seeds[walk, step]) >> np.uint64(62) & np.uint64(1)).astype(np.int64)
            for sample in self.places[walk]:
                key = np.full(len(starts), len(sample), dtype=np.uint64)
                for p in sample:
                    key = K.mixed(key ^ written[p]) * np.uint64(0x9E3779B97F4A7C15)
                yield key


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``text_keys.words``; characters of scripts without spaces are words of their own."""
    starts, ends, bounds = K.words(data, offsets, K.NOT_ALNUM)
    at = np.flatnonzero(data >= 0xE0)                      # first bytes of three or four
    if not len(at):
        return starts, ends, bounds
    b = [data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 0x3F for i in range(4)]
    four = data[at] >= 0xF0
    points = np.where(four, (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2])
    alone = np.searchsorted(UNSPACED, points, side="right") % 2 == 1
    cuts = np.unique(np.concatenate([at[alone], at[alone] + np.where(four[alone], 4, 3)]))
    word = np.searchsorted(starts, cuts, side="right") - 1
    cuts = cuts[(word >= 0) & (cuts > starts[word]) & (cuts < ends[word])]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def item_words(texts: list[str]) -> list[np.ndarray]:
    column = pa.array([t.lower() for t in texts], pa.string())
    out: list[np.ndarray] = []
    for _, data, offsets in K.text_buffers(column):
        starts, ends, bounds = word_bounds(data, offsets)
        codes = K.word_codes(data, starts, ends)
        out += [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of n words, by its start."""
    count = max(0, len(words) - n + 1)
    keys = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        keys = K.mixed(keys ^ words[i:i + count]) * np.uint64(0x9E3779B97F4A7C15)
    return keys


class Index:
    """Tables over the items of one pass, by size class."""

    def __init__(self, items: list[tuple[int, np.ndarray]], max_edits: float):
        # the short ones come last
        self.items = sorted(((i, w) for i, w in items if len(w)), key=lambda r: len(r[1]) < MIN_WORDS)
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(1, MIN_WORDS):
            members = np.array([m for m, (_, w) in enumerate(self.items) if len(w) == n], dtype=np.int64)
            if len(members):
                keys = np.concatenate([run_keys(self.items[m][1], n) for m in members])
                order = np.argsort(keys, kind="stable")
                self.short.append((n, keys[order], members[order]))
        long_items = [w for _, w in self.items if len(w) >= MIN_WORDS]
        self.limits = [int(max_edits * len(w)) for w in long_items]
        self.pairs_of = [self.pairs(w).tolist() for w in long_items]
        by_class: dict[int, list[int]] = defaultdict(list)
        for at, w in enumerate(long_items):
            by_class[int(np.log(len(w)) / np.log(CLASS_FACTOR))].append(at)
        # every word pair of the items with the classes that have it, a bit each
        pairs = [(self.pairs(long_items[m]), c) for c, members in enumerate(by_class.values()) for m in members]
        self.known_pairs, place = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True) if pairs else (
            np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.pair_classes = np.zeros(len(self.known_pairs), dtype=np.uint64)
        np.bitwise_or.at(self.pair_classes, place, np.repeat(
            np.array([1 << c for _, c in pairs], dtype=np.uint64), [len(p) for p, _ in pairs]))
        self.classes = []
        for members in by_class.values():
            lengths = [len(self.items[m][1]) for m in members]
            low = min(lengths)
            # word pairs of this class that the first ``low`` words of any match keep; none at very large shares of edits
            kept = max(0, low - 1 - 2 * max(self.limits[m] for m in members))
            walks = Walks(STEPS_PER_WORD * low)
            ends = np.cumsum(lengths)
            ways = []
            for way in (1, -1):
                flat = np.concatenate([self.items[m][1][::way] for m in members])
                tables = []
                for keys in walks.keys(flat, ends - lengths, ends):
                    order = np.argsort(keys, kind="stable")
                    tables.append((keys[order], np.array(members, dtype=np.int32)[order]))
                ways.append(tables)
            self.classes.append((low, kept, walks, ways))

    @staticmethod
    def pairs(words: np.ndarray) -> np.ndarray:
        return K.mixed(words[:-1] * np.uint64(3) + words[1:])

    def candidates(self, words: np.ndarray, bounds: np.ndarray, way: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of all windows that share a key with an item, each once; -1: words, bounds and windows run backwards."""
        found = []
        if not len(words) or not self.classes:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pairs = self.pairs(words[::way])[::way]
        at = np.minimum(np.searchsorted(self.known_pairs, pairs), len(self.known_pairs) - 1)
        classes_of = np.where(self.known_pairs[at] == pairs, self.pair_classes[at], np.uint64(0))
        text_of = np.searchsorted(bounds, np.arange(len(words)), side="right") - 1
        stops = bounds[text_of + 1]
        begin = np.arange(len(words))
        for c, (low, kept, walks, ways) in enumerate(self.classes):
            hits = np.concatenate([[0], np.cumsum(classes_of >> np.uint64(c) & np.uint64(1), dtype=np.int64)])
            # a match that loses words is shorter than the item: its pairs lie within the first low-1 ones all the same
            starts = np.flatnonzero(hits[np.minimum(begin + low - 1, len(pairs))] - hits[np.minimum(begin, len(pairs))] >= kept)
            if not len(starts):
                continue
            for keys, (table, members) in zip(walks.keys(words, starts, stops[starts]), ways[way < 0]):
                a, b = np.searchsorted(table, keys, side="left"), np.searchsorted(table, keys, side="right")
                if (n := b - a).any():
                    found.append(np.stack([np.repeat(starts, n), members[np.repeat(a, n) + K.ranges(n)]]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        start, item = np.unique(np.concatenate(found, axis=1), axis=1)
        return start, item

    def likely(self, m: int, pairs: np.ndarray) -> bool:
        """Whether a window with these word pairs keeps as many of the item's as any match does."""
        there, own = set(pairs.tolist()), self.pairs_of[m]
        return sum(p in there for p in own) >= len(own) - 2 * self.limits[m]

    def short_matches(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """As ``matches``, the first place of each short item in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, table, members in self.short:
            keys = run_keys(words, n)
            a, b = np.searchsorted(table, keys, side="left"), np.searchsorted(table, keys, side="right")
            starts = np.flatnonzero(b > a)
            texts = np.searchsorted(bounds, starts, side="right") - 1
            within = starts + n <= bounds[texts + 1]
            starts, texts = starts[within], texts[within]
            # equal items share a run of the table; its first stands for all of them
            _, first = np.unique(np.stack([texts, a[starts]]), axis=1, return_index=True)
            for start, text in zip(starts[first].tolist(), texts[first].tolist()):
                for m in members[a[start]:b[start]].tolist():
                    best[text, m] = (0, start - int(bounds[text]), n)
        return best

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) to (edits, start, words) of its best window."""
        best = self.short_matches(words, bounds)
        pairs = self.pairs(words)
        candidates = set(zip(*(c.tolist() for c in self.candidates(words, bounds))))
        # what is found from an item's end gives the start that fits it best
        back, turned = words[::-1], len(words) - bounds[::-1]
        for last, m in zip(*(c.tolist() for c in self.candidates(back, turned, -1))):
            stop = int(turned[np.searchsorted(turned, last, side="right")])
            reach = min(stop, last + len(self.items[m][1]) + self.limits[m])
            if not self.likely(m, pairs[len(words) - reach:len(words) - last - 1]):
                continue
            edits, n = edit_distance(self.items[m][1][::-1], back[last:stop], self.limits[m])
            if edits <= self.limits[m] and n:
                candidates.add((len(words) - last - n, m))
        for start, m in sorted(candidates):
            text = int(np.searchsorted(bounds, start, side="right")) - 1
            reach = min(int(bounds[text + 1]), start + len(self.items[m][1]) + self.limits[m])
            if not self.likely(m, pairs[start:reach - 1]):
                continue
            edits, end = edit_distance(self.items[m][1], words[start:bounds[text + 1]], self.limits[m])
            if edits <= self.limits[m]:
                found = (edits, start - int(bounds[text]), end)
                best[text, m] = min(best.get((text, m), found), found)
        return best


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_edits: float = MAX_EDITS,
            items_per_pass: int = 20_000) -> Iterator[Index]:
    """One index for every chunk of the benchmark; no chunk's size grows with the benchmark."""
    rows = benchmark.select(col(id_col).cast("long").alias("item_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    chunks = parts_for(rows.count(), items_per_pass)
    for chunk in range(chunks):
        taken = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect()
        taken.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        yield Index(list(zip([r["item_id"] for r in taken], item_words([r["text"] for r in taken]))), max_edits)


def _text_words(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in K.text_buffers(batch_column, RUN_BYTES):
        starts, ends, bounds = word_bounds(data, offsets)
        yield first, K.word_codes(data, starts, ends), bounds


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS,
               items_per_pass: int = 20_000) -> DataFrame:
    """Per document and item found in it: the best window (start_word, n_words), item_words and edits."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(col(text_col), F.lit(""))).alias("text"))
    short_batches(docs.sparkSession)
    found = docs.sparkSession.createDataFrame([], FOUND)
    for index in indexes(benchmark, item_col, item_text_col, max_edits, items_per_pass):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = []
                for first, words, bounds in _text_words(batch.column(1)):
                    out += [(ids[first + t], index.items[m][0], start, n, len(index.items[m][1]), edits)
                            for (t, m), (edits, start, n) in index.matches(words, bounds).items()]
                names = [f.split()[0] for f in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 6)], names=names)

        found = found.union(rows.mapInArrow(run, FOUND))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", max_edits: float = MAX_EDITS, items_per_pass: int = 20_000) -> DataFrame:
    """The rows without any item, columns unchanged; texts are judged where they are scanned."""
    kept, schema = docs, docs.schema
    short_batches(docs.sparkSession)
    at = schema.names.index(text_col)
    for index in indexes(benchmark, item_col, item_text_col, max_edits, items_per_pass):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                lowered = pa.array([(t or "").lower() for t in batch.column(at).to_pylist()], pa.string())
                for first, words, bounds in _text_words(lowered):
                    for text, _ in index.matches(words, bounds):
                        clean[first + text] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, schema)
    return kept
