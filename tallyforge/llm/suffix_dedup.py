"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

Every byte that a ``LENGTH``-byte string covers is removed if the string also
starts earlier (smaller id, or earlier in the same text). Suffixes are sampled
by minimizers: of the ``SPAN`` k-mers of every such string the least by hash,
leftmost of equals, is its anchor, so equal strings have the same anchor at the
same place. Anchors whose k-mer never repeats are dropped by an exchange of
keys. The others travel with the bytes around them, as far as a string through
the anchor can reach, equal surroundings once per task, and meet by k-mer.

There the suffixes from the anchors, and the reversed prefixes to their left,
are sorted: multikey quicksort on 8-byte symbols to a shallow depth, then a
blind trie for every group that still shares its prefix. The common prefix
lengths of neighbours give, for each way to split a string around the anchor,
who shares both sides; all but the earliest are covered.

A k-mer that is too common for one task is not gathered: strings around it are
compared by 128-bit keys in a partial aggregate instead, which combines equal
strings before the shuffle.

Texts of any length are searched in stretches; a worker holds a text's bytes a few times over, besides its repeats.

Defined cases: null and empty texts have no bytes; rows repeating an id count as
the same place; a null id counts as the smallest; matches never cross texts.
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
from tallyforge.llm.columns import hot_floor, id_and_text, join_groups, text_bytes
from tallyforge.session import settle

LENGTH = 100
SPAN = 65
KMER = LENGTH - SPAN + 1
LEFT = SPAN - 1
#: String starts hashed at once.
STRETCH = K.CHUNK_BYTES
#: Bytes behind the k-mer that the shallow sort looks at, before tries take over.
SHALLOW = 16
#: Surroundings a task gathers before it packs them.
GATHER_ROWS = 50_000
GATHERED = ("bucket int, keys binary, hi binary, lo binary, doc binary, pos binary, sides binary, around binary, "
            "pair_class binary, pair_block binary")
WINDOWS = "hi long, lo long, block int, doc_id long, start long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_PLACE = np.uint64((1 << 28) - 1)
_CLASS = np.dtype([("hi", "<u8"), ("doc", "<i8"), ("pos", "<i8"), ("left", "<i2"), ("right", "<i2")])
_STRING = np.dtype([("doc", "<i8"), ("start", "<i8")])
NO_ID = np.iinfo(np.int64).min


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the minimizers of all strings of LENGTH bytes within texts, rising, and their k-mers' keys.

    They come for a stretch of string starts at a time, so that a text of any size takes little more than its bytes.
    """
    last = -1
    for begin in range(0, len(data) - LENGTH + 1, STRETCH):
        part = data[begin:begin + STRETCH + LENGTH - 1]
        at = np.arange(len(part) - KMER + 1)
        keys = K.range_codes(K.byte_codes(part), at, at + KMER)
        least = (keys & ~_PLACE) | at.astype(np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN - width
        least = np.minimum(least[:len(least) - rest], least[rest:])
        starts = np.arange(begin, begin + len(part) - LENGTH + 1)
        text = np.searchsorted(offsets, starts, side="right") - 1
        inside = offsets[text + 1] - starts >= LENGTH
        chosen = np.unique((least[:len(starts)][inside] & _PLACE).astype(np.int64))
        # the minimizers of later strings never lie before those of earlier ones
        chosen = chosen[chosen + begin > last]
        if len(chosen):
            last = begin + int(chosen[-1])
            yield chosen + begin, keys[chosen]


class Surroundings:
    """Anchors of one stretch, at least one, with their reach to both sides and a 128-bit key of all bytes in reach."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray):
        self.at, self.text = at, np.searchsorted(offsets, at, side="right") - 1
        self.left = np.minimum(at - offsets[self.text], LEFT)
        self.right = np.minimum(offsets[self.text + 1] - at, LENGTH)
        sides = (self.left * 256 + self.right).astype(np.uint64)
        low, high = max(0, int(at[0]) - LEFT), int(at[-1]) + LENGTH
        begin, end = at - self.left - low, at + self.right - low
        self.hi, self.lo = (K.mixed(K.range_codes(K.byte_codes(data[low:high], which), begin, end, which) + sides) for which in (0, 1))

    def rows(self, data: np.ndarray) -> np.ndarray:
        """The bytes around each anchor, zeros beyond its reach."""
        columns = np.arange(LEFT + LENGTH) - LEFT
        found = data[np.clip(self.at[:, None] + columns, 0, len(data) - 1)]
        found[(columns < -self.left[:, None]) | (columns >= self.right[:, None])] = 0
        return found


def runs(begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes that ranges of texts cover; runs of different texts stay apart."""
    order = np.argsort(begin, kind="stable")
    begin, end, text = begin[order], np.maximum.accumulate(end[order]), text[order]
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] > end[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(first) else end, text[first]


def common_prefix(a: int, b: int, size: int) -> int:
    """Equal leading bytes of two numbers of ``size`` bytes."""
    return size - (((a ^ b).bit_length() + 7) >> 3)


def trie_sorted(items: list[int], values: list[int], size: int) -> tuple[list[int], list[int]]:
    """Items in the order of their values, and each one's common prefix with the one before, by a blind trie.

    A node is [depth, children by byte]; the way down reads branching bytes only,
    and one comparison with the leaf it ends at tells where to branch off.
    """
    root: list | int = 0
    same: dict[int, list[int]] = {}
    for i in range(1, len(items)):
        value, node = values[i], root
        while not isinstance(node, int):
            child = node[1].get(value >> 8 * (size - 1 - node[0]) & 255)
            node = next(iter(node[1].values())) if child is None else child
        shared = common_prefix(value, values[node], size)
        if shared == size:
            same.setdefault(node, []).append(i)
            continue
        above, node = None, root
        while not isinstance(node, int) and node[0] < shared:
            above, node = node, node[1][value >> 8 * (size - 1 - node[0]) & 255]
        byte = value >> 8 * (size - 1 - shared) & 255
        if not isinstance(node, int) and node[0] == shared:
            node[1][byte] = i
            continue
        leaf = node
        while not isinstance(leaf, int):
            leaf = next(iter(leaf[1].values()))
        branch = [shared, {values[leaf] >> 8 * (size - 1 - shared) & 255: node, byte: i}]
        if above is None:
            root = branch
        else:
            above[1][value >> 8 * (size - 1 - above[0]) & 255] = branch
    order, shared_with = [], []
    todo: list[tuple[list | int, int]] = [(root, 0)]
    while todo:
        node, shared = todo.pop()
        if isinstance(node, int):
            for i in [node, *same.get(node, [])]:
                order.append(items[i])
                shared_with.append(shared)
                shared = size
        else:
            children = [node[1][b] for b in sorted(node[1])]
            todo += [(c, node[0] if k else shared) for k, c in reversed(list(enumerate(children)))]
    return order, shared_with


def sorted_suffixes(group: np.ndarray, strings: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings`` (rows of bytes) within groups, and common prefixes of neighbours (-1 at a group's start).

    The first ``skip`` bytes are equal within a group. Multikey quicksort sorts
    runs of equal rows by one 8-byte symbol after the other to the shallow depth;
    a run that is left goes to a blind trie.
    """
    n, size = strings.shape
    width = -(-size // 8) * 8
    padded = np.zeros((n, width), dtype=np.uint8)
    padded[:, :size] = strings
    symbols = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    run = np.cumsum(X.starts_of_runs(group[order])) if n else group
    first, last = skip // 8, -(-(skip + SHALLOW) // 8)
    for depth in range(first, min(last, width // 8)):
        inside = np.lexsort((symbols[order, depth], run))
        order = order[inside]
        run = np.cumsum(X.starts_of_runs(run[inside], symbols[order, depth]))
    cut = np.append(np.flatnonzero(X.starts_of_runs(run)), n) if n else np.zeros(1, dtype=np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a > 1:
            items = order[a:b].tolist()
            values = [int.from_bytes(strings[i].tobytes(), "big") for i in items]
            order[a:b] = trie_sorted(items, values, size)[0]
    shared = np.full(n, -1, dtype=np.int64)
    if n > 1:
        differ = strings[order[1:]] != strings[order[:-1]]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def covered_sides(group: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor how far to the left and right of it strings reach that an anchor of lower rank shares (0, 0: none)."""
    n = len(group)
    reach_left, reach_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    right_order, right_shared = sorted_suffixes(group, around[:, LEFT:], KMER)
    left_order, left_shared = sorted_suffixes(group, np.ascontiguousarray(around[:, LEFT - 1::-1]), 0)
    for before in range(SPAN):
        behind = LENGTH - before
        of_left, of_right = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        of_left[left_order] = np.cumsum(left_shared < before)
        of_right[right_order] = np.cumsum(right_shared < behind)
        who = np.flatnonzero((left >= before) & (right >= behind))
        order = who[np.lexsort((rank[who], of_right[who], of_left[who]))]
        later = ~X.starts_of_runs(of_left[order], of_right[order])
        hit = order[later]
        reach_left[hit] = before                       # grows with every turn
        reach_right[hit] = np.maximum(reach_right[hit], behind)
    return reach_left, reach_right


class Gatherer:
    """Packs anchors and their surroundings for the holders of their k-mers, equal surroundings once."""

    def __init__(self, buckets: int, flush_rows: int = GATHER_ROWS):
        self.buckets, self.flush_rows, self.held, self.n = buckets, flush_rows, [], 0

    def add(self, keys, around: Surroundings, doc, pos, rows, block) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, around.hi, around.lo, doc, pos, around.left.astype(np.uint8), around.right.astype(np.uint8), rows, block))
        self.n += len(keys)
        if self.n >= self.flush_rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        import zstandard

        if not self.n:
            return
        keys, hi, lo, doc, pos, left, right, rows, block = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.n = [], 0
        bucket = keys % np.uint64(self.buckets)
        order = np.lexsort((pos, doc, lo, hi, keys, bucket))
        new = X.starts_of_runs(hi[order], lo[order])
        at, of_class = order[new], np.cumsum(new) - 1
        pairs = np.unique(np.stack([of_class, block[order]]), axis=1)
        cut = np.append(np.flatnonzero(X.starts_of_runs(bucket[at])), len(at))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        # two or more occurrences of one class within this task are told by a second place
        again = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        for a, b in zip(cut[:-1], cut[1:]):
            mine = (pairs[0] >= a) & (pairs[0] < b)
            x = at[a:b]
            sides = np.stack([left[x], right[x], again[a:b].astype(np.uint8)])
            values = [int(bucket[x[0]]), keys[x].tobytes(), hi[x].tobytes(), lo[x].tobytes(), doc[x].tobytes(), pos[x].tobytes(), sides.tobytes(),
                      squeeze(rows[x].tobytes()), (pairs[0][mine] - a).astype(np.uint32).tobytes(), pairs[1][mine].astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(values)],
                                             names=[f.split()[0] for f in GATHERED.split(", ")])


def _judged(parts: list[tuple]) -> Iterator[tuple[int, bytes]]:
    """Answers of one holder to blocks: every class that any occurrence may lose bytes by."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    u8 = lambda i: np.concatenate([np.frombuffer(p[i], dtype=np.uint64) for p in parts])
    i8 = lambda i: np.concatenate([np.frombuffer(p[i], dtype=np.int64) for p in parts])
    keys, hi, lo, doc, pos = u8(0), u8(1), u8(2), i8(3), i8(4)
    left, right, again = np.concatenate([np.frombuffer(p[5], dtype=np.uint8).reshape(3, -1) for p in parts], axis=1).astype(np.int64)
    around = np.concatenate([np.frombuffer(expand(p[6]), dtype=np.uint8) for p in parts]).reshape(-1, LEFT + LENGTH)
    counts = [len(p[0]) // 8 for p in parts]
    base = np.cumsum([0, *counts[:-1]])
    pair_row = np.concatenate([np.frombuffer(p[7], dtype=np.uint32).astype(np.int64) + b for p, b in zip(parts, base)])
    pair_block = np.concatenate([np.frombuffer(p[8], dtype=np.uint32) for p in parts])

    order = np.lexsort((pos, doc, lo, hi, keys))
    new = X.starts_of_runs(keys[order], hi[order], lo[order])
    class_of = np.empty(len(order), dtype=np.int64)
    class_of[order] = np.cumsum(new) - 1
    first = order[new]
    many = (np.bincount(class_of) > 1) | (np.bincount(class_of, weights=again) > 0)
    place = np.lexsort((pos[first], doc[first]))
    # equal places, as of repeated rows, have equal ranks
    rank = np.empty(len(first), dtype=np.int64)
    rank[place] = np.cumsum(X.starts_of_runs(doc[first][place], pos[first][place]))
    reach_left, reach_right = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    k = keys[first]
    width = np.diff(np.append(np.flatnonzero(X.starts_of_runs(k)), len(k)))
    shared = np.flatnonzero(np.repeat(width > 1, width))
    if len(shared):
        x = first[shared]
        reach_left[shared], reach_right[shared] = covered_sides(keys[x], around[x], left[x], right[x], rank[shared])
    answer = np.zeros(len(first), dtype=_CLASS)
    answer["hi"], answer["doc"], answer["pos"] = hi[first], doc[first], pos[first]
    answer["left"], answer["right"] = reach_left, reach_right
    useful = many | (reach_right > 0)
    pairs = np.unique(np.stack([pair_block.astype(np.int64), class_of[pair_row]]), axis=1)
    pairs = pairs[:, useful[pairs[1]]]
    cut = np.append(np.flatnonzero(X.starts_of_runs(pairs[0])), pairs.shape[1]) if pairs.shape[1] else np.zeros(1, dtype=np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(pairs[0, a]), b"C" + answer[pairs[1, a:b]].tobytes()


def _split(got: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A block's class answers by key, and its repeated strings, from their packed runs."""
    classes = np.frombuffer(b"".join(g[1:] for g in got if g[:1] == b"C"), dtype=_CLASS)
    strings = np.frombuffer(b"".join(g[1:] for g in got if g[:1] == b"W"), dtype=_STRING)
    return classes[np.argsort(classes["hi"], kind="stable")], strings[np.lexsort((strings["start"], strings["doc"]))]


def covered(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, classes: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes to remove from texts, as begins, ends and texts."""
    none = np.zeros(0, dtype=np.int64)
    found = [(none, none, none)]
    for at, _ in anchors(data, offsets) if len(classes) else ():
        around = Surroundings(data, offsets, at)
        which = np.minimum(np.searchsorted(classes["hi"], around.hi), len(classes) - 1)
        hit = classes["hi"][which] == around.hi
        one, p, text = classes[which[hit]], at[hit], around.text[hit]
        is_first = (one["doc"] == ids[text]) & (one["pos"] == p - offsets[text])
        begin = p - np.where(is_first, one["left"], around.left[hit])
        end = p + np.where(is_first, one["right"], around.right[hit])
        some = end > begin
        found.append(runs(begin[some], end[some], text[some]))
    for i in range(len(ids)) if len(repeats) else ():
        a, b = np.searchsorted(repeats["doc"], ids[i], side="left"), np.searchsorted(repeats["doc"], ids[i], side="right")
        starts = repeats["start"][a:b] + offsets[i]
        # another row of this id may be longer
        starts = starts[starts + LENGTH <= offsets[i + 1]]
        found.append(runs(starts, starts + LENGTH, np.full(len(starts), i)))
    return runs(*(np.concatenate(c) for c in zip(*found)))


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column(3).fill_null(NO_ID).to_numpy()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
                   block_bytes: int = X.BLOCK_BYTES, common: int = X.COMMON_BLOCKS, entries: int = X.COMMON_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless asked for) of every row."""
    rows = id_and_text(docs, id_col, text_col)
    blocks = X.block_count(text_bytes(rows, "text"), block_bytes)

    buckets = X.bucket_count(blocks)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = X.Sender(buckets, common)
        for batch in batches:
            block = batch.column(0).to_numpy()
            for first, data, offsets in K.text_buffers(batch.column(1)):
                for at, keys in anchors(data, offsets):
                    text = np.searchsorted(offsets, at, side="right") - 1
                    yield from sender.add(keys, np.zeros(len(keys), dtype=np.uint64), block[first + text])
        yield from sender.flush()

    def gather(pieces) -> Iterator[pa.RecordBatch]:
        gatherer, known = Gatherer(buckets), X.Known()
        for part, got in pieces:
            block, ids = part.column(0).to_numpy(), _ids(part)
            for first, data, offsets in K.text_buffers(part.column(4)):
                for at, keys in anchors(data, offsets):
                    hits = np.flatnonzero(X.among(keys, known(got)))
                    for hit in np.split(hits, range(GATHER_ROWS, len(hits), GATHER_ROWS)):
                        if len(hit):
                            around = Surroundings(data, offsets, at[hit])
                            yield from gatherer.add(keys[hit], around, ids[first + around.text], around.at - offsets[around.text],
                                                    around.rows(data), block[first + around.text])
        yield from gatherer.flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in X.by_group(batches):
            answers = list(_judged(parts))
            if answers:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*answers), (pa.int32(), pa.binary()))], names=["block", "keys"])

    def strings(pieces) -> Iterator[pa.RecordBatch]:
        known = X.Known()
        for part, got in pieces:
            block, ids = part.column(0).to_numpy(), _ids(part)
            for first, data, offsets in K.text_buffers(part.column(4)):
                for at, keys in anchors(data, offsets):
                    at = at[X.among(keys, known(got))]
                    starts = np.unique((at[:, None] - np.arange(SPAN)).ravel())
                    starts = starts[starts >= 0]
                    text = np.searchsorted(offsets, starts, side="right") - 1
                    inside = offsets[np.minimum(text + 1, len(offsets) - 1)] - starts >= LENGTH
                    starts, text = starts[inside], text[inside]
                    if not len(starts):
                        continue
                    low, high = int(starts[0]), int(starts[-1]) + LENGTH
                    hi, lo = (K.range_codes(K.byte_codes(data[low:high], w), starts - low, starts - low + LENGTH, w).view(np.int64) for w in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(block[first + text]), pa.array(ids[first + text]),
                                                      pa.array(starts - offsets[text])], names=["hi", "lo", "block", "doc_id", "start"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, doc, start = (batch.column(c).to_numpy() for c in range(3))
            order = np.argsort(block, kind="stable")
            found = np.zeros(len(order), dtype=_STRING)
            found["doc"], found["start"] = doc[order], start[order]
            cut = np.append(np.flatnonzero(X.starts_of_runs(block[order])), len(order))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][cut[:-1]], pa.int32()),
                                              pa.array([b"W" + found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["block", "keys"])

    def cut(pieces) -> Iterator[pa.RecordBatch]:
        of, classes, repeats = None, None, None
        for part, got in pieces:
            if got is not of:
                of, (classes, repeats) = got, _split(got)
            ids = _ids(part)
            for first, data, offsets in K.text_buffers(part.column(4)):
                n = len(offsets) - 1
                begin, end, text = covered(data, offsets, ids[first:first + n], classes, repeats)
                edge = np.zeros(len(data) + 1, dtype=np.int8)
                edge[begin] += 1
                edge[end] -= 1
                left = data[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()
                removed = np.bincount(text, weights=end - begin, minlength=n).astype(np.int64)
                to = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
                kept = [left[a:b] for a, b in zip(to[:-1], to[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).slice(first, n), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.bincount(text, minlength=n)),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                     pa.array([k.decode("utf-8", "replace") for k in kept] if with_text else [None] * n, pa.string())],
                    names=[f.split()[0] for f in RESULT.split(", ")])

    keyed = rows.select(X.block_of(blocks).alias("block"), "text").mapInArrow(send_keys, X.SENT)
    repeated = settle(X.repeated(keyed, buckets, entries), "repeated-kmers")
    gathered = X.at_blocks(rows, repeated.filter("block >= 0"), blocks, gather, GATHERED)
    answers = settle(gathered.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, X.ANSWERED), "covered-classes")
    common_kmers = repeated.filter("block < 0")
    if not common_kmers.isEmpty():
        found = settle(X.at_blocks(rows, common_kmers, blocks, strings, WINDOWS), "strings")
        earliest = settle(found.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
                          .filter("n > 1"), "earliest-strings")
        later = (join_groups(found, earliest, ["hi", "lo"], hot_floor(found.count()))
                 .filter("struct(doc_id, start) != first").select("block", "doc_id", "start"))
        answers = answers.unionByName(settle(later.mapInArrow(pack, X.ANSWERED), "later-strings"))
    return X.at_blocks(rows, answers, blocks, cut, RESULT)
