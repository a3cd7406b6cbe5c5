"""Exact, near, byte and word deduplication and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, exact_dedup, minhash, substring_dedup, suffix_dedup
from tallyforge.llm import text_keys as K
from tallyforge.llm.columns import join_groups
from tallyforge.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "word"), (904, "Word"), (905, "two words"), (906, "a" * 700), (None, "no id at all"),
       (907, "x y " * 150), (908, "é" * 130)]


def frame(spark, rows, columns="doc_id long, text string, digest string, part string, block int"):
    return spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], columns)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(120):
        kind = i % 6
        if kind == 0:
            t = text(80) + " " + rng.choice(shared) + " " + text(30)
        elif kind == 1 and rows:
            t = rng.choice(rows)[1]
        elif kind == 2 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = " ".join(words)
        elif kind == 3:
            t = (rng.choice(shared) + "\n") * 3 + text(10)
        else:
            t = text(rng.randrange(3, 150))
        rows.append((i, t))
    rng.shuffle(rows)
    return rows + ODD


# --- exact ------------------------------------------------------------------------

@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda t: (F.length(t) % 5).cast("string")], ids=["sha256", "colliding"])
@pytest.mark.parametrize("least", [10**9, 3], ids=["usual", "hot"])
def test_exact_groups(spark, corpus, digest, least):
    rows = corpus + [(5, "twice"), (5, "twice"), (None, "only null id")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    docs = frame(spark, rows)
    got = exact_dedup.exact_groups(docs, digest=digest, share=0.0, least=least).select("row_id", "keep_id", "group_size", "kept")
    want = [(i, top[t or ""], len(groups[t or ""]), i == top[t or ""]) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = exact_dedup.distinct_rows(docs, digest=digest, share=0.0, least=least)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(((top[t], t) for t in groups), key=str)


def test_exact_on_an_empty_table_and_native_plan(spark, corpus):
    docs = frame(spark, corpus)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.distinct_rows(docs.limit(0)).count() == 0
    plan = exact_dedup.distinct_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- near -------------------------------------------------------------------------

def shingle_sets(rows, k):
    out = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    return out


@pytest.mark.parametrize("k,block,least", [(2, 256, 1000), (5, 256, 1000), (2, 3, 1000), (5, 256, 3)],
                         ids=["pairs of words", "five words", "many blocks", "hot keys"])
def test_near_duplicates(spark, corpus, k, block, least):
    sets = shingle_sets(corpus, k)
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, corpus), k=k, block=block, least=least).collect()}
    assert got == {i: (len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets}


def test_near_on_an_empty_table(spark, corpus):
    assert minhash.near_duplicates(frame(spark, corpus).limit(0)).count() == 0


def test_signature_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for overlap in (0.3, 0.8, 0.95):
        n = 4000
        shared = int(2 * n * overlap / (1 + overlap))
        keys = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(keys[:n]), np.unique(np.concatenate([keys[:shared], keys[n:2 * n - shared]]))
        bits = [np.frombuffer(minhash.low_bits(minhash.minima(x)), dtype=np.uint8) for x in (a, b)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash.estimates(bits[0], bits[1][None])[0] - true) < 0.13


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(500, i) for i in range(600, 640)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for least in (1000, 5):
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), least).collect()}
        assert got == {x: up[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joins_of_hot_keys(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 9 + ["b", "b", "c", None, "d"])], "id long, key string")
    groups = spark.createDataFrame([("a", 1, 9), ("b", 2, 2), ("c", 3, 1)], "key string, value int, n long")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(str, rows.join(groups.drop("n"), "key", how).collect()))
        for floor in (1, 2, 5, 100):
            assert sorted(map(str, join_groups(rows, groups, ["key"], floor, how).collect())) == want


# --- repeated words and bytes -------------------------------------------------------

@pytest.mark.parametrize("settings", [{}, {"block_bytes": 3000, "common": 2}], ids=["usual", "common keys"])
def test_repeated_windows(spark, corpus, settings):
    words = [WORD.findall(t or "") for _, t in corpus]
    seen = Counter(tuple(w[j:j + 35]) for w in words for j in range(len(w) - 34))
    want = []
    for (i, _), w in zip(corpus, words):
        gone = np.zeros(len(w), dtype=bool)
        for j in range(len(w) - 34):
            if seen[tuple(w[j:j + 35])] > 1:
                gone[j:j + 35] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, corpus), **settings).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 1000


def brute_strings(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - 99):
            if b[j:j + 100] in seen:
                gone[j:j + 100] = True
            seen.add(b[j:j + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 4000, "common": 2, "entries": 6}], ids=["usual", "common keys"])
def test_repeated_strings(spark, corpus, settings):
    rng = random.Random(8)
    rows = corpus + [(1000 + i, "".join(rng.choices("ab", k=90)) + corpus[3][1][5:260] + "".join(rng.choices("ab", k=40))) for i in range(25)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), with_text=False, **settings).drop("kept_text")
    want = brute_strings(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and sum(w[3] for w in want) > 30


def test_repeats_across_stretches_of_a_long_text(spark):
    """Texts of several stretches, with repeats over their limits, copies within a text, and ids that come twice."""
    rng = random.Random(3)
    noise = lambda n: rng.randbytes(n // 2).hex()
    size = suffix_dedup.STRETCH
    passage, run = noise(5000), "z" * 700
    long_text = noise(size - 2500) + passage + noise(size - 4000) + run + noise(3000) + passage[100:900] + noise(60)
    rows = [(1, noise(300) + passage[2000:4000] + noise(200)), (2, long_text), (3, noise(size // 2) + long_text[size - 90:size + 200] + noise(9)),
            (4, passage[:99]), (5, passage[:101]), (5, passage[:101])]
    first: dict[bytes, tuple[int, int]] = {}
    for i, t in rows:
        b = t.encode()
        for s in range(len(b) - suffix_dedup.LENGTH + 1):
            first.setdefault(b[s:s + suffix_dedup.LENGTH], (i, s))
    want = []
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t))
        for s in range(len(b) - suffix_dedup.LENGTH + 1):
            if first[b[s:s + suffix_dedup.LENGTH]] != (i, s):
                gone[s:s + suffix_dedup.LENGTH] = b"\1" * suffix_dedup.LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({}, {"common": 2, "entries": 3}):
        got = suffix_dedup.remove_repeats(docs, with_text=False, **settings).drop("kept_text").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_repeats_on_empty_tables(spark, corpus):
    docs = frame(spark, corpus).limit(0)
    assert substring_dedup.remove_repeats(docs).count() == 0 and suffix_dedup.remove_repeats(docs).count() == 0


def test_difference_cover_and_deep_shallow_order():
    held = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert held == set(range(substring_dedup.PERIOD))
    rng = np.random.default_rng(4)
    strings = rng.integers(0, 2, (300, 100)).astype(np.uint8)
    strings[:, :36] = 1
    strings[100:200] = strings[7]
    strings[120:160, 77] ^= 1
    strings[150:200, 99] ^= 1
    group = np.sort(rng.integers(0, 4, 300)).astype(np.uint64)
    order, shared = suffix_dedup.sorted_suffixes(group, strings, 36)
    rows = [(int(group[i]), strings[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 300):
        (g, a), (h, b) = rows[k - 1], rows[k]
        equal = next((x for x in range(100) if a[x] != b[x]), 100)
        assert shared[k] == (equal if g == h else -1)


# --- decontamination ----------------------------------------------------------------

def slow_distance(item, text):
    best, before = (len(item), 0), list(range(len(item) + 1))
    for j, w in enumerate(text, 1):
        now = [j]
        for i in range(1, len(item) + 1):
            now.append(min(before[i] + 1, now[-1] + 1, before[i - 1] + (item[i - 1] != w)))
        before = now
        best = min(best, (now[-1], j))
    return best


def test_edit_distance_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, text = (rng.integers(0, 5, rng.integers(1, n)).astype(np.uint64) for n in (70, 90))
        limit = int(rng.integers(0, 20))
        assert decontaminate.edit_distance(item, text, limit) == slow_distance(item.tolist(), text[:len(item) + limit].tolist())


def test_leaks_reach_the_target_recall_and_spare_the_rest(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "too short")]
    rows, planted = [], set()
    for n in range(200):
        i, text = items[n % 40]
        words = text.split()
        for _ in range(int(0.15 * len(words) * (n % 3) / 2)):
            at = rng.randrange(len(words))
            words[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], rng.choice(vocabulary)]])
        shown = " ".join(words)
        shown = shown.upper() if n % 4 == 0 else shown.replace(" ", " | ") if n % 4 == 1 else shown
        if n % 2:
            planted.add((n, i))
            rows.append((n, " ".join(rng.choices(vocabulary, k=50)) + " " + shown + "\n" + " ".join(rng.choices(vocabulary, k=20))))
        else:
            rows.append((n, " ".join(rng.choices(vocabulary, k=120))))
    docs = frame(spark, rows + ODD)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (1000, 15):
        found = decontaminate.find_leaks(docs, benchmark, items_per_pass=per_pass).collect()
        pairs = {(r.doc_id, r.item_id) for r in found}
        assert pairs <= planted and len(pairs) >= 0.97 * len(planted)
        assert all(r.edits <= decontaminate.MAX_EDITS * r.item_words for r in found)
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows + ODD if i not in {p[0] for p in pairs}), key=str)
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("length", [15, 30, 59, 200])
@pytest.mark.parametrize("part", ["anywhere", "evenly", "first half", "middle", "last half"])
def test_recall_at_the_limit_by_length_and_place_of_edits(length, part):
    rng = np.random.default_rng(length)
    fresh = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)
    items, limit, texts = [(i, fresh(length)) for i in range(60)], length // 5, []
    low, high = {"first half": (0, length // 2), "middle": (length // 4, 3 * length // 4), "last half": (length // 2, length)}.get(part, (0, length))
    for _, item in items:
        places = [int((j + 0.5) * length / limit) for j in range(limit)] if part == "evenly" else rng.choice(np.arange(low, high), limit, replace=False)
        words = item.tolist()
        for at in sorted((int(p) for p in places), reverse=True):
            words[at:at + 1] = [[], fresh(1).tolist(), [words[at], *fresh(1).tolist()]][rng.integers(3)]
        texts.append(np.concatenate([fresh(30), np.array(words, dtype=np.uint64), fresh(length)]))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = decontaminate.Index(items, decontaminate.MAX_EDITS).matches(np.concatenate(texts), bounds)
    assert all(t == m for t, m in found) and len(found) >= 0.97 * len(items)


def test_short_items_and_scripts_without_spaces(spark):
    chinese, thai, plane2 = "\u6625\u7720\u4e0d\u89ba\u66c9\u8655\u8655\u805e\u557c\u9ce5", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e04\u0e23\u0e31\u0e1a", "\U00020001\U00020002"
    items = [(1, "Forty-two"), (2, "forty two"), (3, "yes"), (4, "one of four words"), (5, ""), (6, None), (7, " - "), (8, chinese), (9, thai), (10, plane2)]
    rows = [(1, "it is forty; TWO of them, forty two"), (2, "forty"), (3, "two"), (4, "yesterday"), (5, "say Yes"), (6, "one of the four words"),
            (7, "so one of four words"), (8, "\u3042" + chinese[:4] + "\u4e00" + chinese[5:] + "\u3042"), (9, "abc" + thai + "def"),
            (10, plane2[0]), (11, "x" + plane2), (12, chinese[:5]), (13, None), (14, "")]
    docs = frame(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.item_words, r.edits) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1): (2, 2, 2, 0), (1, 2): (2, 2, 2, 0), (5, 3): (1, 1, 1, 0), (7, 4): (1, 4, 4, 0), (8, 8): (1, 10, 10, 1),
                     (9, 9): (1, 10, 10, 0), (11, 10): (1, 2, 2, 0)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, benchmark).collect()} == {2, 3, 4, 6, 10, 12, 13, 14}


def test_text_runs_never_cut_a_text():
    import pyarrow as pa

    texts = ["a" * 50, None, "b", "c" * 500]
    assert [(first, len(offsets) - 1) for first, _, offsets in K.text_buffers(pa.array(texts), 60)] == [(0, 3), (3, 1)]


# --- texts built so that polynomial fingerprints agree ------------------------------

def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


@pytest.mark.parametrize("letters", [1024, 4096])
def test_built_words_are_told_apart(spark, letters):
    one, other = "".join(thue_morse(letters, "a", "b")), "".join(thue_morse(letters, "b", "a"))
    data = np.frombuffer((one + " " + other + " " + one).encode(), dtype=np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    for which in (0, 1):
        codes = K.word_codes(data, starts, ends, which)
        assert codes[0] == codes[2] != codes[1]
    found = minhash.near_duplicates(frame(spark, [(1, one), (2, other), (3, one)]), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1}
    rest = " ".join(f"w{i}" for i in range(34))
    kept = substring_dedup.remove_repeats(frame(spark, [(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"x {rest} {one} y")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in kept} == {1: 35, 2: 0, 3: 35}
    item = f"{rest} {one}"
    leaks = decontaminate.find_leaks(frame(spark, [(1, f"x {item} y"), (2, other), (3, one)]),
                                     spark.createDataFrame([(7, item), (8, one)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in leaks} == {(1, 7, 0), (1, 8, 0), (3, 8, 0)}
    strings = suffix_dedup.remove_repeats(frame(spark, [(1, one), (2, other)])).collect()
    bytes_of = {1: one.encode(), 2: other.encode()}
    seen, want = set(), {}
    for i, t in bytes_of.items():
        gone = set()
        for at in range(len(t) - 99):
            if t[at:at + 100] in seen:
                gone.update(range(at, at + 100))
            seen.add(t[at:at + 100])
        want[i] = len(gone)
    assert {r["doc_id"]: r["n_removed"] for r in strings} == want


def test_built_sequences_are_told_apart(spark):
    one, other = " ".join(thue_morse(1024, "aa", "bb")), " ".join(thue_morse(1024, "bb", "aa"))
    found = minhash.near_duplicates(frame(spark, [(1, one), (2, other), (3, one)]), k=5).collect()
    shingle = lambda t: {tuple(t.split()[i:i + 5]) for i in range(1020)}
    same = len(shingle(one) & shingle(other)) * 100 >= 80 * len(shingle(one) | shingle(other))
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1 if same else 2, 3: 1}
    windows = substring_dedup.remove_repeats(frame(spark, [(1, one), (2, other)])).collect()
    counts = Counter(tuple(t.split()[i:i + 35]) for t in (one, other) for i in range(990))
    want = {}
    for i, t in ((1, one), (2, other)):
        gone = set()
        for at in range(990):
            if counts[tuple(t.split()[at:at + 35])] > 1:
                gone.update(range(at, at + 35))
        want[i] = len(gone)
    assert {r["doc_id"]: r["n_removed"] for r in windows} == want


def test_matches_at_large_shares_of_edits(spark):
    """Where no word pair need survive, no window is left out."""
    item = " ".join(f"i{k}" for k in range(10))
    text = " ".join(f"i{k}" if k % 2 else f"x{k}" for k in range(10))
    found = decontaminate.Index([(1, decontaminate.item_words([item])[0])], 0.6)
    assert found.classes[0][1] == 0
    words = decontaminate.item_words([text])[0]
    assert found.likely(0, found.pairs(words))
