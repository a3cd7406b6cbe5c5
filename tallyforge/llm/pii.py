"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Four kinds follow from fixed patterns (email, ip, card, phone). They are the
seeds of a bootstrap, with long values given to a key such as ``token`` as seeds
of kind ``id``. Every other candidate of the corpus is an instance: runs of
letters, digits and joiners with a digit in them, digits in groups with spaces,
brackets and hyphens as cards and phones have them, and whatever is given to a
key by ``=`` or ``:``. The nearest words on either side, at any distance, and the
key are an instance's lexical patterns, and Spark scores the bipartite graph of
patterns and instances in turns. A pattern's confidence is the share of its
distinct instances that are trusted, damped for few instances; an instance's
confidence is the best chance that its patterns give it. Patterns above
``min_confidence`` with at least ``min_support`` trusted instances turn the
candidates in their place into spans of kind ``id``, unless a fixed kind covers
them.

Pattern and instance counts are partial aggregates, so a very common context is
never dealt to one task; the texts are scanned once, each in linear time.

Defined cases: null and empty texts have no spans; rows repeating an id are
reported once each with their own spans; a corpus without seeds discovers none;
a name in letters alone is a candidate only where it is given to a key.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import id_and_text
from tallyforge.session import settle

# The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
FOUND_KIND = "id"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What could identify someone: joined letters and digits with a digit, digits in groups, values given to a key.
_TOKEN = re.compile(r"(?<![A-Za-z0-9@._%+=/-])[A-Za-z@._%+=/-]*+[0-9][A-Za-z0-9@._%+=/-]*+")
_GROUPS = re.compile(r"(?<![\w@+(])[+(]?+[0-9](?:[\x20().-]{0,3}+[0-9])++(?![A-Za-z0-9@_])")
_VALUE = re.compile(r"[:=][\x20\t]*+[\"'`]?+([A-Za-z0-9@._%+/-]++)")
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
#: Keys whose long values of letters and digits are seeds too, and how long.
SECRET_KEYS = frozenset("password passwd pwd secret token api_key apikey access_key secret_key private_key auth_token access_token "
                        "client_secret".split())
SECRET_CHARS = 16
_WORDS = re.compile(r"[^\W\d_]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words of a context on each side.
CONTEXT_WORDS = 2
SCANNED = ("row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
           "mentions array<struct<start:long,stop:long,fixed:boolean,seed:boolean,instance:string,patterns:array<string>>>")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; for every @ the local part is the run of its characters before, so time is linear."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four fixed kinds in code points; a match that fails its check is dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if 16 <= m.end() - m.start() <= 37 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """What a token looks like: runs of digits, letters and joiners, without their lengths."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", token))))


def key_of(text: str, start: int) -> str:
    """The key that the value at ``start`` is given to by = or :, in lower case; empty if there is none."""
    at = start - (start > 0 and text[start - 1] in "\"'`")
    while at and text[at - 1] in " \t":
        at -= 1
    end = at
    while end and text[end - 1] in ":=":
        end -= 1
    if end == at:
        return ""
    while end and text[end - 1] in " \t\"'`":
        end -= 1
    first = end
    while first and text[first - 1] in _KEY_CHARS:
        first -= 1
    return text[first:end].lower().replace("-", "_")


def candidates(text: str, fixed: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans outside the fixed ones; of overlapping ones the first, and of those the longest."""
    spans = set()
    if _DIGIT.search(text):
        spans.update(m.span() for m in _GROUPS.finditer(text))
        spans.update((m.start(), m.start() + len(m[0].rstrip("."))) for m in _TOKEN.finditer(text))
    if ":" in text or "=" in text:
        spans.update((m.start(1), m.start(1) + len(m[1].rstrip("."))) for m in _VALUE.finditer(text))
    merged: list[list[int]] = []
    for a, b in fixed:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    done = at = 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        while at < len(merged) and merged[at][1] <= a:
            at += 1
        if a >= done and a < b and (at == len(merged) or merged[at][0] >= b):
            yield a, b
            done = b


def is_secret(key: str, value: str) -> bool:
    return key in SECRET_KEYS and len(value) >= SECRET_CHARS and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def mentions(text: str, base: dict[str, list[tuple[int, int]]]) -> list[dict]:
    """Seed spans and candidates with the lexical patterns they stand in."""
    fixed = sorted({span for spans in base.values() for span in spans})
    found = [(a, b, True) for a, b in fixed] + [(a, b, False) for a, b in candidates(text, fixed)]
    if not found:
        return []
    starts, stops = array("q"), array("q")
    for m in _WORDS.finditer(text):
        starts.append(m.start())
        stops.append(m.end())
    out = []
    for a, b, is_fixed in found:
        last, first = bisect_right(stops, a), bisect_left(starts, b)
        left = [text[starts[i]:stops[i]].lower() for i in range(max(0, last - CONTEXT_WORDS), last)]
        right = [text[starts[i]:stops[i]].lower() for i in range(first, min(len(starts), first + CONTEXT_WORDS))]
        instance, key = text[a:b], key_of(text, a)
        form = shape(instance)
        patterns = []
        if len(left) == CONTEXT_WORDS:
            patterns.append(f"{' '.join(left)} <{form}>")
        if len(right) == CONTEXT_WORDS:
            patterns.append(f"<{form}> {' '.join(right)}")
        if left and right:
            patterns.append(f"{left[-1]} <*> {right[0]}")
        if key:
            patterns.append(f"{key} = <*>")
        out.append({"start": a, "stop": b, "fixed": is_fixed, "seed": is_fixed or is_secret(key, instance), "instance": instance,
                    "patterns": patterns})
    return out


def joined(base: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fixed spans of every whole text, and its mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("row", pa.int64()), ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()),
            ("mentions", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("fixed", pa.bool_()), ("seed", pa.bool_()), ("instance", pa.string()),
                                             ("patterns", pa.list_(pa.string()))])))])
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                base = base_spans(text)
                rows.append({"row": row, "doc_id": doc_id, "base": joined(base), "mentions": mentions(text, base),
                             **{f"n_{k}": len(base[k]) for k in KINDS}})
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = id_and_text(docs, id_col, text_col)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, SCANNED)


def bootstrap(scanned: DataFrame, rounds: int = 3, min_confidence: float = 0.8, min_support: int = 3) -> DataFrame:
    """High-confidence patterns: pattern, confidence, support.

    Each turn is two aggregates over the edges of the graph: trusted shares per
    pattern, then the best pattern per instance. Every turn is settled, so its
    lineage stays short.
    """
    edges = settle(
        scanned.select(F.explode("mentions").alias("m"))
        .select("m.instance", "m.seed", F.explode("m.patterns").alias("pattern"))
        .groupBy("pattern", F.xxhash64("instance").alias("instance")).agg(F.max("seed").alias("seed")), "pattern-edges")
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    trust, patterns = seeds, None
    for turn in range(rounds):
        patterns = settle(
            edges.join(trust, "instance").groupBy("pattern")
            .agg(F.sum("trust").alias("support"), F.count(F.lit(1)).alias("n"))
            .select("pattern", "support", (F.col("support") / (F.col("n") + 1)).alias("confidence"))
            .filter(F.col("support") >= min_support), f"patterns-{turn}")
        if turn + 1 < rounds:
            # an instance is as sure as its best pattern; seeds stay certain
            reached = (edges.join(patterns.filter(F.col("confidence") >= min_confidence), "pattern")
                       .groupBy("instance").agg(F.max("confidence").alias("reached")))
            trust = settle(seeds.join(reached, "instance", "left")
                           .select("instance", F.greatest("trust", F.coalesce("reached", F.lit(0.0))).alias("trust")), f"trust-{turn}")
    return patterns.filter(F.col("confidence") >= min_confidence)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_confidence: float = 0.8,
             min_support: int = 3) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans of the fixed kinds), extra (discovered spans)."""
    scanned = settle(scan(docs, id_col, text_col), "pii-scan")
    trusted = bootstrap(scanned, rounds, min_confidence, min_support).select("pattern")
    unseen = scanned.select("row", F.explode("mentions").alias("m")).filter("NOT m.fixed")
    by_pattern = unseen.filter("NOT m.seed").select("row", "m.start", "m.stop", F.explode("m.patterns").alias("pattern"))
    told = by_pattern.join(trusted, "pattern", "left_semi").drop("pattern").union(unseen.filter("m.seed").select("row", "m.start", "m.stop"))
    # a row's own mentions only, so the lists are bounded by its text
    extra = (told.groupBy("row")
             .agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("found")))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.lit(FOUND_KIND), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return (scanned.join(extra, "row", "left")
            .select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.coalesce(spans, F.lit("")).alias("extra")))
