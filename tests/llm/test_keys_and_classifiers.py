"""Window keys, language ID, packing, archives: small cases against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tallyforge.llm import language_id, packing, warc
from tallyforge.llm import text_keys as K

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@given(st.lists(st.text(alphabet="aB \t\né\x00", max_size=12), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for first, data, offsets in K.text_buffers(pa.array(texts, pa.string()), 16):
        starts, ends, bounds = K.words(data, offsets)
        for i in range(len(offsets) - 1):
            got = [bytes(data[a:b]).decode() for a, b in zip(starts[bounds[i]:bounds[i + 1]], ends[bounds[i]:bounds[i + 1]])]
            assert got == WORDS.findall(texts[first + i])


def test_equal_ranges_have_equal_codes_and_others_do_not():
    data = np.frombuffer(b"abcabdabc", dtype=np.uint8)
    codes = K.range_codes(K.byte_codes(data), np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert codes[0] == codes[2] != codes[1]


# --- language ID ------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, `_text` string, digest string"


def _language_rows(n=60):
    rng = random.Random(1)
    parts = {"aa": ["lor", "mip", "sum", "dol"], "bb": ["zük", "wöt", "jäx", "qev"]}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(60))
    return [(i, make(lang), lang, "x", "y") for i, lang in enumerate(["aa", "bb"] * (n // 2))]


def test_language_id_learns_and_defines_odd_texts(spark):
    odd = [(900, None, None, None, None), (901, "", "aa", None, None), (902, "123 ... 4", "bb", None, None), (None, "lorlor sumsum", None, None, None)]
    docs = spark.createDataFrame(_language_rows() + odd, SCHEMA)
    from pyspark.sql import functions as F

    model = language_id.train(docs, F.col("doc_id") % 3 != 1)
    assert sorted(m[0] for m in model) == ["aa", "bb"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _, _ in _language_rows() if i % 3 == 1]
    assert all(right) and right
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[None].lang_pred == "aa"
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in _language_rows()} | {None}


def test_short_texts_are_told_apart():
    import pyarrow.dataset as ds

    t = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().to_pylist()
    languages = sorted({r["lang"] for r in t})
    model = [(lang, "".join(language_id.letters_only(r["text"]) for r in t if r["lang"] == lang and r["doc_id"] % 2)[-100_000:].encode())
             for lang in languages]
    classify = language_id.Classifier(model)
    short = [r for r in t if r["doc_id"] % 2 == 0 and 8 <= len(r["text"]) < 60]
    assert len(short) > 3 and sum(classify(r["text"])[0] == r["lang"] for r in short) >= 0.8 * len(short)


def test_language_id_without_any_label(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)
    from pyspark.sql import functions as F

    model = language_id.train(docs, F.lit(True))
    assert model == [] and language_id.predict(docs, model).first().lang_pred == "und"
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from tallyforge.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


# --- packing ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = ["", "  ", "it's 'S x", "<|endoftext|> a", "x<|startoftext|>y", "İstanbul\xa0x y\x1cz\x85w", "é ́", "\x1f \x0b", "ﬁ ½ Å", "ΣΑΣ Σας.",
       "word's. abc..?", "a≮b", "À!! ß?", "don 't", "a" * 3000, "12 345,6", "éa. é"]


def test_chunks_give_the_tokenizers_ids(tokenizer):
    tokens = packing.ChunkTokens(tokenizer, limit=5)
    for texts in (ODD, ODD[::-1], ODD):
        got = tokens.ids(texts)
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert got == want


@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_bins_are_gapless_and_never_overflow(needs, limit):
    bins, fill = packing.OpenBins(50, limit), {}
    for need in needs:
        b, at = bins.place(need)
        assert at == fill.get(b, 0)
        fill[b] = at + need
        assert fill[b] <= 50 and bins.open <= limit
    assert len(fill) >= -(-sum(needs) // 50)


def test_best_fit_takes_the_tightest_bin():
    bins = packing.OpenBins(10, 3)
    assert [bins.place(n)[0] for n in (6, 7, 3, 4)] == [0, 1, 1, 0]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (9, 6, 7)] == [0, 1, 2] and bins.place(4)[0] == 1


def test_packed_documents_round_trip(spark, tokenizer):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (0, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id long, text string, piece string, sequence_id string")
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    want = []
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence.get(r.sequence_id, 0)
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 64
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- archives ---------------------------------------------------------------------

PAGES = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y z\r\nq", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "u", "x" * 100_000), (0, "u", "x" * 100_000),
         (None, "n", "<p>é</p>"), (None, "m", "only"), (None, "m", "only"), (7, "r", "rep"), (7, "r", "rep")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, first_id string")
    got = warc.round_trip(pages, archive_bytes=200, with_payload=True).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        revisit = (h or "") in first and i != first[h or ""]
        want.append((i, len(body), warc.sha1_base32(body), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r.payload).decode() in {p[2] or "" for p in PAGES} for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=3).collect()} == {"response"}


def test_pages_of_a_frequent_payload_revisit_the_first(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(5, 30)] + [(40, None), (41, ""), (42, "own 9")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    first = {h or "": min(i for i, x in rows if (x or "") == (h or "")) for _, h in rows}
    count = Counter(h or "" for _, h in rows)
    want = sorted((i, first[h or ""] if count[h or ""] > 1 else None, i != first[h or ""]) for i, h in rows)
    for least in (2, 10, 1000):
        got = warc.with_revisits(pages, least=least).select("page_id", "first_id", "revisit").collect()
        assert sorted(map(tuple, got)) == want


def test_zip64_directory_and_broken_files():
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink)
    for i in range(70_000 // 7000):
        writer.add(i, warc.record_bytes(i, "u", b"x" * i, None, False))
    writer.close()

    class File:
        def __init__(self, raw):
            self.raw = raw

        def read_at(self, n, at):
            return self.raw[at:at + n]

    raw = sink.getvalue()
    assert [r["payload_bytes"] for r in warc.archive_records(File(raw), len(raw))] == list(range(10))
    # the same directory behind a ZIP64 end record
    end = raw.rfind(b"PK\x05\x06")
    import struct

    count, length, start = struct.unpack("<HII", raw[end + 10:end + 20])
    wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    wide += b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:end] + wide + tail
    assert len(list(warc.archive_records(File(big), len(big)))) == 10
    with pytest.raises(ValueError):
        warc.directory(File(b"nothing"), 7)
    record = warc.record_bytes(1, "u", b"payload", None, False)
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"payload", b"pAyload"))
    assert gzip.decompress(gzip.compress(record)) == record
    assert hashlib.sha1(b"").digest() and warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_rare_languages_and_bad_ids_in_training(spark):
    from pyspark.sql import functions as F

    from tallyforge.llm import language_id

    common = [(None, f"the quick brown fox number {i} jumps over a lazy dog and then sleeps " * 4, "en") for i in range(400)]
    # a language of short messages, one of a single very long text, one without letters, equal rows
    rare = [(i, f"ciao bella giornata amico mio {i}", "it") for i in range(5)] + [(7, "zażółć gęślą jaźń źrebię " * 2000, "pl"), (8, "12 34", "xx")]
    docs = spark.createDataFrame(common + rare + [rare[0]] * 500, "doc_id long, text string, lang string")
    model = dict(language_id.train(docs, F.lit(True), texts=20))
    assert set(model) == {"en", "it", "pl"} and b"ciao" in model["it"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs.filter("doc_id IS NOT NULL").dropDuplicates(), list(model.items())).collect()}
    assert got[0] == "it" and got[7] == "pl" and got[8] == "und"


def test_the_training_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyforge.llm import language_id

    docs = spark.createDataFrame([(None, f"word{'abcdefghij'[i % 10]} {'x' * i} " * 60, "en") for i in range(300)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "letters_only", lambda t: seen.append(len(t)) or " x")
    language_id.train(docs, F.lit(True), texts=20)
    assert len(seen) <= 20 and max(seen) <= language_id.TRAIN_CHARS[1]
