"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts. A
text is encoded with every dictionary and takes the language that leaves the
fewest bytes. The score is the margin to the second best as a share of its
size; texts below ``min_margin`` are rejected.

Only letters count: a text is reduced to its lower-case words, each once, so
repeated lines, numbers and markup do not drown the language. Every word of the
whole text is used. Equal sizes go to the language with more training texts.

Defined cases: null, empty or letterless text is ``und`` with score 0 and is
rejected; with no labelled text at all everything is; a language without a labelled letter
is never predicted; with one language its
margin is 1. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import col, id_and_text, short_batches

UNKNOWN = "und"
MIN_MARGIN = 0.01
LEVEL = 6
#: Bound of the training sample: texts per language, their length in characters, and bytes of a dictionary.
TRAIN_TEXTS = 200
TRAIN_CHARS = (200, 20_000)
DICTIONARY_BYTES = 100 << 10
#: A text below so many bytes is encoded so many times over: an encoder stores tiny inputs as they are, which tells nothing.
SHORT_BYTES, REPEATS = 200, 8
PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"
_WORD = re.compile(r"[^\W\d_]+")


def letters_only(text: str) -> str:
    """The distinct lower-case words of a text in order of appearance."""
    return " " + " ".join(dict.fromkeys(_WORD.findall(text.lower())))


def train(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          texts: int = TRAIN_TEXTS, chars: tuple[int, int] = TRAIN_CHARS,
          size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of texts, from ``texts`` rows a language.

    Texts of ``chars`` characters come first, in hash order; a language with too
    few of them is filled up with shorter texts and with longer ones, of which
    it learns from the first ``chars[1]`` characters. The sample is ranked
    without texts; what reaches the driver is bounded by languages x ``texts``
    rows of ``chars[1]`` characters, whatever the ids (equal rows count once).
    """
    rows = (docs.filter(labelled & col(lang_col).isNotNull())
            .select(col(id_col).alias("doc_id"), col(lang_col).alias("lang"), col(text_col).alias("text")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    keyed = (rows.filter(F.length("text") > 0)
             .select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("h"), F.length("text").between(*chars).alias("fits")))
    ranked = (keyed.select("lang", "h", "fits")
              # each task passes on its own first rows of a language only
              .selectExpr("lang", "h", "row_number() OVER (PARTITION BY lang ORDER BY fits DESC, h) AS place")
              .filter(F.col("place") <= texts))
    wanted = [r["h"] for r in ranked.select("h").distinct().collect()]
    taken = (keyed.filter(F.col("h").isin(wanted)).groupBy("lang", "h").agg(F.min(F.left("text", F.lit(chars[1]))).alias("text"))
             .collect() if wanted else [])
    found: dict[str, list] = {lang: [] for lang in counts}
    for r in sorted(taken, key=lambda r: (r["h"], r["text"])):
        words = letters_only(r["text"])
        if words.strip():
            found[r["lang"]].append(words)
    # the end of a dictionary is nearest to the text and cheapest to refer to
    return [(lang, "".join(found[lang]).encode("utf-8", "surrogatepass")[-size:])
            for lang in sorted(found, key=lambda x: (-counts[x], x)) if found[lang]]


def predict(docs: DataFrame, model: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text",
            min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, where it is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model, level)
        for batch in batches:
            rows = [classify(t) for t in batch.column(1).to_pylist()]
            langs, scores = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([lang == UNKNOWN or s < min_margin for lang, s in rows], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PREDICTED)


class Classifier:
    """A text's language and margin under dictionaries given by falling prior."""

    def __init__(self, model: list[tuple[str, bytes]], level: int = LEVEL):
        import zstandard

        self.encoders = []
        for lang, raw in model:
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            self.encoders.append((lang, zstandard.ZstdCompressor(
                level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str) -> tuple[str, float]:
        words = letters_only(text) if any(map(str.isalpha, text)) else ""
        if not words.strip() or not self.encoders:
            return UNKNOWN, 0.0
        raw = words.encode("utf-8", "surrogatepass")
        if len(raw) < SHORT_BYTES:
            raw *= REPEATS
        sizes = [len(encoder.compress(raw)) for _, encoder in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1:]
        return self.encoders[best][0], (min(rest) - sizes[best]) / min(rest) if rest else 1.0


def keep_identified(docs: DataFrame, model: list[tuple[str, bytes]], text_col: str = "text",
                    min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """The rows whose language is clear, columns unchanged; texts are judged where they are scanned."""
    names = docs.schema
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model, level)
        at = names.names.index(text_col)
        for batch in batches:
            judged = [classify(t or "") for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_margin for lang, s in judged], pa.bool_()))

    return docs.mapInArrow(run, names)
