"""Queries of the training-data operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import (
    centroids, decontaminate, exact_dedup, exact_topk, html_text, language_id, minhash, packing, pii, substring_dedup, suffix_dedup,
    warc, whitening)

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """A third of the documents that no classifier learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# five hex digits are 20 bits, four letters of base32
ORACLES["op2_warc_archives"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


@query
def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


# every string of 100 bytes as hex digits; positions count from 0
ORACLES["op3_repeated_strings"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT doc_id, unnest(range(n - 99)) AS place, x FROM d WHERE n >= 100),
repeated AS (SELECT list((doc_id, place)) AS spots, min((doc_id, place)) AS first FROM strings
  GROUP BY substr(x, 2 * place + 1, 200) HAVING count(*) > 1),
later AS (SELECT spot[1] AS doc_id, spot[2] AS place FROM (SELECT unnest(spots) AS spot, first FROM repeated) WHERE spot <> first),
marked AS (SELECT *, coalesce(place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > 100, true) AS opens FROM later),
numbered AS (SELECT *, count_if(opens) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marked),
runs AS (SELECT doc_id, min(place) AS a, max(place) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT g.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(d.x), 2 * max(b) + 1) AS kept
  FROM gaps AS g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(c.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN cut AS c ON c.doc_id = d.doc_id
"""


@query
def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    filled = F.array(*[F.when(F.col(c) != "", F.col(c)) for c in ("base", "extra")])
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"),
                        F.concat_ws(",", filled).alias("spans"))


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # this query's own shingle length; the operator's default is five words
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


# Equal sets are one class. Two sets of similarity 0.8 share one of the rarest fifth of either's shingles.
ORACLES["op6_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM w),
classes AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT c, n, unnest(s) AS shingle FROM classes),
ordered AS (SELECT c, n, shingle, row_number() OVER (PARTITION BY c ORDER BY docs, shingle) AS place FROM (
  SELECT *, count(*) OVER (PARTITION BY shingle) AS docs FROM shingles)),
heads AS MATERIALIZED (SELECT c, n, shingle FROM ordered WHERE place <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM heads AS a JOIN heads AS b ON b.shingle = a.shingle AND a.c < b.c
  WHERE 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
links AS MATERIALIZED (SELECT a, b FROM (SELECT p.a, p.b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS shared
  FROM pairs AS p JOIN classes AS x ON x.c = p.a JOIN classes AS y ON y.c = p.b) WHERE 100 * shared >= 80 * (total - shared)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT c, c AS other FROM classes UNION SELECT r.c, ways.b FROM reached AS r JOIN ways ON ways.a = r.other),
parts AS (SELECT c, min(other) AS component_id FROM reached GROUP BY c)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id,
  coalesce(p.component_id, d.doc_id) = d.doc_id AS kept
FROM sets AS d LEFT JOIN classes AS k ON k.s = d.s LEFT JOIN parts AS p ON p.c = k.c
"""


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.col("digest").alias("text_sha256"))


ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


# a word is covered by the windows that start at it or up to 34 words before
ORACLES["op10_repeated_windows"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, w[place] AS word, place, CASE WHEN place + 34 <= len(w) THEN array_to_string(w[place:place + 34], ' ') END AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d)),
counted AS (SELECT *, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM words),
covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (SELECT doc_id, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(CAST(k.n_removed AS BIGINT), 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""


@query
def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows, k=5, factor=256)


_WHOLE = """embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)), false)"""


def _floors(factor: int) -> str:
    return f"list_transform(embedding, lambda v: floor({factor} * CAST(v AS DOUBLE)))"


ORACLES["op11_exact_top_k"] = f"""
WITH rows AS (SELECT vec_id, {_floors(256)} AS x FROM embeddings WHERE {_WHOLE}),
scores AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.x, r.x) AS BIGINT) AS score
  FROM rows AS q JOIN rows AS r ON r.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(table(spark, sf_dir, "embeddings"), components=32, factor=64, shift=1_000_000)


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.inertias(*centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, factor=1024, dims=64))


def _cluster_sql(rounds: int = 10) -> str:
    """The rounds one after another: ``c0`` has the first centroids, ``c1`` those after a round, and so on."""
    nearest = """SELECT vec_id, number AS cluster, distance FROM (SELECT *, row_number() OVER (
  PARTITION BY vec_id ORDER BY distance, number) AS place FROM (
    SELECT v.vec_id, c.number, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM v, {c} AS c)) WHERE place = 1"""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform({_floors(1024)}, lambda f: CAST(f AS BIGINT)) AS x
  FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64)""",
             """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), x) - 1 AS number, x
  FROM v ORDER BY number LIMIT 8)"""]
    for r in range(rounds):
        # a division that rounds down, below 0 too
        parts.append(f"""m{r} AS (SELECT cluster, place, ((s - ((s % n) + n) % n) // n) AS value FROM (
  SELECT cluster, place, CAST(sum(value) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT a.cluster, unnest(v.x) AS value, generate_subscripts(v.x, 1) AS place
    FROM ({nearest.format(c=f"c{r}")}) AS a JOIN v ON v.vec_id = a.vec_id) GROUP BY ALL))""")
        parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.number, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN (
  SELECT cluster, list(value ORDER BY place) AS x FROM m{r} GROUP BY cluster) AS m ON m.cluster = c.number)""")
    parts.append(f"a AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})")
    return f"""WITH {', '.join(parts)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN c{rounds} AS c ON c.number = a.cluster"""


ORACLES["op13_centroid_clusters"] = _cluster_sql()
