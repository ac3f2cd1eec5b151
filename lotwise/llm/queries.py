"""Registered queries of the operators: each applies one of them to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

import lotwise
from lotwise.llm import (
    collocations, html_text, jaccard, mixing, near_vectors, packing, personal_data, secret_scan, token_count, topk, toxicity, warc,
    whitening,
)
from lotwise.scale import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def find_package(spark: SparkSession) -> None:
    """Python workers on this machine look for the library where the driver found it, whatever folder they start in. On
    a cluster the library is installed or sent with --py-files."""
    folder, environment = str(Path(lotwise.__file__).parents[1]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if spark.sparkContext.master.startswith("local") and folder not in known:
        environment["PYTHONPATH"] = os.pathsep.join([folder, *filter(None, known)])


def query(name: str, *tables: str):
    """Register a function of some tables."""
    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            find_package(spark)
            return build(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables))

        QUERIES[name] = run
        return build

    return register


@query("op4_secret_scan", "documents")
def secret_spans(docs: DataFrame) -> DataFrame:
    found = secret_scan.scan(docs.select("doc_id", "text"))
    spans = F.col("secret_spans")

    def count(kind: str):
        k = secret_scan.KINDS.index(kind)
        return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("bigint").alias(f"n_{kind}")

    entropy = secret_scan.KINDS.index("entropy")
    base = secret_scan.span_text(F.filter(spans, lambda s: s["k"] != entropy))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("entropy"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(spans).alias("spans"))


@query("op9_source_mix", "documents")
def source_mix(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op10_best_fit_packing", "documents")
def best_fit_packing(docs: DataFrame) -> DataFrame:
    return packing.pack(docs)


@query("op5_warc_round_trip", "pages")
def warc_round_trip(pages: DataFrame) -> DataFrame:
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
 g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR first = page_id THEN NULL ELSE first END AS refers_to
FROM g"""


@query("op3_near_vectors", "embeddings")
def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    return near_vectors.near_vectors(vectors)


@query("op6_top_k_search", "embeddings")
def top_k_search(vectors: DataFrame) -> DataFrame:
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


# The inner products of all pairs are too many for a query over whole tables beyond the small scales.
ORACLES["op6_top_k_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op8_jaccard_join", "documents")
def jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard.similar_texts(docs)


@query("op1_toxicity", "documents", "labels")
def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity.fit(docs, labels).score(docs.select("doc_id", "text"), "score")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op2_token_counts", "documents")
def token_counts(docs: DataFrame) -> DataFrame:
    return token_count.count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_tokens")


@query("op7_html_text", "pages")
def page_texts(pages: DataFrame) -> DataFrame:
    return html_text.extract(pages)


@query("op11_phrase_collocations", "documents")
def phrase_collocations(docs: DataFrame) -> DataFrame:
    return collocations.collocations(docs)


# As phrases of 1 to 4 words of every place; (1 << 64) and more only in the products, which are HUGEINT.
ORACLES["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
 k AS (SELECT lang, w, unnest(range(1, 5)) AS size FROM p),
 g AS (SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
       FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM k)),
 f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
 t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
 c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 30),
 x AS (SELECT *, unnest(range(1, size)) AS k FROM c),
 y AS (SELECT x.lang, x.phrase, a, k, l.f AS l, r.f AS r, CAST((a::HUGEINT * 2000000) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
       FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(list_slice(w, 1, k), ' ')
       JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(list_slice(w, k + 1, x.size), ' ')),
 b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 i AS (SELECT lang, a, size, w, unnest(range(2, size)) AS m FROM c WHERE size > 2),
 j AS (SELECT lang, a, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase
       FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM i)),
 o AS (SELECT lang, phrase, max(a) AS longer FROM j GROUP BY 1, 2),
 z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
 q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000"""


@query("op12_embedding_whitening", "embeddings")
def embedding_whitening(vectors: DataFrame) -> DataFrame:
    """Deviations of 2^63 and more have no bigint and are null here; the operator gives them as decimals."""
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query("op13_personal_data", "documents")
def personal_spans(docs: DataFrame) -> DataFrame:
    # the texts are read once: what the model learns from and what it judges is kept as a table of candidates
    found = settle(personal_data.candidates(docs.select("doc_id", "text")).drop("text"))
    spans = personal_data.fit(found).spans(F.col("candidates"))

    def count(kind: str):
        k = personal_data.KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("bigint").alias(f"n_{kind}")

    base = personal_data.span_text(F.filter("spans", lambda s: s["k"] < personal_data.BASE))
    return found.select("doc_id", spans.alias("spans")).select(
        "doc_id", *[count(kind) for kind in personal_data.KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        personal_data.span_text(F.col("spans")).alias("spans"))


ORACLES["op9_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '') || ':mix'), 1, 15))::BIGINT AS dice
  FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
 w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
 r AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         sum(2.0::DOUBLE * source_size) OVER by_ratio - 2.0::DOUBLE * source_size AS capped,
         sum(weight) OVER () - sum(weight) OVER by_ratio + weight AS open
  FROM w WINDOW by_ratio AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT max((total - capped) / open) AS level FROM r WHERE ratio >= (total - capped) / open),
 t AS (
  SELECT source, source_size, n_docs, least(2.0::DOUBLE * source_size, weight * level) AS target FROM w, l),
 i AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS inclusion,
         greatest(0.0::DOUBLE, target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END) * source_size) AS wanted
  FROM t),
 u AS (
  SELECT d.*, i.source_size, target, inclusion, wanted, inclusion - floor(inclusion) AS p, (dice + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u,
         sqrt((size * n_docs)::DOUBLE / i.source_size::DOUBLE) AS root
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source),
 b AS (
  SELECT *, CASE WHEN source_size > 0 AND p > 0 AND p < 1 THEN least(281474976710655::BIGINT,
    CAST(floor(u / (u + (1.0::DOUBLE - u) * (p / (1.0::DOUBLE - p) * root)) * 281474976710656.0::DOUBLE) AS BIGINT)) ELSE 281474976710655::BIGINT END AS bits FROM u),
 o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bits, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS so_far FROM b),
 c AS (
  SELECT *, CAST(floor(inclusion) AS BIGINT)
            + CASE WHEN inclusion > floor(inclusion) AND so_far + size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END AS copies
  FROM o)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM c"""
