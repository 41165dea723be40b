"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglantern.llm import (
    collocations, disclosure, jaccard, language, licenses, lines, mixing, packing, passages, rules, secret_scan, vectors, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Licence notices in the documents."""
    return licenses.scan_licenses(table(spark, d, "documents"))


@query
def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The documents without lines that an earlier line equals or nearly equals."""
    return lines.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))


@query
def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Base measures and verdict of each document."""
    return rules.judge(table(spark, d, "documents"))


@query
def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of each document, learned from the labelled ones that are not held out."""
    return language.identify(table(spark, d, "documents"))


@query
def op5_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in the documents."""
    return secret_scan.scan_secrets(table(spark, d, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


@query
def op6_shared_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has too."""
    return passages.shared_passages(table(spark, d, "documents"))


@query
def op7_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate vectors of equal label, cosine 0.93 or more."""
    return vectors.near_vectors(table(spark, d, "embeddings"))


@query
def op8_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share four fifths of their 5-word shingles."""
    return jaccard.jaccard_classes(table(spark, d, "documents"))


@query
def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    """The documents' token ids in windows of 2048."""
    return packing.pack(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))


#: Shares of tokens wanted in a training mix.
TARGETS = {
    "source": {"src0": 0.25, "other": 0.75},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12},
    "topic": {"brief": 0.01, "short": 0.1, "medium": 0.36, "long": 0.53},
}


@query
def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    """The documents with their probability in the mix, and whether they are drawn."""
    return mixing.mix(table(spark, d, "documents"), TARGETS)


@query
def op11_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings on their first eight principal components, with unit variances."""
    found = whitening.whiten(table(spark, d, "embeddings"), "vec_id", "embedding")
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_personal_data(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in the documents, with the terms that give it away."""
    return disclosure.find_personal(table(spark, d, "documents"))


@query
def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations.collocations(table(spark, d, "documents"))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 10),
long AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
longer AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM long WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM long WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT long.* FROM long LEFT JOIN longer USING (lang, phrase) WHERE over IS NULL OR 100 * over < 50 * a),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
  FROM kept, (VALUES (1), (2)) AS t(c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN freq x ON x.lang = cuts.lang AND x.phrase = cuts.head JOIN freq y ON y.lang = cuts.lang AND y.phrase = cuts.rest),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
