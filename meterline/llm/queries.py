"""Registered queries of the dealt operators, each over its whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import bpe, dialogues, divergence, infill, language_model, lattice, licences, minhash, neighbours, packing, quality, substrings, urls
from meterline.llm.tables import table, vocabulary


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.perspectives(table(spark, sf_dir, "conversations"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(table(spark, sf_dir, "documents"))


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").withColumn("path", F.expr(licences.PATH_SPARK))
    return licences.scan(files)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.listed_domains(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_perspectives": op2_perspectives,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_bloom_lm": op6_bloom_lm,
    "op7_kmeans_tree": op7_kmeans_tree,
    "op8_substrings": op8_substrings,
    "op9_minhash": op9_minhash,
    "op10_licences": op10_licences,
    "op11_divergence": op11_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_cascade": op13_url_cascade,
}

#: Components by plain reachability over links (u, v), both ways, of "nodes".
_REACH = """reach(id, r) AS (
  SELECT id, id FROM nodes UNION SELECT l.v, reach.r FROM reach JOIN (SELECT u, v FROM links UNION SELECT v, u FROM links) l ON l.u = reach.id),
component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

_OP1_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
good AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.id AS u, b.id AS v FROM good a JOIN good b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
degree AS (SELECT id, count(*) AS n FROM (SELECT u AS id FROM links UNION ALL SELECT v FROM links) GROUP BY id),
{_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
FROM nodes LEFT JOIN degree USING (id) JOIN component USING (id)
"""

_OP9_SQL = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM nodes LEFT JOIN sizes ON sizes.doc_id = id JOIN component USING (id)
"""

SQL: dict[str, str] = {
    "op1_lattice": _OP1_SQL,
    "op2_perspectives": dialogues.SQL,
    "op9_minhash": _OP9_SQL,
    "op10_licences": licences.SQL,
    "op11_divergence": divergence.SQL,
    "op12_fill_in_middle": infill.SQL,
    "op13_url_cascade": urls.SQL,
}
