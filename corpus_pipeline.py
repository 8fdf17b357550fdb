"""From raw documents to packed training sequences, in stages that are each written before the next reads them.

1. quality    (operator 4) documents that the classifier scores below 0.3 go
2. minhash    (operator 9) of each group of near duplicates (five-word shingles, similarity 0.8) the least id stays
3. substrings (operator 8) passages of 200 bytes or more that occur twice are cut out of the texts
4. packing    (operator 5) every token of what is left lies in exactly one sequence

All but the last return the columns of documents, extra ones included.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import minhash, packing, quality, substrings
from meterline.llm.tables import table, vocabulary
from meterline.session import scratch_path

#: A passage of fifty words, short ones included, has more bytes than this.
PASSAGE = 200


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of the least id, a null id last.

    A row is known by its id and text together: of rows that repeat both one stays, different texts
    of one id are documents of their own, and so are texts without an id.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = minhash.near_duplicates(keyed, threshold=80, id_column="__key").select("__key", "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first")
    best = keyed.select("__key", "doc_id").join(found, "__key").groupBy("component_id").agg(first).select(F.col("first.__key").alias("__key"))
    return keyed.join(best, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("minhash", distinct),
    ("substrings", unrepeated),
    ("packing", packed),
]

#: The stages train a classifier, sign documents and tokenize texts: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
