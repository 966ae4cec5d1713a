"""The corpus pipeline: toxicity, exact duplicates, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared checkpoint
folder and read again as the next one's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm import fingerprints, jaccard, mixing, packing, queries, toxicity
from portolan.llm.shared import read, stored

TOXIC_FROM = 0.5
#: Wanted shares of tokens, those the stage was first written with: they are not fitted to a table. With the total "enough" no document is thinned; what is short is repeated.
MIXTURE = {"good": 0.88, "poor": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC_FROM``."""
    model = toxicity.trained(docs, read(spark, sf_dir, "labels"), toxicity.learnt_rows(5, 0))
    return toxicity.ordinary(docs, model, TOXIC_FROM)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to white space: one with the smallest id."""
    key = lambda sha: F.concat_ws(":", F.col("doc_id").cast("string"), sha)
    copies = fingerprints.exact_duplicates(docs).filter("not kept").select(key(F.col("text_sha256")).alias("__copy")).distinct()
    keyed = docs.withColumn("__key", key(fingerprints.text_sha256("text")))
    return keyed.join(copies, keyed["__key"] == copies["__copy"], "left_anti").dropDuplicates(["__key"]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: the one with the smallest id. Groups of null ids only stay."""
    found = jaccard.near_duplicates(docs)
    copies = found.filter("component_id is not null and not doc_id <=> component_id").select(F.col("row_key").alias("__copy"), F.col("doc_id").alias("__id")).distinct()
    keyed = docs.withColumn("__key", jaccard.row_key("doc_id", "text"))
    same = (keyed["__key"] == copies["__copy"]) & keyed["doc_id"].eqNullSafe(copies["__id"])
    return keyed.join(copies, same, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that good and poor texts have their shares of tokens."""
    labelled = mixing.domains_of(read(spark, sf_dir, "labels")).filter(F.col("domain").isin(*MIXTURE))
    return mixing.mixed(docs, labelled, MIXTURE, "enough")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids."""
    return packing.pack(docs, queries.word_bpe()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_duplicates), ("n-gram Jaccard join", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Learnt scores and rates are beyond SQL; the tests check each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
