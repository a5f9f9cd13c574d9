"""A training corpus in five stages over ``documents``: quality rules, near-duplicate removal, surrogates
for personal data, mixing to source weights, and packing into sequences.

Each stage works on all rows that its predecessor kept; its result is written as Parquet in the shared
folder and read again as the next stage's documents. All stages but the last return the columns of
``documents``; a repeated document of the mix is a repeated row.

Edge rows go as the operators say: null and empty texts fail the quality rules; null ids stand last among
near-duplicates and keep a row of each group; repeated rows and ties leave one row (the smallest doc_id, then
the smallest hash); texts of any length go whole; extra columns of any name pass; empty tables give no rows.
Each stage's input folder is removed once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import mixing, packing, pii, quality, simhash
from facetry.llm.queries import vocabulary
from facetry.session import removed, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.replaced(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_dedup", keep_one_of_each_group),
    ("pii_surrogates", replace_personal_data),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            removed(before)
        before = docs
    return docs
