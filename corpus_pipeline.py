"""From raw documents to token shards: language ID, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and is
written before the next one reads it. All but the last return the columns of
documents; the last writes the shards and returns the table of their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import scratch, table, unused
from textloom.llm.decontaminate import decontaminate
from textloom.llm.langid import reject_unknown
from textloom.llm.mixing import CURRICULUM, training_order
from textloom.llm.queries import tokenizer_path
from textloom.llm.simhash import keep_one
from textloom.llm.token_shards import write_manifest, write_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without a letter, and those far from all profiles, go."""
    return reject_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of exact and near copies."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: contaminated ones go, from others the passages do."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    position = unused(docs, "position")
    return training_order(docs, position=position, phases=CURRICULUM, shares=False).drop(position)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the token shards."""
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    found, folder = write_shards(docs, tokenizer)
    write_manifest(found, folder, tokenizer)
    return found


STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("source_mixing", mixture), ("token_shards", shards)]

#: Near duplicates and the mix's order rest on hashes that SQL engines lack; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
