"""The tables the queries read, in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as corpus rows, in the order of their ids."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        "doc_id", F.col("doc_id").alias("ordinal"), "text", F.when(F.col("toxic") == 1, "injection").otherwise("benign").alias("label"), "source", F.lit("synthetic").alias("license"), "lang",
        F.lit("url_text").alias("channel"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("weak_seed"), F.lit(False).alias("is_synthetic"), F.lit(False).alias("is_translated"), F.lit("").alias("group"), F.lit("").alias("notes"),
    )


def spliced(rows: DataFrame) -> DataFrame:
    """corpus rows, every fifth of them in the role of a text with one spliced passage at a known position."""
    position = F.element_at(F.array(F.lit("start"), F.lit("end"), F.lit("middle")), (F.col("doc_id") % 3 + 1).cast("int"))
    fifth = F.col("doc_id") % 5 == 0
    return rows.withColumn("source", F.when(fifth, "bipia-ctx").otherwise(F.col("source"))).withColumn("notes", F.when(fifth, F.concat(F.lit("indirect/"), position)).otherwise(""))


def simple_rows(df: DataFrame, ordinal: Column, text: Column, source: str, channel: str, group: Column | None = None) -> DataFrame:
    none = F.lit("")
    return df.select(ordinal.alias("ordinal"), text.alias("text"), F.lit("benign").alias("label"), F.lit(source).alias("source"), F.lit("synthetic").alias("license"), none.alias("lang"), F.lit(channel).alias("channel"), F.lit(False).alias("weak_seed"), F.lit(False).alias("is_synthetic"), F.lit(False).alias("is_translated"), (none if group is None else group).alias("group"), none.alias("notes"))


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The text tables as sources, in the order in which they are merged."""
    docs, pages, chats, bench = (table(spark, sf_dir, n) for n in ("documents", "pages", "conversations", "benchmark"))
    return {
        "documents": simple_rows(docs, F.col("doc_id"), F.col("text"), "documents", "url_text"),
        "pages": simple_rows(pages, F.col("page_id"), F.col("html"), "pages", "url_text"),
        "conversations": simple_rows(chats, F.col("conv_id") * 1_000_000 + F.col("turn"), F.col("text"), "conversations", "chat", F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))),
        "benchmark": simple_rows(bench, F.col("item_id"), F.col("text"), "benchmark", "url_text"),
    }
