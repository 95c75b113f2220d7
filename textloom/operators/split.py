"""Group-aware train and evaluation sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import EVAL_PERCENT, FP_HARD_EVAL_PERCENT


def group_key(group: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), F.concat(F.lit("row-"), T.dedup_key(text)))


def assign(rows: DataFrame, eval_percent: int = EVAL_PERCENT, hard_percent: int = FP_HARD_EVAL_PERCENT) -> DataFrame:
    """rows with id, fp_hard, gk and side. Rows of a group fall on one side; weak and synthetic ones train."""
    rows = rows.withColumn("id", F.sha1("text")).withColumn("fp_hard", (F.col("label") == "benign") & T.is_fp_hard(F.col("text"))).withColumn("gk", group_key(F.col("group"), F.col("text")))
    forced = F.coalesce(F.col("weak_seed"), F.lit(False)) | F.coalesce(F.col("is_synthetic"), F.lit(False))
    boosted = F.col("fp_hard") & (F.coalesce("group", F.lit("")) == "") & ~forced
    below = F.when(boosted, hard_percent).otherwise(eval_percent)
    return rows.withColumn("side", F.when(~forced & (T.hash_bucket(F.col("gk"), 100) < below), "eval").otherwise("train"))


def without(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    """Rows whose id is not a suspect's."""
    return rows.join(suspects.select("id").distinct(), "id", "left_anti")


def excluded_by_source(rows: DataFrame, suspects: DataFrame) -> DataFrame:
    return rows.join(suspects.select("id").distinct(), "id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def leaks(rows: DataFrame) -> DataFrame:
    """Groups that have rows on both sides."""
    return rows.filter("side = 'train'").select("gk").intersect(rows.filter("side = 'eval'").select("gk"))


def check_leaks(rows: DataFrame) -> None:
    if found := leaks(rows).limit(5).collect():
        raise ValueError(f"groups on both sides: {[r['gk'] for r in found]}")


def snapshot(rows: DataFrame, ordinal: str, first: int, expect_eval: int | None = None, hard_percent: int = FP_HARD_EVAL_PERCENT) -> DataFrame:
    """The split of the first rows, in order; raises if the evaluation side has not the number expected. Under the old rules hard rows are split like all others (hard_percent=EVAL_PERCENT)."""
    out = assign(rows.filter(F.col(ordinal) < first), hard_percent=hard_percent)
    if expect_eval is not None and (n := out.filter("side = 'eval'").count()) != expect_eval:
        raise ValueError(f"{n} rows on the evaluation side, not {expect_eval}")
    return out


def write_split(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("side").parquet(path)
