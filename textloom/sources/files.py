"""Readers of line-based and nested JSON files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema=S.ROW, missing_ok: bool = True, drop_malformed: bool = False) -> DataFrame:
    """One JSON object a line, ended by \\n only; blank lines do not count. A missing file is an empty table, or an error.

    A malformed line is a row of nulls, or dropped.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, lineSep="\n", mode="DROPMALFORMED" if drop_malformed else "PERMISSIVE")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ordinal (from 0, by file and place) of each line. The lines before a partition are counted first."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = lines.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.withColumn("_p", part).join(F.broadcast(before), "_p").select("value", (F.col("before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("ordinal"))


def suspects(spark: SparkSession, path: str) -> DataFrame:
    """id and reason; blank lines and those that begin with # do not count. A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], S.SUSPECT)
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.from_json("value", S.SUSPECT).alias("r")).select("r.*").filter("id is not null")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """id, pred, score and ordinal of each line."""
    return numbered_lines(spark, path).select(F.from_json("value", S.PREDICTION).alias("r"), "ordinal").select("r.*", "ordinal").filter("id is not null")


def teacher_logits(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, S.TEACHER, missing_ok=False)


def json_lists(spark: SparkSession, path: str) -> DataFrame:
    """category, ordinal in it, and text, of one JSON object of lists."""
    whole = spark.read.option("wholetext", True).text(path)
    lists = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("category", "texts"))
    return lists.select("category", F.posexplode("texts").alias("ordinal", "text"))


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation side of a split; an error if there is none. Only that partition is read."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path).filter("side = 'eval'")


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes and sha256 of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
