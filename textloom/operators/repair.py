"""Language repair with a ledger in the notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Sources whose language was guessed, and the languages a guess can be besides en.
GUESSED_SOURCES = ("llmail", "jackhhao", "deepset", "bipia", "bipia-ctx", "nemotron", "synthetic", "email-benign")
GUESSED_LANGS = ("zh", "ru", "ar", "tr", "de", "fr")
NOTE = r"lang-fix:([\p{L}\p{N}_]+)->([\p{L}\p{N}_]+)"


def repair(rows: DataFrame, sources: tuple[str, ...] = GUESSED_SOURCES, langs: tuple[str, ...] = GUESSED_LANGS) -> DataFrame:
    """rows with the language guessed anew where it had been guessed, old_lang and was_candidate.

    The notes keep one entry, from the first language to the last; a row that is
    back at its first language has none. Repairing again changes nothing.
    """
    notes = F.coalesce("notes", F.lit(""))
    prior = F.regexp_extract(notes, NOTE, 1)
    rows = rows.withColumn("old_lang", F.col("lang")).withColumn("was_candidate", F.coalesce(F.col("source").isin(*sources) & (F.coalesce(F.col("lang").isin(*langs), F.lit(False)) | (prior != "")), F.lit(False)))
    rows = rows.withColumn("_orig", F.when(prior != "", prior).otherwise(F.col("lang")))
    rows = rows.withColumn("lang", F.when(F.col("was_candidate"), T.guess_lang(F.col("text"))).otherwise(F.col("lang")))
    base = T.strip(F.regexp_replace(F.regexp_replace(notes, NOTE, ""), r"\A[ |]+|[ |]+\z", ""))
    entry = F.concat(F.lit("lang-fix:"), "_orig", F.lit("->"), "lang")
    new = F.when(F.col("lang") == F.col("_orig"), base).when(base == "", entry).otherwise(F.concat(base, F.lit(" | "), entry))
    return rows.withColumn("notes", F.when(F.col("was_candidate"), new).otherwise(F.col("notes"))).drop("_orig")


def transitions(repaired: DataFrame) -> DataFrame:
    """How many rows went from one language to another, by source."""
    return repaired.filter(F.col("old_lang") != F.col("lang")).groupBy("old_lang", F.col("lang").alias("new_lang"), "source").agg(F.count("*").alias("n"))


def rewrite(repaired: DataFrame, path: str) -> bool:
    """Writes a new version beside path and swaps it in, only if something changed."""
    if repaired.filter(F.col("was_candidate") & (F.col("old_lang") != F.col("lang"))).isEmpty():
        return False
    spark = repaired.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    repaired.drop("old_lang", "was_candidate").write.mode("overwrite").parquet(f"{path}.new")
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(f"{path}.old"), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.new"), at(path))
    fs.delete(at(f"{path}.old"), True)
    return True
