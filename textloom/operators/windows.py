"""Overlapping character windows, their labels, and pooling back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SPARSE_SOURCES, STRIDE_CHARS, WINDOW_CHARS


def window_count(text: Column) -> Column:
    n = F.length(text)
    more = F.ceil((n - WINDOW_CHARS) / F.lit(float(STRIDE_CHARS)))
    return F.when(n == 0, 0).otherwise(F.greatest(more, F.lit(0)) + 1).cast("int")


def char_windows(text: Column) -> Column:
    """array<struct<start,end,text>>: every character is in a window, the last one ends with the text; none for an empty text."""
    at = lambda i: (i * STRIDE_CHARS).cast("int")
    one = lambda i: F.struct(at(i).alias("start"), F.least(at(i) + WINDOW_CHARS, F.length(text)).alias("end"), F.substr(text, at(i) + 1, F.lit(WINDOW_CHARS)).alias("text"))
    kind = "array<struct<start:int,end:int,text:string>>"
    return F.when(window_count(text) > 0, F.transform(F.sequence(F.lit(0), window_count(text) - 1), one)).when(text.isNotNull(), F.array().cast(kind))


def explode_windows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, idx, n_windows and start, end and text of each window; full texts do not go on."""
    out = docs.select(*keep, window_count(F.col(text)).alias("n_windows"), F.posexplode(char_windows(F.col(text))).alias("idx", "w"))
    return out.select(*keep, "n_windows", "idx", "w.start", "w.end", F.col("w.text").alias("window_text"))


def position_hint(source: Column, notes: Column, strict: bool = False) -> Column:
    """The second part of notes, between slashes, for sources whose texts hold one spliced passage; else empty.

    What a later entry added behind a bar does not belong to it, unless strict.
    """
    part = F.coalesce(F.try_element_at(F.split(notes, "/"), F.lit(2)), F.lit(""))
    part = part if strict else F.regexp_replace(part, r" *\|.*", "")
    return F.when(source.isin(*SPARSE_SOURCES), part).otherwise("")


def hint_index(hint: Column, count: Column) -> Column:
    return F.when(hint == "start", 0).when(hint == "end", count - 1).otherwise(F.floor(count / 2)).cast("int")


def training_windows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Windows of docs (label, source, hint) with labels: of a spliced text only the window the hint names stays."""
    cols = list(dict.fromkeys([*keep, "label", "source", "hint"]))
    out = explode_windows(docs, cols)
    sparse = (F.col("label") != "benign") & F.col("source").isin(*SPARSE_SOURCES) & (F.col("n_windows") > 1)
    return out.filter(~F.coalesce(sparse, F.lit(False)) | (F.col("idx") == hint_index(F.col("hint"), F.col("n_windows"))))


def max_pool(docs: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """docs with doc_score, the largest of the windows' scores; 0 for a document without windows."""
    best = scores.groupBy(key).agg(F.max("score").alias("doc_score"))
    return docs.join(best, key, "left").withColumn("doc_score", F.coalesce("doc_score", F.lit(0.0)))


def top_window(scores: DataFrame, key: str) -> DataFrame:
    """Score, idx and text of each document's best window; the earliest of equal ones."""
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("idx")).alias("back"), "window_text")).alias("b"))
    return best.select(key, F.col("b.score").alias("score"), (-F.col("b.back")).alias("idx"), F.col("b.window_text").alias("window_text"))


def index_percentile(df: DataFrame, value: str, points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """For each group and p, the element of the sorted values at min(n - 1, int(n * p)).

    Values are counted first, so ties are one row each; a running sum over the
    distinct values of a group finds the place. Lengths and other integers have
    few of these.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = counts.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(float(p),) for p in points], "p double")))  # a few points
    place = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.col("p")))
    return at.filter((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c"))).select(*by, "p", F.col("_n").alias("n"), F.col(value).alias("value"))
