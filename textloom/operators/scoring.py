"""Predictions against labels: joins, confusion, recall by language, threshold sweeps, drill-down, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import MIN_LANG_POS, SCORE_THRESHOLD, SWEEP


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def last_predictions(rows: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """id and pred of (id, pred, score, ordinal): pred before score; rows with neither do not count; the last of an id wins."""
    verdict = F.coalesce("pred", F.when(F.col("score") >= threshold, "injection").when(F.col("score").isNotNull(), "benign"))
    rows = rows.withColumn("pred", verdict).filter(F.col("pred").isNotNull())
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ordinal")))).filter("_r = 1").select("id", "pred")


def confusion(rows: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """tp, fp, tn, fn, missing, precision, recall, f1, fp_rate, fp_hard_rate over (label, pred, fp_hard); rates are 0 where their base is.

    With a weight each row counts that often.
    """
    inj, hit, there = F.col("label") == "injection", F.col("pred") == "injection", F.col("pred").isNotNull()
    hard = there & ~inj & F.col("fp_hard")
    cases = {"tp": inj & hit, "fp": ~inj & hit, "tn": ~inj & there & ~hit, "fn": inj & there & ~hit, "missing": ~there, "fp_hard_total": hard, "fp_hard_fp": hard & hit}
    count = F.count_if if weight is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0)).cast("bigint")
    out = rows.groupBy(*(by or [])).agg(*[count(c).alias(k) for k, c in cases.items()])
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    # 2PR / (P + R) is 2 tp / (2 tp + fp + fn)
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fp_rate": ratio(fp, fp + tn), "fp_hard_rate": ratio(F.col("fp_hard_fp"), F.col("fp_hard_total"))})


def lang_recall(rows: DataFrame, least: int = MIN_LANG_POS) -> DataFrame:
    """positives, tp, recall and whether there are enough to measure, for each language; a null one is '?'."""
    rows = rows.filter((F.col("label") == "injection") & F.col("pred").isNotNull())
    out = rows.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("positives"), F.count_if(F.col("pred") == "injection").alias("tp"))
    return out.withColumn("recall", ratio(F.col("tp"), F.col("positives"))).withColumn("measurable", F.col("positives") >= least)


def sweep(scored: DataFrame, points: tuple[float, ...] = SWEEP) -> DataFrame:
    """The confusion table of (label, fp_hard, doc_score) at each threshold. Rows are counted by how many thresholds they reach first, so each goes through once."""
    reached = sum((F.when(F.col("doc_score") >= p, 1).otherwise(0) for p in points), F.lit(0))
    each = scored.groupBy("label", "fp_hard", reached.alias("reached")).agg(F.count("*").alias("n"))
    grid = scored.sparkSession.createDataFrame([(float(p), sum(q <= p for q in points)) for p in points], "thr double, place int")
    each = each.crossJoin(F.broadcast(grid))  # a few rows of counts, a few thresholds
    return confusion(each.withColumn("pred", F.when(F.col("reached") >= F.col("place"), "injection").otherwise("benign")), ["thr"], "n")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The smallest threshold with an F1 above that at 0.5, where there is one, else 0.5."""
    return swept.orderBy(F.desc("f1"), F.desc(F.col("thr") == 0.5), F.asc("thr")).limit(1).select("thr", "f1")


def drill_down(scored: DataFrame, tops: DataFrame, key: str, least: float = 0.60, all_fp: bool = False) -> DataFrame:
    """Benign documents (hard ones, or all) with a score from `least` on, best first, with snippets of text and of the best window."""
    rows = scored.filter((F.col("label") == "benign") & (F.col("doc_score") >= least))
    rows = rows if all_fp else rows.filter("fp_hard")
    rows = rows.join(tops.select(key, "window_text"), key)
    return rows.select(key, "doc_score", "fp_hard", "lang", "source", "channel", "id", T.snippet(F.col("text"), 160).alias("doc_head"), T.snippet(F.col("window_text"), 300).alias("top_window")).orderBy(F.desc("doc_score"), key)


def parity(a: DataFrame, b: DataFrame, c: DataFrame, key: str, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """Largest difference of logits and number of other verdicts of b and c against a: one row."""
    rows = a.select(key, F.col("logits").alias("x")).join(b.select(key, F.col("logits").alias("y")), key).join(c.select(key, F.col("logits").alias("z")), key)
    far = lambda p, q: F.greatest(F.abs(F.col(p)[0] - F.col(q)[0]), F.abs(F.col(p)[1] - F.col(q)[1]))
    yes = lambda p: T.softmax_injection(F.col(p)) >= threshold
    return rows.agg(F.count("*").alias("windows"), F.max(far("x", "y")).alias("max_delta_b"), F.max(far("x", "z")).alias("max_delta_c"), F.count_if(yes("x") != yes("y")).alias("flips_b"), F.count_if(yes("x") != yes("z")).alias("flips_c"))


def score_once(rows: DataFrame, text: str, scorer) -> DataFrame:
    """rows with the scorer's columns; each distinct text goes through it once. scorer: DataFrame (hash, text) -> (hash, columns)."""
    rows = rows.withColumn("_h", F.sha1(text))
    unique = rows.groupBy("_h").agg(F.first(text).alias("text")).withColumnRenamed("_h", "hash")
    got = scorer(unique).drop("text").withColumnRenamed("hash", "_h")
    return rows.join(got, "_h", "left").drop("_h")
