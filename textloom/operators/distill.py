"""Soft labels: unique windows, the teacher join, losses, schedules, length-bucketed batches."""

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running, sliced

PAD, LONGEST, BATCH, BASE = 32, 768, 32, 256


def unique_windows(windows: DataFrame, order: list[str]) -> DataFrame:
    """hash, the first text, label and lang of each distinct window, and how many later ones have another label."""
    # summed by hash and label before the shuffle, so frequent windows travel as a row for each task and label
    first = F.min(F.struct(*order, F.struct("window_text", "label", "lang").alias("f"))).alias("first")
    each = windows.groupBy(F.sha1("window_text").alias("hash"), F.col("label").alias("_label")).agg(first, F.count("*").alias("n"))
    by = each.groupBy("hash").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list(F.when(F.col("_label").isNotNull(), F.struct("_label", "n"))).alias("labels"))
    other = F.aggregate(F.filter("labels", lambda x: x["_label"] != F.col("first.f.label")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return by.select("hash", "first.f.window_text", "first.f.label", "first.f.lang", "n", other.alias("conflicts"))


def with_teacher(windows: DataFrame, logits: DataFrame) -> DataFrame:
    """windows with soft, the teacher's logits of the window's hash, zeros where it has none."""
    windows = windows.withColumn("hash", F.sha1("window_text"))
    return windows.join(logits.select("hash", "logits"), "hash", "left").withColumn("covered", F.col("logits").isNotNull()).withColumn("soft", F.coalesce("logits", F.array(F.lit(0.0), F.lit(0.0)))).drop("logits")


def log_softmax(logits: Column, temperature: float = 1.0) -> tuple[Column, Column]:
    a, b = logits[0] / temperature, logits[1] / temperature
    top = F.greatest(a, b)
    rest = F.log(F.exp(a - top) + F.exp(b - top))
    return a - top - rest, b - top - rest


def focal_loss(logits: Column, injection: Column, gamma: float) -> Column:
    a, b = log_softmax(logits)
    ce = -F.when(injection, b).otherwise(a)
    return F.pow(1 - F.exp(-ce), F.lit(float(gamma))) * ce


def distill_loss(logits: Column, soft: Column, injection: Column, alpha: float, temperature: float, gamma: float) -> Column:
    """(1 - alpha) of the focal loss and alpha T^2 of the divergence from the teacher; soft zeros leave the latter out."""
    (pa, pb), (ta, tb) = log_softmax(logits, temperature), log_softmax(soft, temperature)
    kl = F.exp(ta) * (ta - pa) + F.exp(tb) * (tb - pb)
    kl = F.when(F.abs(soft[0]) + F.abs(soft[1]) > 0, kl).otherwise(0.0)
    return (1 - alpha) * focal_loss(logits, injection, gamma) + alpha * temperature**2 * kl


def lr_factor(step: Column, total: int, warmup: float) -> Column:
    """Warm-up to 1, then half a cosine to 0."""
    begin = max(1, int(total * warmup))
    down = 0.5 * (1 + F.cos(F.lit(math.pi) * (step - begin) / max(1, total - begin)))
    return F.when(step < begin, step / max(1, begin)).otherwise(down)


def pad_quantize(length: Column, multiple: int = PAD, most: int = LONGEST) -> Column:
    return F.least(F.lit(most), (F.ceil(length / multiple) * multiple).cast("int"))


def truncation(rows: DataFrame, length: str, cap: int, warn: float = 0.005) -> DataFrame:
    """How many lengths are beyond the cap, their share, and whether it is too much."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col(length) > cap).alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.greatest("n", F.lit(1))).withColumn("warn", F.col("share") > warn)


def token_batches(rows: DataFrame, length: str, key: str, batch: int = BATCH, budget: int | None = None, bucket: int = PAD) -> DataFrame:
    """rows with bucket and batch numbers: ascending by length, at most `batch` rows and `budget` padded tokens a batch.

    Within a bucket (one padded length) all rows pad alike, so how many fit is
    known and row numbers give the batches. Keys are integers.
    """
    budget = budget or batch * BASE
    rows = rows.withColumn("padded", F.greatest(pad_quantize(F.col(length), bucket), F.lit(bucket)))
    fit = F.least(F.lit(batch), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded")).cast("int")))
    rows = running(rows, ["padded"], [F.col(length), sliced(key)], [length, key], F.lit(1), "_place")
    return rows.withColumn("batch", F.floor(F.col("_place") / fit).cast("int")).drop("_place")


def batch_order(batches: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Distinct batches in an order that depends on seed and epoch only."""
    return batches.select("padded", "batch").distinct().orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "padded", "batch"), "padded", "batch")


def eta_seconds(done_rows: int, seconds: float, rows: int, epochs: int) -> float:
    return rows * epochs * seconds / max(1, done_rows)


def infer(windows: DataFrame, session_of: Callable, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """windows with logits of an ONNX model; session_of() opens it once for each batch iterator of a worker."""

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np

        session = session_of()
        names = [x.name for x in session.get_inputs()]
        for own_ids, own_mask in batches:
            feed = dict(zip(names, (np.array(own_ids.tolist(), np.int64), np.array(own_mask.tolist(), np.int64))))
            yield pd.Series(session.run(None, feed)[0].astype(float).tolist())

    return windows.withColumn("logits", logits(ids, mask))
