"""Rows to corpus: validity, order-aware deduplication and caps, idempotent append, composition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import CHANNELS, LABELS, MAX_CHARS, MIN_CHARS, REAL_POSITIVE_FLOOR
from .order import once, running, sliced


@dataclass(frozen=True)
class Adapter:
    """A named source: a function that gives its rows, with their order in column `ordinal`, and caps on them.

    cap: rows taken of each group of the columns cap_by; where `page` names a
    column, whole pages are taken as long as fewer rows than that were accepted.
    """

    name: str
    rows: Callable[[], DataFrame]
    cap_by: tuple[str, ...] = ()
    cap: int | None = None
    page: str | None = None


def finalize(rows: DataFrame, nfc: bool = True) -> DataFrame:
    """Rows with normalised text and a language where they had none."""
    rows = once(rows, "text", T.norm_text(F.col("text"), nfc))
    return rows.withColumn("lang", F.when(F.coalesce("lang", F.lit("")) == "", T.guess_lang(F.col("text"))).otherwise(F.col("lang")))


def is_valid() -> Column:
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.coalesce(F.col("label").isin(*LABELS) & F.col("channel").isin(*CHANNELS) & (F.length(T.strip(F.col("text"))) > 0) & there("source") & there("license"), F.lit(False))


def has_length(low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    return F.length("text").between(low, high)


def first_wins(rows: DataFrame, order: list[str], key: str = "dk") -> DataFrame:
    """The first row, in the given order, of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def capped(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows, in order, of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def whole_pages(rows: DataFrame, page: str, most: int, accepted: Column | None = None) -> DataFrame:
    """Rows of the pages before which fewer than `most` rows were accepted."""
    per = rows.groupBy(page).agg(F.sum(F.lit(1) if accepted is None else accepted).alias("_n"))
    before = running(per, [], [sliced(page)], [page], F.col("_n"), "_before")
    return rows.join(before.filter(F.col("_before") < most).select(page), page, "left_semi")


def staged(rows: DataFrame, nfc: bool = True) -> DataFrame:
    """Rows with stage: bad, len or ok, and dk, the key of those that are ok."""
    rows = finalize(rows, nfc)
    stage = F.when(~is_valid(), "bad").when(~has_length(), "len").otherwise("ok")
    rows = once(rows, "stage", stage)
    return once(rows, "dk", F.when(F.col("stage") == "ok", T.dedup_key(F.col("text"))))


def merge(adapters: list[Adapter], known: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] | None = None, nfc: bool = True, failed: Callable[[str, Exception], None] | None = None) -> DataFrame | None:
    """The accepted rows of all adapters, in their order, as if row after row were added.

    Rejected rows do not claim a key. Without caps one window over all does it;
    with caps adapters follow one another, each against the keys accepted before.
    `known` has keys (dk) of rows that are there already; `cut` ends a lineage.

    With `failed`, a source that fails does not stop the others: each source's
    rows are written by `cut` (which is needed then) on their own, and for one
    that raises, failed(name, exception) is called and its rows are left out.
    With no source left the result is None.
    """

    def rows_of(a: Adapter, i: int) -> DataFrame | None:
        if failed is None:
            return a.rows().withColumn("adapter", F.lit(a.name)).withColumn("rank", F.lit(i))
        try:
            return cut(a.rows().withColumn("adapter", F.lit(a.name)).withColumn("rank", F.lit(i)))
        except Exception as e:
            failed(a.name, e)
            return None

    found = [(a, rows_of(a, i)) for i, a in enumerate(adapters)]
    adapters, each = [a for a, rows in found if rows is not None], [rows for _, rows in found if rows is not None]
    if not each:
        return None
    if all(a.cap is None for a in adapters):
        rows = each[0]
        for more in each[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        rows = staged(rows, nfc).filter("stage = 'ok'")
        rows = rows if known is None else rows.join(known.select("dk"), "dk", "left_anti")
        return first_wins(rows, ["rank", "ordinal"])
    done: DataFrame | None = None
    for a, rows in zip(adapters, each):
        rows = staged(rows, nfc).filter("stage = 'ok'")
        for keys in (known, done):
            rows = rows if keys is None else rows.join(keys.select("dk"), "dk", "left_anti")
        rows = first_wins(rows, ["ordinal"])
        if a.cap is not None:
            rows = whole_pages(rows, a.page, a.cap).drop(a.page) if a.page else capped(rows, list(a.cap_by), ["ordinal"], a.cap)
        rows = rows if cut is None else cut(rows)
        done = rows if done is None else done.unionByName(rows, allowMissingColumns=True)
    return done


def writer_counters(rows: DataFrame, known: DataFrame | None = None, nfc: bool = True) -> DataFrame:
    """How many rows an append would write, and skip as duplicates, for their length, or as bad: one row."""
    rows = staged(rows, nfc)
    total = rows.agg(F.count_if(F.col("stage") == "bad").alias("bad"), F.count_if(F.col("stage") == "len").alias("len"), F.count_if(F.col("stage") == "ok").alias("ok"))
    new = rows.filter("stage = 'ok'").select("dk").distinct()
    new = new if known is None else new.join(known.select("dk"), "dk", "left_anti")
    wrote = new.agg(F.count("*").alias("wrote"))
    return total.crossJoin(wrote).select("wrote", (F.col("ok") - F.col("wrote")).alias("dup"), "len", "bad")  # one row each


def append(rows: DataFrame, path: str, nfc: bool = True) -> int:
    """Adds the new ones of rows to the corpus at path, each key once; gives their number. Running it again adds none."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    known = spark.read.parquet(path).select("dk") if there else None
    written = Observation()
    fresh = merge([Adapter("append", lambda: rows)], known, nfc=nfc).drop("stage", "adapter", "rank").observe(written, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").parquet(path)
    return written.get["n"]


def reset(spark: SparkSession, path: str) -> bool:
    """Removes the corpus at path; whether there was one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def composition(rows: DataFrame) -> DataFrame:
    """Counts by label, by source and by language, and the whole, in one pass: facet, value, n, weak, injections."""
    sets = rows.groupingSets([["label"], ["source"], ["lang"], []], "label", "source", "lang")
    out = sets.agg(F.grouping("label").alias("gl"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gg"), F.count("*").alias("n"), F.count_if(F.col("weak_seed")).alias("weak"), F.count_if(F.col("is_injection")).alias("injections"))
    facet = F.when(F.col("gl") == 0, "label").when(F.col("gs") == 0, "source").when(F.col("gg") == 0, "lang").otherwise("all")
    value = F.when(F.col("gl") == 0, F.col("label")).when(F.col("gs") == 0, F.col("source")).when(F.col("gg") == 0, F.col("lang"))
    return out.select(facet.alias("facet"), value.alias("value"), "n", "weak", "injections")


def limits(rows: DataFrame) -> DataFrame:
    """Positives that are not weak, those in other languages than en, and whether each is too few."""
    inj = F.col("label") == "injection"
    out = rows.agg((F.count_if(inj) - F.count_if(F.col("weak_seed"))).alias("real_positives"), F.count_if(inj & (F.col("lang") != "en")).alias("non_en_positives"))
    return out.withColumn("low_positives", F.col("real_positives") < REAL_POSITIVE_FLOOR).withColumn("en_dominant", F.col("non_en_positives") < 0.2 * F.col("real_positives"))


def ranked_counts(rows: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """Counts, largest first, ties by key; a report cut at `most` rows where given."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)
    return out if most is None else out.limit(most)


def hash_sample(rows: DataFrame, keep: int, modulo: int, text: str = "text") -> DataFrame:
    """Rows whose text falls into the first `keep` of `modulo` buckets."""
    return rows.filter(T.hash_bucket(F.col(text), modulo) < keep)


def bounded_sample(rows: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """`most` rows, the same ones for the same seed: those with the smallest hash of their keys."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(most)


def budgeted(rows: DataFrame, hard: Column, order: str, plain_most: int, hard_most: int, modulo: int) -> DataFrame:
    """The first hard rows and the first plain ones of one hash bucket, up to a budget each. Rows for which `hard` is null are plain; an empty table gives an empty one."""
    rows = rows.withColumn("is_hard", F.coalesce(hard, F.lit(False)))
    some, plain = rows.filter("is_hard"), rows.filter(~F.col("is_hard") & (T.hash_bucket(F.col("text"), modulo) == 0))
    return some.orderBy(order).limit(hard_most).unionByName(plain.orderBy(order).limit(plain_most))


def spread_sample(rows: DataFrame, ordinal: str, total: int, pages: int, page: int = 100) -> DataFrame:
    """Each step-th page of rows by their ordinal from 0: step = max(page, total // pages)."""
    step = max(page, total // pages)
    return rows.filter(F.col(ordinal) % step < page)
