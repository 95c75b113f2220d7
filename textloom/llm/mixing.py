"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a weight in each phase of the training; phases follow one
another and have lengths. A phase's words are shared by the weights that hold in
it, or, with shares=False, all words are shared by the weights integrated over
the phases, so a phase may take more or fewer words than its length. That gives
each source's target; targets stop at a multiple of the source's size, and what
is over is reshared by weight among the sources below theirs (a water level over
the rows of the source table).

A source's weight schedule, integrated up to a time, is its cumulative word
demand there, scaled to its target. Its documents stand in a keyed random order and
are gone through again and again; a document begins at a cumulative number of
words, and the inverse of the demand at that number is its training position,
from 0 to 1. A range sort by position gives the training order.

The running sums inside a source are taken in two levels: words of each of
SLICES hash ranges of a source (summed before the shuffle), then documents
inside a range, so a source that holds most rows is never one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, quoted

#: Hash ranges of a source: each is one task's sort, so a source of 10^11 rows has some 10^7 in each.
SLICES = 8192
#: Weights of sources in the order of their names, over and over.
CYCLE = (5.0, 2.0, 1.0)
#: Phases, each with its length and such weights. Their integral is CYCLE: the first kind of source rises, the second falls, the third is constant.
CURRICULUM = ((0.25, (3.0, 3.0, 1.0)), (0.5, (5.0, 2.0, 1.0)), (0.25, (7.0, 1.0, 1.0)))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, f"{SPACE}+"), "")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, phases: tuple[tuple[float, tuple[float, ...]], ...], most: float, shares: bool) -> DataFrame:
    """key, source, source_size, weights (of each phase) and target of each source of (key, source, size).

    One row for each source comes out of the shuffle; the windows below run over those rows only.
    """
    per = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    length = float(sum(a for a, _ in phases))
    weights = F.array(*[F.element_at(F.array(*[F.lit(float(w)) for w in ws]), F.pmod(F.col("place"), F.lit(len(ws))).cast("int") + 1) for _, ws in phases])
    per = per.withColumn("place", F.row_number().over(by_name) - 1).withColumn("total", total).withColumn("weights", weights)
    # the share of all words: by the integral of the weights, or of their shares, over the phases
    everyone = Window.partitionBy()
    if shares:
        per = per.withColumn("weights", F.array(*[F.coalesce(F.try_divide(F.col("weights")[k], F.sum(F.col("weights")[k]).over(everyone)), F.lit(0.0)) for k in range(len(phases))]))
    integral = F.lit(0.0)
    for k, (a, _) in enumerate(phases):
        integral = integral + F.lit(a / length) * F.col("weights")[k]
    per = per.withColumn("integral", integral)
    per = per.withColumn("share", F.coalesce(F.try_divide("integral", F.sum("integral").over(everyone)), F.lit(0.0))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # the level: sources in the order in which they reach their cap; those before a source take theirs, it and the rest share what is left
    order = Window.partitionBy().orderBy(F.try_divide("cap", "share").asc_nulls_last(), F.col("place").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("share").over(everyone) - F.coalesce(F.sum("share").over(before), F.lit(0.0))
    per = per.withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), left)).withColumn("reached", F.row_number().over(order))
    # that of the first source which stays below its cap
    first = F.min(F.when((F.col("share") > 0) & (F.col("level") * F.col("share") <= F.col("cap")), F.struct("reached", "level"))).over(everyone)
    return per.withColumn("free", first["level"]).select("key", "source", "source_size", "weights", F.coalesce(F.least("cap", F.col("free") * F.col("share")), "cap").alias("target"))


def demand_inverse(words: Column, target: Column, weights: Column, phases: tuple) -> Column:
    """The position in the training, from 0 to 1, by which a source's demand has reached that many words.

    The demand is a broken line through the phases; inside a phase it rises evenly.
    """
    length = float(sum(a for a, _ in phases))
    shares, all_w = [], F.lit(0.0)
    for k, (a, _) in enumerate(phases):
        shares.append(F.lit(a / length) * weights[k])
        all_w = all_w + shares[-1]
    done, begun, position = F.lit(0.0), 0.0, F.lit(None).cast("double")
    part = F.when(target > 0, words / target).otherwise(F.lit(0.0)) * all_w
    for (a, _), share in zip(phases, shares):
        inside = F.when(share > 0, (part - done) / share).otherwise(F.lit(0.0))
        position = F.when(position.isNull() & (part < done + share), F.lit(begun / length) + F.lit(a / length) * inside).otherwise(position)
        done, begun = done + share, begun + a
    return F.coalesce(position, F.lit(1.0))


def in_order(df: DataFrame, position: str, *more: str) -> DataFrame:
    """df range-sorted by a position from 0 to 1. Ranges are equal parts of the training, so nothing is read to find them; rows without a position are spread over all of them and come first in each."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    anywhere = F.pmod(F.xxhash64(*more), F.lit(parts)) if more else F.lit(0)
    at = F.least(F.coalesce(F.floor(F.col(position) * parts), anywhere), F.lit(parts - 1)).cast("int")
    return df.repartitionById(parts, at).sortWithinPartitions(position, *more)


def mix(docs: DataFrame, size: Column | None = None, phases: tuple = ((1.0, CYCLE),), shares: bool = True, most: float = 3.0, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mix of docs: the columns `keep`, source, size, source_size, target, copies, taken and positions.

    phases: (length, weights) each; the weights are dealt to the sources by code
    point of their names, null last, over and over; shares: whether a phase's
    words are shared by them (see above). copies is how often the mix
    takes a document, taken = copies * size, positions where in the training
    (from 0 to 1) each copy stands.

    `size` is a document's number of words by default; null text has 0. Documents
    of size 0 take no words; they are given one copy where their source is taken
    at all, at the position of their neighbour. Order inside a source depends on
    a hash of the kept columns and the seed; rows that agree in all of these are
    interchangeable. An empty table gives an empty one, a source without words a
    target of 0. Clashing names among other columns do not matter: only those
    kept are read (they must not be called key, source, size, slice or deal). No document is taken more often than ceil(most) times, and a
    source's taken words differ from its target by less than one document.
    """
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(*keep, F.col("source"), size.cast("long").alias("size"))
    deal = F.xxhash64(F.lit(seed), *[F.col(c) for c in keep], "size")
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("deal", deal).withColumn("slice", F.pmod(F.shiftright("deal", 8), F.lit(SLICES)).cast("int"))
    # small rows, read by two branches: written once, so texts are read and counted once
    rows = cut(rows)
    slices = rows.groupBy("key", "source", "slice").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("key", "slice", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("slice_start"))
    starts = starts.join(source_targets(slices, phases, most, shares).drop("source"), "key")
    within = Window.partitionBy("key", "slice").orderBy("deal", *[F.col(c) for c in keep], "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["key", "slice"])
    rows = rows.withColumn("start", F.col("slice_start") + F.col("before"))
    # in round p a document begins at p * source_size + start; it is taken if more than half of it is below the target
    copies = F.when(F.col("target") > 0, F.greatest(F.ceil((F.col("target") - F.col("start") - F.col("size") / 2.0) / F.col("source_size")), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("copies", F.least(copies, F.lit(int(-(-most // 1)))).cast("int"))
    at = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda p: demand_inverse((p - 1) * F.col("source_size") + F.col("start"), F.col("target"), F.col("weights"), phases))
    rows = rows.withColumn("positions", F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>")))
    return rows.select(*keep, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions")


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", position: str = "position", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, range-sorted by position; `how` are arguments of mix().

    The column named by `position` is added; docs must not have one of that name
    if both are to be told apart by name. Rows that
    share an id, null included, are told apart by their text and source; those
    that agree in these too are paired with the mix's rows one to one.
    """
    own = F.xxhash64(F.coalesce(quoted(key).cast("string"), F.lit("")), quoted(key).isNull(), quoted(text), F.col("source"))
    # names of its own beside all columns of docs, which travel as one
    rows = docs.select(own.alias("_row_key"), F.col("source"), quoted(text).alias("text"), F.struct(*map(quoted, docs.columns)).alias("_all"))
    mixed = cut(mix(rows, keep=("_row_key",), **how).filter("copies > 0 or size = 0").select("_row_key", "positions"))
    rows, same = rows.select("_row_key", "_all"), ["_row_key"]
    if not mixed.groupBy("_row_key").count().filter("count > 1").isEmpty():
        same.append("_nth")
        number = F.row_number().over(Window.partitionBy("_row_key").orderBy("_row_key"))
        rows, mixed = rows.withColumn("_nth", number), mixed.withColumn("_nth", number)
    placed = mixed.select(*same, F.explode("positions").alias("_at"))
    out = in_order(rows.join(placed, same).withColumn("_id", F.col("_all")[key]), "_at", "_id")
    return out.select(*(F.col("_all")[c].alias(c) for c in docs.columns), F.col("_at").alias(position))
