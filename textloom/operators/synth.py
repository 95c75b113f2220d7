"""Synthesis: strided products of slots, template filling, spliced twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .order import running, sliced

POSITIONS = ("start", "end", "middle")
ATTACKS_PER_CONTEXT = 4


def strided_product(spark: SparkSession, slots: dict[str, list[str]], cap: int) -> DataFrame:
    """Every stride-th tuple of the product of the slots, in the order of their lists: combo and a column for each slot.

    stride = max(1, product // cap). Only the numbers of the chosen tuples are
    made; each slot's entry follows from the number, so no product is built.
    """
    sizes = [len(v) for v in slots.values()]
    total = reduce(lambda a, b: a * b, sizes, 1)
    stride = max(1, total // cap)
    rows = spark.range(0, total, stride).withColumnRenamed("id", "combo")
    below = total
    for name, values in slots.items():
        if not total:
            rows = rows.withColumn(name, F.lit(""))
            continue
        below //= len(values)
        rows = rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), ((F.col("combo") / F.lit(below)).cast("bigint") % len(values) + 1).cast("int")))
    return rows


def fill_templates(templates: DataFrame, combos: DataFrame, slots: list[str], template: str = "template") -> DataFrame:
    """Every template with every combination filled in. Combinations are few (a cap for each template) and are broadcast."""
    rows = templates.crossJoin(F.broadcast(combos))
    return rows.withColumn("text", T.fill(F.col(template), {s: F.col(s) for s in slots}))


def first_filled(rows: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """ordinal (from 0) and text of filled rows, in order: of texts with one key the first, and the first `most` of these. Texts are few (caps are counts of generated rows)."""
    text = T.strip(F.col("text"))
    kept = rows.select(*order, text.alias("text")).groupBy(T.dedup_key(F.col("text")).alias("dk")).agg(F.min(F.struct(*order, "text")).alias("x")).select("x.*")
    kept = kept.orderBy(*order).limit(most) if most is not None else kept
    return running(kept, [], [F.col(order[0])], order, F.lit(1), "ordinal").select("ordinal", "text")


def each_template(spark: SparkSession, templates: list[str], slots: dict[str, list[str]], cap: int) -> DataFrame:
    """At most `cap` texts: every template with its own spread of fills, max(4, cap // templates + 2) asked of each. A template without slots gives one text; no template, none."""
    share = max(4, cap // max(1, len(templates)) + 2)
    numbered = spark.createDataFrame(list(enumerate(templates)), "no int, template string")
    return first_filled(fill_templates(numbered, strided_product(spark, slots, share), list(slots)), ["no", "combo"], cap)


def spread_product(spark: SparkSession, slots: dict[str, list[str]], cap: int, most: int | None = None, template: str = "template") -> DataFrame:
    """Texts of a product in which the template is a slot like the others, one of each stride-th tuple; at most `most` where given. An empty slot gives none."""
    rows = strided_product(spark, slots, cap)
    return first_filled(rows.withColumn("text", T.fill(F.col(template), {s: F.col(s) for s in slots if s != template})), ["combo"], most)


def by_language(spark: SparkSession, blocks: dict[str, tuple[dict[str, list[str]], list[str]]], cap: int, prefix: str = "ml") -> DataFrame:
    """ordinal, text, label, lang and notes: for each language (slots, benign texts), the spread product as injections, then the benign texts. Ordinals follow the order of languages."""
    schema, out = "ordinal long, text string, label string, lang string, notes string", None
    for i, (lang, (slots, benign)) in enumerate(blocks.items()):  # a few languages
        bad = spread_product(spark, slots, cap).select("ordinal", "text", F.lit("injection").alias("label"))
        good = spark.createDataFrame([(cap * 2 + k, t, "benign") for k, t in enumerate(benign)], "ordinal long, text string, label string")
        rows = bad.unionByName(good).select((F.col("ordinal") + F.lit(i << 32)).cast("long").alias("ordinal"), "text", "label", F.lit(lang).alias("lang"), F.concat(F.lit(f"{prefix}-"), "label", F.lit(f"/{lang}")).alias("notes"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def distinct_union(*frames: DataFrame, value: str = "text", order: str = "ordinal") -> DataFrame:
    """All values, each where it first occurs, numbered in order from 0 (idx). Orders are integers."""
    rows = reduce(DataFrame.unionByName, [f.select(F.col(value), F.lit(i).alias("frame"), F.col(order).alias("ordinal")) for i, f in enumerate(frames)])
    first = rows.groupBy(value).agg(F.min(F.struct("frame", "ordinal")).alias("at")).select(value, "at.frame", "at.ordinal")
    return running(first, [], [F.col("frame"), sliced("ordinal")], ["frame", "ordinal"], F.lit(1), "idx").select(value, "idx")


def boundaries(text: Column) -> Column:
    """Places (numbers of characters) after each end of a sentence and the space behind it."""
    # pieces up to and with each end, one right after the other, so what follows the last end is looked at once
    ends = F.regexp_extract_all(text, F.lit(rf"{T.UNICODE}(?s)\G.*?[.!?]{T.SPACE}+"), F.lit(0))
    start = F.aggregate(ends, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.array_append(acc["all"], acc["at"] + F.length(x)).alias("all")))
    return start["all"]


def splice(context: Column, attack: Column, position: Column) -> Column:
    """The attack before the text, behind it, or after a sentence chosen by hash; behind it if there is none."""
    end = F.concat(context, F.lit("\n"), attack)
    pick = lambda cuts: F.element_at(cuts, (T.hash_bucket(F.concat(context, attack), 1 << 32) % F.size(cuts) + 1).cast("int"))
    cut = T.let(boundaries(context), lambda cuts: F.when(F.size(cuts) > 0, pick(cuts)).otherwise(F.lit(-1)))
    middle = T.let(cut, lambda at: F.when(at < 0, end).otherwise(F.concat(F.substr(context, F.lit(1), at), attack, F.lit("\n"), F.substr(context, at + 1))))
    return F.when(position == "start", F.concat(attack, F.lit("\n"), context)).when(position == "end", end).otherwise(middle)


def twins(contexts: DataFrame, attacks: DataFrame, n_attacks: int, per: int = ATTACKS_PER_CONTEXT) -> DataFrame:
    """The clean text and `per` spliced ones of each context (ci from 0, text), all of one group; attacks (idx, text) rotate."""
    base = contexts.select("ci", F.col("text").alias("context"), F.concat(F.lit("ctx-"), F.substring(F.sha1("text"), 1, 12)).alias("group"))
    each = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("idx", (F.col("ci") * per + F.col("j")) % n_attacks)
    each = each.join(attacks.select("idx", F.col("text").alias("attack")), "idx")
    place = T.hash_bucket(F.concat_ws(":", F.col("ci").cast("string"), F.col("j").cast("string")), len(POSITIONS))
    each = each.withColumn("position", F.element_at(F.array(*map(F.lit, POSITIONS)), place.cast("int") + 1))
    spliced = each.select("ci", "j", "group", splice(F.col("context"), F.col("attack"), F.col("position")).alias("text"), F.lit("injection").alias("label"), F.concat(F.lit("indirect/"), "position").alias("notes"))
    clean = base.select("ci", F.lit(-1).alias("j"), "group", F.col("context").alias("text"), F.lit("benign").alias("label"), F.lit("clean-context").alias("notes"))
    return clean.unionByName(spliced)


def picked(spark: SparkSession, templates: list[str], slots: dict[str, list[str]], n: int, seed: int) -> DataFrame:
    """n texts; template and entries of each follow from a hash of its number and the seed. Fewer where texts repeat."""
    choose = lambda name, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(len(values))) + 1).cast("int"))
    rows = spark.range(n).withColumn("text", choose("template", templates))
    rows = rows.withColumn("text", T.fill(F.col("text"), {k: choose(k, v) for k, v in slots.items()}))
    return rows.groupBy("text").agg(F.min("id").alias("ordinal"))
