"""Benchmark decontamination with DataFrame functions only.

Benchmark texts become windows of 13 consecutive words (a shorter item is one
window of all its words), kept as a set of 64-bit hashes.

A document is tested in two steps. Every window of n words holds a whole block
of b = (n + 1) // 2 words that begins at a multiple of b, so it is enough to look
up each b-th place of a document; only around such blocks all places are looked
up. Places whose hash is in the set are then verified: the words themselves are
compared in a join with the windows.

Up to IN_PLAN windows the sets are part of the plan and both steps are made
inside a document's own row; nothing is shuffled but one small row for each
document and those for its hits. More windows are looked up in joins: a hash for
each b-th place is sent to a broadcast set of block hashes, or shuffled where
there are more than MOST_BROADCAST of these; what passes, a few words around a
block, goes on to the windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, once, quoted

#: What separates words: ASCII but for letters and digits, after lower-casing.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAM = 13
#: Windows whose hashes and words are written into the plan (about 1 kB of plan text each), and hashes that are broadcast.
IN_PLAN, MOST_BROADCAST = 10_000, 2_000_000


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), APART), ""), F.array().cast("array<string>"))


def windows_of(benchmark: DataFrame, ngram: int = NGRAM, item: str = "item_id", text: str = "text") -> DataFrame:
    """len, hash, gram (the words), items (sorted distinct ids as strings) and blocks (hashes) of each distinct window."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    words = words.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(ngram)))
    each = words.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("gram"))
    each = each.groupBy("len", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    block = ((F.col("len") + 1) / 2).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.col("len") - block + 1), lambda i: F.xxhash64(F.slice("gram", i, block)))
    return each.withColumn("hash", F.xxhash64("gram")).withColumn("blocks", blocks)


HIT = "array<struct<at:int,len:int,gram:string>>"


def places(n: int, step: int) -> str:
    """1-based places in the array w where n words begin, each step-th; none if there are fewer words."""
    return f"if(size(w) >= {n}, sequence(1, size(w) - {n - 1}, {step}), cast(array() as array<int>))"


def bounded(windows: DataFrame) -> bool:
    """Whether the windows are few enough for the plan."""
    return windows.limit(IN_PLAN + 1).count() <= IN_PLAN


def among(found: dict, kind: str) -> Callable[[str, str], str]:
    """A test, for SQL, of whether a value is among those found, by its 64-bit hash.

    found has the hash of each value. It becomes one literal, an array of buckets
    by the low bits of hashes. As many literals after `in` would be as many nodes of
    the plan, which each step of planning on the driver goes through and copies.
    """
    buckets: list[list] = [[] for _ in range(1 << max(0, len(found) - 1).bit_length())]
    for value, h in sorted(found.items()):
        buckets[h & (len(buckets) - 1)].append(value)
    literal = json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))  # words have no quotes, backslashes or control characters
    array = f"from_json('{literal}', 'array<array<{kind}>>', map('mode', 'FAILFAST', 'maxStringLen', '2147483647'))"
    return lambda value, h: f"array_contains(element_at({array}, cast({h} & {len(buckets) - 1} as int) + 1), {value})"


def hits_in_row(windows: DataFrame) -> Column:
    """The verified hits in the array of words w, for windows that are bounded()."""
    sets: dict[int, tuple[dict, dict, dict]] = {}
    gram = F.array_join("gram", " ")
    for r in windows.select("len", "hash", "blocks", gram.alias("gram"), F.xxhash64(gram).alias("key")).collect():  # IN_PLAN rows at most
        hashes, blocks, grams = sets.setdefault(r["len"], ({}, {}, {}))
        hashes[r["hash"]] = r["hash"]
        blocks.update((h, h) for h in r["blocks"])
        grams[r["gram"]] = r["key"]
    if not sets:
        return F.array().cast(HIT)
    maybe, found = [], []
    for n, (hashes, blocks, grams) in sorted(sets.items()):
        b = (n + 1) // 2
        maybe.append(f"exists(transform({places(b, b)}, i -> xxhash64(slice(w, i, {b}))), h -> {among(blocks, 'bigint')('h', 'h')})")
        at = f"filter(transform({places(n, 1)}, i -> named_struct('at', i, 'hash', xxhash64(slice(w, i, {n})))), x -> {among(hashes, 'bigint')('x.hash', 'x.hash')})"
        seen = f"transform({at}, x -> named_struct('at', x.at, 'len', {n}, 'gram', array_join(slice(w, x.at, {n}), ' ')))"
        found.append(f"filter({seen}, x -> {among(grams, 'string')('x.gram', 'xxhash64(x.gram)')})")
    return F.expr(f"case when {' or '.join(maybe)} then concat({', '.join(found)}) else array() end").cast(HIT)


def hit_words(hits: Column) -> Column:
    """The distinct 1-based places of hit words, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1)))))


def with_hits(docs: DataFrame, windows: DataFrame, text: str, small: bool) -> DataFrame:
    """docs (without a column named _...) with _row, n_words, _hits and hit_places."""
    rows = once(docs.withColumn("_row", F.monotonically_increasing_id()), "w", words_of(F.col(text)))
    if small:
        rows = once(rows, "_hits", hits_in_row(windows)).withColumn("n_words", F.size("w").cast("long")).drop("w")
    else:
        sizes = sorted(r["len"] for r in windows.select("len").distinct().collect())  # as many as words in a window
        rows = cut(rows.withColumn("n_words", F.size("w").cast("long")))
        blocks = cut(windows.select(F.explode("blocks").alias("block")).distinct())
        near = ["cast(array() as array<struct<block:bigint,len:int,begin:int,around:array<string>>>)"]  # for each block of a document: its hash and the words that windows around it can have
        for n in sizes:
            b = (n + 1) // 2
            begin = f"greatest(1, i - {n - b})"
            near.append(f"transform({places(b, b)}, i -> named_struct('block', xxhash64(slice(w, i, {b})), 'len', {n}, 'begin', {begin}, 'around', slice(w, {begin}, i + {n} - {begin})))")
        at = rows.select("_row", F.explode(F.expr(f"concat({', '.join(near)})")).alias("x")).select("_row", "x.*")
        at = at.join(F.broadcast(blocks) if blocks.count() <= MOST_BROADCAST else blocks, "block", "left_semi")
        each = F.expr("if(size(around) >= len, transform(sequence(1, size(around) - len + 1), k -> named_struct('at', begin + k - 1, 'gram', slice(around, k, len))), array())")
        at = at.select("_row", "len", F.explode(each).alias("x")).select("_row", "len", "x.at", "x.gram", F.xxhash64("x.gram").alias("hash"))
        found = at.join(windows.select("len", "gram", "hash"), ["hash", "len", "gram"]).groupBy("_row").agg(F.collect_set(F.struct("at", "len", F.array_join("gram", " ").alias("gram"))).alias("_hits"))
        rows = rows.drop("w").join(found, "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array()).cast(HIT))
    return once(rows, "hit_places", hit_words(F.col("_hits")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", ngram: int = NGRAM, share: int = 20) -> DataFrame:
    """For each row of docs: its id, n_words, n_hit, items, hit_places and contaminated.

    A word inside any occurrence of a window is hit; hit_places has the 1-based
    places of these words in order, items the ids of the benchmark items whose
    windows occur, as strings, sorted. contaminated: n_hit > 0 and
    share * n_hit >= n_words.

    Null and empty texts have no words and no hits; benchmark items without words
    have no windows. Repeated rows, and null or repeated ids, give a row each.
    An empty benchmark hits nothing. Other columns are not read.
    """
    windows = cut(windows_of(benchmark, ngram))
    small = bounded(windows)
    rows = with_hits(docs.select(id_col, text), windows, text, small).drop(text)
    grams = F.explode_outer(F.array_distinct(F.transform("_hits", lambda x: F.struct(x["len"].alias("len"), x["gram"].alias("gram")))))
    rows = rows.select("_row", id_col, "n_words", "hit_places", grams.alias("_g"))
    known = windows.select(F.col("len").alias("k_len"), F.array_join("gram", " ").alias("k_gram"), F.col("items").alias("_items"))
    rows = rows.join(F.broadcast(known) if small else known, (F.col("_g.len") == F.col("k_len")) & (F.col("_g.gram") == F.col("k_gram")), "left")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items"))))
    by = rows.groupBy("_row").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.first("hit_places").alias("hit_places"), items.alias("items"))
    n_hit = F.size("hit_places").cast("long")
    return by.withColumn("n_hit", n_hit).withColumn("contaminated", (n_hit > 0) & (share * n_hit >= F.col("n_words"))).drop("_row")


def without_words(text: Column, hit_places: Column) -> Column:
    """The text without the words at these 1-based places and what follows each up to the next word.

    hit_places must be a plain column, as it is looked up for each word.
    """
    # pieces: what stands before the first word (maybe nothing), then each word with what follows it
    apart = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.split(text, f"(?<={apart})(?!{apart})")
    begins = F.substring(text, 1, 1).rlike(apart) | (F.length(text) == 0)
    pieces = F.when(begins, pieces).otherwise(F.concat(F.array(F.lit("")), pieces))
    return F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(hit_places, i)), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", ngram: int = NGRAM, share: int = 20) -> DataFrame:
    """docs without its contaminated rows; from the others the hit words are removed.

    All columns are kept; an n_chars column is set anew where the text changed.
    Cases are defined as in find_contamination; rows without hits stay as they are.
    """
    windows = cut(windows_of(benchmark, ngram))
    shape = F.struct(*map(quoted, docs.columns)).alias("_all")
    rows = with_hits(docs.select(quoted(text).alias("_text"), shape), windows, "_text", bounded(windows))
    n_hit = F.size("hit_places")
    kept = rows.filter((n_hit == 0) | (share * n_hit < F.col("n_words")))
    old = F.col("_all")[text]
    new = F.when(n_hit > 0, without_words(old, F.col("hit_places"))).otherwise(old)
    out = {c: F.col("_all")[c] for c in docs.columns} | {text: new}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(n_hit > 0, F.length(new).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_all")["n_chars"])
    return kept.select(*[v.alias(k) for k, v in out.items()])
