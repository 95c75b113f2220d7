"""Vocabularies: word and pair frequencies, BPE, the word vocabulary, greedy encoding, coverage."""

import heapq
import os
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import MAX_WORD_CHARS, SEQ_LEN, SPECIALS, VOCAB_SIZE

# Letters that always have a place, as (first, last) code points: Cyrillic, Arabic.
ALWAYS = ((0x0400, 0x045F), (0x0620, 0x064F))
#: Pieces of words that BPE training holds in memory (two bytes each, four in large vocabularies), and those of a part.
HELD, PART = 1 << 25, 1 << 20


def words(rows: DataFrame, keep: list[str], text: str = "text", nfkc: bool = True) -> DataFrame:
    """keep, place and word of each word."""
    return rows.select(*keep, F.posexplode(T.pre_tokenize(F.col(text), nfkc)).alias("place", "word"))


def word_freq(rows: DataFrame, lang: str | None = None, weights: DataFrame | None = None, text: str = "text", nfkc: bool = True) -> DataFrame:
    """word and freq; with weights (lang, weight) a word counts as much as its row's language, 1 by default."""
    each = words(rows, [lang] if lang else [], text, nfkc)
    if weights is None:
        return each.groupBy("word").agg(F.count("*").alias("freq"))
    per = each.groupBy(F.col(lang).alias("_lang"), "word").agg(F.count("*").alias("n"))
    per = per.join(F.broadcast(weights.select(F.col("lang").alias("_lang"), "weight")), "_lang", "left")  # a row for each language
    return per.groupBy("word").agg(F.sum(F.col("n") * F.coalesce("weight", F.lit(1))).alias("freq"))


def pieces(word: Column) -> Column:
    """The word's characters, those after the first with ## before them."""
    chars = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
    return F.transform(chars, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit("##"), c)))


def char_freq(freq: DataFrame) -> DataFrame:
    return freq.select("freq", F.explode(pieces(F.col("word"))).alias("piece")).groupBy("piece").agg(F.sum("freq").alias("freq"))


def pair_counts(freq: DataFrame) -> DataFrame:
    """Weighted counts of neighbouring pieces: what the first merge is chosen from."""
    p = pieces(F.col("word"))
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b"))
    rows = freq.filter(F.length("word") > 1).select("freq", F.explode(pairs).alias("x"))
    return rows.groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("freq").alias("n"))


def next_merge(pairs: DataFrame) -> DataFrame:
    """The pair with the highest count, ties by the pair."""
    return pairs.filter("n >= 2").orderBy(F.desc("n"), "a", "b").limit(1)


def cjk_quota(freq: DataFrame, quota: int) -> DataFrame:
    """The most frequent Han, Kana and Hangul characters."""
    chars = freq.select("freq", F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("ch"))
    return chars.filter(T.is_cjk(F.col("ch"))).groupBy("ch").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "ch").limit(quota)


def alphabet(freq: DataFrame, least: int, quota: int = 0) -> DataFrame:
    """Pieces of one character that are frequent enough, with those that always have a place, each once."""
    found = char_freq(freq).filter(F.col("freq") >= least).select("piece")
    spark = freq.sparkSession
    always = None
    for low, high in ALWAYS:
        chars = spark.range(low, high + 1).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("ch"))
        always = chars if always is None else always.unionByName(chars)
    if quota:
        always = always.unionByName(cjk_quota(freq, quota).select("ch"))
    both = always.select(F.explode(F.array("ch", F.concat(F.lit("##"), "ch"))).alias("piece"))
    return found.unionByName(both).distinct()


def coded(words: list[str], freqs: np.ndarray, letters: list[str], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of two letters or more, the frequent first, as one array of their letters' places, with -1 before, between and after them.

    Words with other letters are left out. The second and third array tell from
    which place on words have which frequency.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(size) - size
    places = np.full(len(points), -1, np.int64)
    first = np.zeros(len(points), bool)
    first[at] = True
    for inner in (False, True):
        own = sorted((ord(x.removeprefix("##") if inner else x), k) for k, x in enumerate(letters) if len(x) == (3 if inner else 1) and (not inner or x.startswith("##")))
        if own and len(points):
            known, place = np.array(own, np.int64).T
            here = np.flatnonzero(first != inner)
            found = np.minimum(np.searchsorted(known, points[here]), len(known) - 1)
            places[here] = np.where(known[found] == points[here], place[found], -1)
    order = np.flatnonzero(np.minimum.reduceat(places, at) >= 0) if len(words) else np.empty(0, np.int64)
    order = order[np.argsort(-freqs[order], kind="stable")]
    size, at, freqs = size[order], at[order], freqs[order]
    to = 1 + np.cumsum(size + 1) - (size + 1)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(len(within) + len(size) + 1, -1, kind)
    out[np.repeat(to, size) + within] = places[np.repeat(at, size) + within]
    runs = np.flatnonzero(np.concatenate(([True], freqs[1:] != freqs[:-1]))) if len(freqs) else np.empty(0, np.int64)
    return out, to[runs], freqs[runs]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), values.dtype)
    np.add.at(out, at, values)
    return found, out


class Part:
    """Some of the words as `coded` gives them; with a path, their pieces lie in that file."""

    def __init__(self, own: np.ndarray, runs: np.ndarray, freqs: np.ndarray, path: str | None = None):
        self.kind, self.runs, self.freqs, self.path = own.dtype, runs, freqs, path
        self.own = own if path is None else own.tofile(path)

    def pairs(self, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a piece at these places and the next one, as one number, and their words' frequencies."""
        a, b = own[at].astype(np.int64), own[at + 1].astype(np.int64)
        inside = (a >= 0) & (b >= 0)
        return a[inside] << 32 | b[inside], self.freqs[np.searchsorted(self.runs, at[inside], "right") - 1]

    def read(self) -> np.ndarray:
        return self.own if self.path is None else np.fromfile(self.path, self.kind)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        own = self.read()
        return summed(*self.pairs(own, np.arange(len(own) - 1)))

    def merge(self, a: int, b: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts a piece in the place of each pair (a, b); which pairs' counts change, and by how much."""
        own = self.read()
        hits = np.flatnonzero((own[:-1] == a) & (own[1:] == b))
        if a == b and len(hits):  # of overlapping ones the first, third and so on
            starts = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
            hits = hits[(np.arange(len(hits)) - np.repeat(starts, np.diff(starts, append=len(hits)))) % 2 == 0]
        if not len(hits):
            return np.empty(0, np.int64), self.freqs[:0]
        old, less = self.pairs(own, np.unique(np.concatenate((hits - 1, hits, hits + 1))))
        keep = np.ones(len(own), bool)
        keep[hits + 1] = False
        own[hits] = piece
        own = own[keep]
        self.runs = self.runs - np.searchsorted(hits + 1, self.runs)
        hits = hits - np.arange(len(hits))
        new, more = self.pairs(own, np.unique(np.concatenate((hits - 1, hits))))
        self.own = own if self.path is None else own.tofile(self.path)
        return summed(np.concatenate((old, new)), np.concatenate((-less, more)))


def merged_pieces(coded_words: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], letters: list[str], room: int) -> list[str]:
    """Merged pieces in the order of their merges, at most `room`, from words as `coded` gives them.

    What is held of the words are HELD pieces and what a few parts of PART
    pieces take; the rest lies in temporary files, through which each merge goes
    once. Besides there are the counts of the pairs.
    """
    pieces, place = list(letters), {x: k for k, x in enumerate(letters)}
    count: dict[int, int] = {}
    heap: list[tuple] = []

    def entry(key: int) -> tuple:
        return -count[key], pieces[key >> 32], pieces[key & 0xFFFFFFFF]

    def add(keys: np.ndarray, values: np.ndarray) -> Iterator[int]:
        """The pairs that have another count now, and one that is not 0."""
        for key, value in zip(keys.tolist(), values.tolist()):
            if value:
                count[key] = count.get(key, 0) + value
                if count[key] > 0:
                    yield key
                else:
                    del count[key]

    with tempfile.TemporaryDirectory(prefix="textloom-") as folder, ThreadPoolExecutor(min(4, os.cpu_count() or 1)) as pool:
        parts: list[Part] = []
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = some = 0

        def put() -> None:
            nonlocal held, some
            starts = np.cumsum([0, *(len(x) for x, _, _ in waiting[:-1])])
            own, runs, freqs = np.concatenate([x for x, _, _ in waiting]), np.concatenate([r + k for (_, r, _), k in zip(waiting, starts)]), np.concatenate([f for _, _, f in waiting])
            parts.append(Part(own, runs, freqs, None if held + len(own) <= HELD else f"{folder}/{len(parts)}"))
            held += len(own) if parts[-1].path is None else 0
            waiting.clear()
            some = 0
            for _ in add(*parts[-1].counts()):
                pass

        for x in coded_words:
            if len(x[0]) > 1:
                waiting.append(x)
                some += len(x[0])
                if some >= PART:
                    put()
        if waiting:
            put()
        heap += map(entry, count)
        heapq.heapify(heap)
        merged: list[str] = []
        while heap and len(merged) < room:
            n, a, b = heapq.heappop(heap)
            pair = place[a], place[b]
            if -n < 2 or count.get(pair[0] << 32 | pair[1]) != -n:
                continue
            piece = a + b.removeprefix("##")
            merged.append(piece)
            if place.setdefault(piece, len(pieces)) == len(pieces):
                pieces.append(piece)
            changed = zip(*pool.map(lambda part: part.merge(*pair, place[piece]), parts))
            for key in add(*summed(*map(np.concatenate, changed))):
                heapq.heappush(heap, entry(key))
            if len(heap) > 4 * len(count) + 100_000:  # most are out of date
                heap[:] = map(entry, count)
                heapq.heapify(heap)
    return merged


def piece_kind(letters: int, size: int) -> str:
    return "int16" if letters + size < 1 << 15 else "int32"


def bpe_merges(freq: Counter | dict[str, int], letters: set[str], size: int) -> list[str]:
    """Merged pieces in the order of their merges, until the vocabulary of `size` is full.

    Merging is one sequence of choices, so it runs in one place; what it needs
    is the table of distinct words, which is counted in Spark. Every merge is of
    the most frequent pair (at least two), ties by the smaller pair.
    """
    words, own = [w for w in freq if len(w) > 1], sorted(letters)
    return merged_pieces([coded(words, np.array([freq[w] for w in words]), own, piece_kind(len(own), size))], own, size - len(SPECIALS) - len(own))


def coded_table(freq: DataFrame, letters: list[str], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of a table as `coded` gives them, some 50,000 at a time; one partition of it comes to the driver at once."""
    whole = dict(freq.dtypes)["freq"] in ("tinyint", "smallint", "int", "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        freqs: list[np.ndarray] = []

        def batch_of() -> pa.RecordBatch:
            out = coded(words, np.concatenate(freqs), letters, kind)
            words.clear()
            freqs.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], names=["own", "runs", "freqs"])

        for batch in batches:
            words += batch.column(0).to_pylist()
            freqs.append(batch.column(1).to_numpy(zero_copy_only=False))
            if len(words) >= 50_000:
                yield batch_of()
        if words:
            yield batch_of()

    rows = freq.filter(F.length("word") > 1).select("word", F.col("freq").cast("bigint" if whole else "double"))
    for r in rows.mapInArrow(run, "own binary, runs binary, freqs binary").toLocalIterator():
        yield np.frombuffer(r["own"], kind), np.frombuffer(r["runs"], np.int64), np.frombuffer(r["freqs"], np.int64 if whole else np.float64)


def train_bpe(freq: DataFrame, size: int, least: int = 2, quota: int = 0, dedup: bool = False, most_words: int | None = None) -> list[str]:
    """A BPE vocabulary: special tokens, the alphabet by frequency of the piece as a word, then merges.

    The words are counted once. They come to the driver as numbers, a partition
    at a time, where they take bounded memory and, beyond that, temporary files
    of two or four bytes for a letter; each merge reads these once, so its time
    grows with the distinct words. With `most_words`, more of them raise.
    """
    kept = freq.storageLevel.useMemory or freq.storageLevel.useDisk
    if not kept:
        freq = freq.persist(StorageLevel.DISK_ONLY)
    try:
        if most_words is not None and (n := freq.count()) > most_words:
            raise ValueError(f"{n} distinct words; raise `least` or `most_words`")
        letters = sorted(r["piece"] for r in alphabet(freq, least, quota).collect())
        known = freq.sparkSession.createDataFrame([(x,) for x in letters], "word string")
        alone = {r["word"]: r["freq"] for r in freq.filter(F.length("word") <= 3).join(F.broadcast(known), "word").select("word", "freq").collect()}
        merged = merged_pieces(coded_table(freq, letters, piece_kind(len(letters), size)), letters, size - len(SPECIALS) - len(letters))
    finally:
        if not kept:
            freq.unpersist(blocking=True)
    out = [*SPECIALS, *sorted(letters, key=lambda c: (-alone.get(c, 0), c)), *merged]
    return list(dict.fromkeys(out)) if dedup else out


def word_vocab(rows: DataFrame, size: int = VOCAB_SIZE, text: str = "text", order: str = "ordinal", nfkc: bool = True) -> DataFrame:
    """id and token: special tokens, all ## characters, all characters, then words by frequency, ties by their first place, up to size.

    The characters always all stay. Ranks are taken over distinct words; what is
    cut off is cut before the last sort.
    """
    each = words(rows, [order], text, nfkc)
    freq = each.groupBy("word").agg(F.count("*").alias("freq"), F.min(F.struct(order, "place")).alias("first"))
    chars = freq.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("ch")).distinct()
    spark = rows.sparkSession
    special = spark.createDataFrame([(0, s, i) for i, s in enumerate(SPECIALS)], "block int, token string, rank long")
    by_char = Window.partitionBy().orderBy("ch")
    ranked = chars.withColumn("rank", F.row_number().over(by_char).cast("long"))
    # inner characters, then single ones
    both = F.explode(F.array(F.struct(F.lit(1).alias("block"), F.concat(F.lit("##"), "ch").alias("token")), F.struct(F.lit(2).alias("block"), F.col("ch").alias("token"))))
    letters = ranked.select("rank", both.alias("x")).select("x.block", "x.token", "rank")
    # words of one character are among these; longer ones hold no punctuation, so none is a special token or begins with ##
    top = freq.filter(F.length("word") > 1).orderBy(F.desc("freq"), F.col("first").asc()).limit(size)
    top = top.select(F.lit(3).alias("block"), F.col("word").alias("token"), F.row_number().over(Window.partitionBy().orderBy(F.desc("freq"), F.col("first").asc())).cast("long").alias("rank"))
    every = special.unionByName(letters).unionByName(top)
    out = every.withColumn("id", F.row_number().over(Window.partitionBy().orderBy("block", "rank")) - 1)
    return out.filter((F.col("id") < size) | (F.col("block") < 3)).select("id", "token")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One token a line, the line's number its id."""
    vocab.coalesce(1).sortWithinPartitions("id").select("token").write.mode("overwrite").text(path)


def read_vocab(spark, path: str) -> dict[str, int]:
    """Tokens of a vocabulary file by id; of a repeated token the last line counts."""
    lines = spark.read.option("wholetext", True).text(path).collect()
    return {t: i for i, t in enumerate(x for r in lines for x in r["value"].removesuffix("\n").split("\n"))}


def longest_match(word: str, vocab: dict[str, int]) -> list[int] | None:
    """Ids of the longest pieces from the left; None where one is missing or the word is too long."""
    if len(word) > MAX_WORD_CHARS:
        return None
    found, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocab:
                found.append(vocab[piece])
                at = end
                break
        else:
            return None
    return found


def word_matcher(vocab: dict[str, int]):
    """longest_match with a memory of bounded size."""
    known: dict[str, list[int] | None] = {}

    def match(word: str) -> list[int] | None:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = longest_match(word, vocab)
        return known[word]

    return match


def encode(rows: DataFrame, vocab: dict[str, int], text: str = "text", length: int = SEQ_LEN, nfkc: bool = True) -> DataFrame:
    """rows with ids and mask, arrays of `length`: [CLS], pieces, [SEP], filled up with [PAD]. The vocabulary is bounded by its size and broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("array<int>")
    def ids_of(lists: pd.Series) -> pd.Series:
        v = shared.value
        match, unk, cls, sep = word_matcher(v), v["[UNK]"], v["[CLS]"], v["[SEP]"]

        def one(found) -> list[int]:
            out = [cls]
            for word in found if found is not None else ():
                if len(out) >= length - 1:
                    break
                got = match(word)
                out.extend([unk] if got is None else got)
            return [*out[: length - 1], sep]

        return lists.map(one)

    pad = vocab["[PAD]"]
    out = rows.withColumn("_ids", ids_of(T.pre_tokenize(F.coalesce(F.col(text), F.lit("")), nfkc)))
    n = F.size("_ids")
    fill = F.lit(length) - n
    out = out.withColumn("ids", F.concat("_ids", F.array_repeat(F.lit(pad), fill))).withColumn("mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)))
    return out.withColumn("n_ids", n).drop("_ids")


def coverage(rows: DataFrame, vocab: dict[str, int], lang: str = "lang", text: str = "text", fits: int = 126, least: int = 30, nfkc: bool = True) -> DataFrame:
    """words, unknown words, messages and messages of at most `fits` pieces, by language and over all; small languages are hidden but count in the total."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("array<int>")
    def counts(lists: pd.Series) -> pd.Series:
        match = word_matcher(shared.value)

        def one(found) -> list[int]:
            got = [match(w) for w in found]
            return [len(got), sum(x is None for x in got), sum(1 if x is None else len(x) for x in got)]

        return lists.map(one)

    each = rows.select(F.coalesce(lang, F.lit("?")).alias("lang"), counts(T.pre_tokenize(F.coalesce(F.col(text), F.lit("")), nfkc)).alias("c"))
    out = each.rollup("lang").agg(F.grouping("lang").alias("all"), F.sum(F.col("c")[0]).alias("words"), F.sum(F.col("c")[1]).alias("unknown"), F.count("*").alias("messages"), F.count_if(F.col("c")[2] <= fits).alias("fitting"))
    return out.filter((F.col("all") == 1) | (F.col("messages") >= least)).select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("lang")).alias("lang"), "words", "unknown", "messages", "fitting")
