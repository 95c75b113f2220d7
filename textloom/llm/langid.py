"""Language identification by rank-order profiles.

A profile is a list of the most frequent letter n-grams (one to three letters,
words marked by a space on either side), most frequent first. A document's own
profile is compared to each language's by out-of-place distance: for each of
its n-grams, how far its rank is from the language's rank of the same n-gram,
PROFILE where the language has none. The language with the least sum wins.

Language profiles are learned from a bounded sample: the SAMPLE labelled rows
of each language with the smallest hash of their id. Documents are profiled
whole, with numpy: letters become numbers of an alphabet, n-grams numbers made
of these, and a sort counts them.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, map_batches, texts_of

#: Labelled rows of each language that profiles are learned from.
SAMPLE = 1000
#: N-grams of a profile.
PROFILE = 400
#: Letters that have a number of their own; the rest share so many by their place in Unicode.
ALPHABET, SHARED = 120, 24
#: A text is refused if its best profile is further off than this score (0 to 1) and it has so many n-grams at least.
LEAST, ENOUGH = 0.25, 250
LETTERS = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    found = LETTERS.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def shared_number(c: int) -> int:
    """The number of a letter that has none of its own: letters of one block of 32 have the same, neighbouring blocks others."""
    return 1 + (c >> 5) * 2654435761 % (1 << 32) * SHARED // (1 << 32)


class Grams:
    """Numbers for the n-grams of one to three letters of an alphabet. 0 is the space, 1 to SHARED are letters outside of it."""

    def __init__(self, alphabet: str):
        self.size = len(alphabet) + SHARED + 1
        self.codes = np.array(sorted(map(ord, alphabet)), np.uint32)
        low = np.ones(0x3000, np.int32)
        for c in range(0x3000):
            low[c] = shared_number(c) if chr(c).isalpha() else 0
        for i, c in enumerate(self.codes.tolist()):
            if c < 0x3000:
                low[c] = i + SHARED + 1
        self.low = low

    def letters(self, text: str) -> np.ndarray:
        """Numbers of the text's letters, with one space for whatever is between words and at both ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(codes) + 2, np.int32)
        if len(codes) and codes.max() < 0x3000:
            out[1:-1] = self.low[codes]
        else:
            near = codes < 0x3000
            out[1:-1][near] = self.low[codes[near]]
            far = np.flatnonzero(~near)
            kinds, back = np.unique(codes[far], return_inverse=True)
            at = np.searchsorted(self.codes, kinds)
            numbers = [int(a) + SHARED + 1 if a < len(self.codes) and self.codes[a] == c else shared_number(c) if chr(c).isalpha() else 0 for a, c in zip(at, kinds.tolist())]
            out[1 + far] = np.array(numbers, np.int32)[back]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[keep]

    def of(self, text: str) -> np.ndarray:
        """The numbers of all n-grams of a text, as often as they occur. Those that only span a space do not count."""
        a, n = self.letters(text), self.size
        two = a[:-1] * n + a[1:]
        three = two[:-1] * n + a[2:] if len(a) > 2 else a[:0]
        inside = a[1:-1] != 0  # a space in the middle joins two words
        return np.concatenate((a[a != 0], n + two, n + n * n + three[inside] if len(a) > 2 else three))

    @property
    def total(self) -> int:
        return self.size + self.size**2 + self.size**3


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The n-grams with the highest counts, ties by their number."""
    return grams[np.lexsort((grams, -counts))[:most]]


def sample_of(docs: DataFrame, id_col: str, text: str, lang: str, use: Column, rows: int) -> list[tuple[str, str]]:
    """lang and text of `rows` rows of each language, those with the smallest hash of their id.

    A first pass, without texts, counts each language's rows; a second one reads
    the texts of rows with a hash below a bound that some more than `rows` pass.
    """
    mine = docs.filter(use & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = mine.groupBy(F.col(lang).alias("lang")).count().collect()  # a row for each language
    deal = F.shiftrightunsigned(F.xxhash64(id_col), 24)
    below = {r["lang"]: (1 << 40) if r["count"] <= 2 * rows else int((1 << 40) * min(1.0, (rows + 6 * rows**0.5) / r["count"])) for r in counts}
    if not below:
        return []
    bound = F.create_map(*[F.lit(x) for pair in sorted(below.items()) for x in pair])
    some = mine.select(F.col(lang).alias("lang"), F.col(text).alias("text"), deal.alias("deal")).filter(F.col("deal") < F.try_element_at(bound, F.col("lang")))
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("deal", "text"))).filter(F.col("r") <= rows)
    return [(r["lang"], r["text"]) for r in best.select("lang", "text").collect()]


class Profiles:
    """Profiles of languages, learned from (lang, text) pairs."""

    def __init__(self, alphabet: str, most: int, tops: dict[str, np.ndarray]):
        self.grams, self.most, self.langs = Grams(alphabet), most, sorted(tops)
        self.rank = np.full((len(tops), self.grams.total), most, np.int16)
        for k, lang in enumerate(self.langs):
            self.rank[k, tops[lang]] = np.arange(len(tops[lang]))

    @staticmethod
    def learn(pairs: list[tuple[str, str]], most: int = PROFILE, letters: int = ALPHABET) -> tuple[str, int, dict[str, np.ndarray]]:
        """The arguments for Profiles(): an alphabet, the length of a profile, and each language's most frequent n-grams."""
        seen: dict[str, int] = {}
        for _, text in pairs:
            codes, counts = np.unique(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            for c, k in zip(codes.tolist(), counts.tolist()):
                if chr(c).isalpha():
                    seen[chr(c)] = seen.get(chr(c), 0) + k
        alphabet = "".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[:letters]))
        grams = Grams(alphabet)
        by: dict[str, list[str]] = {}
        for lang, text in pairs:
            by.setdefault(lang, []).append(text)
        tops, counts = {}, np.zeros(grams.total, np.int64)
        for lang, texts in by.items():  # counted text by text: all n-grams of a sample are a dozen times its letters, and this runs on the driver
            counts[:] = 0
            for text in texts:
                found, often = np.unique(grams.of(text), return_counts=True)
                counts[found] += often
            found = np.flatnonzero(counts)
            tops[lang] = ranked(found.astype(np.int32), counts[found], most)
        return alphabet, most, tops

    def predict(self, text: str) -> tuple[str, float]:
        """The language and a score from 0 to 1: how much nearer the best profile is than the greatest distance there is."""
        return self.compared(text)[:2]

    def accepts(self, text: str, least: float = LEAST) -> bool:
        """Whether a text is in one of the languages: near enough to a profile, or too short to say that it is not."""
        lang, score, n = self.compared(text)
        return lang != UNKNOWN and (score >= least or n < ENOUGH)

    def compared(self, text: str) -> tuple[str, float, int]:
        """predict(), and the number of the text's n-grams, repeats included."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, 0
        own = np.sort(self.grams.of(text))
        n = len(own)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts = np.diff(np.append(first, len(own)))
        top = own[first]
        if len(top) > self.most:  # the sort below is over those that can be among the first
            least = np.partition(counts, len(counts) - self.most)[len(counts) - self.most]
            can = counts >= least
            top, counts = top[can], counts[can]
        top = ranked(top, counts, self.most)
        rank = self.rank[:, top].astype(np.int32)
        off = np.where(rank == self.most, self.most, np.abs(rank - np.arange(len(top), dtype=np.int32)))
        off = off.sum(axis=1)
        best = int(np.argmin(off))
        return self.langs[best], float(1.0 - off[best] / (self.most * len(top))), n


def fit(docs: DataFrame, id_col: str, text: str, lang: str, train: Column | None, sample: int, most: int):
    """A function that gives the profiles on a worker; what is broadcast is an alphabet and `most` numbers for each language."""
    pairs = sample_of(docs, id_col, text, lang, F.lit(True) if train is None else train, sample)
    learned = docs.sparkSession.sparkContext.broadcast(Profiles.learn(pairs, most))
    key = uuid.uuid4().hex

    def profiles() -> Profiles:
        store = cells("profiles")
        if key not in store:
            store.clear()
            store[key] = Profiles(*learned.value)
        return store[key]

    return profiles


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None, sample: int = SAMPLE, most: int = PROFILE) -> DataFrame:
    """id_col, lang_pred and score of each row of docs.

    Profiles are learned from the rows for which `train` holds, that have a
    language, `sample` of each (a documented bound: their texts go to the
    driver). Only the text is an input of a prediction.

    A text that is null, empty or without a letter is `und` with score 0, and so
    is every text where there is nothing to learn from. Of equal distances the
    language that comes first in order wins. Rows are independent: repeated ones
    are returned as they come; other columns are not read.
    """
    profiles = fit(docs, id_col, text, lang, train, sample, most)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = list(map(profiles().predict, texts_of(batch, text)))
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return map_batches(docs.select(id_col, text), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double", rows=500)


def reject_unknown(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, most: int = PROFILE, least: float = LEAST) -> DataFrame:
    """The rows of docs whose text is in one of the languages of docs, with all their columns.

    What identify() calls `und` goes, and so do texts of ENOUGH n-grams whose
    best profile has a score below `least`: another language or script, encoded
    data. Prose of a learned language has scores of 0.4 and more. With nothing to
    learn from, all rows go.
    """
    profiles = fit(docs, id_col, text, lang, None, sample, most)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        accepts = profiles().accepts
        return batch.filter(pa.array([accepts(t, least) for t in texts_of(batch, text)], pa.bool_()))

    return map_batches(docs, run, docs.schema, rows=500)
