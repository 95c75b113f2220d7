"""Text functions against plain Python, on strings that the tables do not hold."""

import hashlib
import random
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T

random.seed(5)
PIECES = ["a", "É", "é", " ", "\t", "\r\n", "\r", "\n", "\n\n\n", " ", "\u0085", "\x1c", "İ", "ı", "Σ", "ß", "und", "Les", "ğ", "前", "шщ", "سلام", "!", "&", "😀", "​", "ﬁ", "Anweisungen", "c'est", "für", "_", "9"]
STRINGS = ["", "  ", "a  b", "ΑΣ", "x y"] + ["".join(random.choice(PIECES) + random.choice(["", " "]) for _ in range(random.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "i int, text string")


def values(df, column):
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def norm(x):
    x = unicodedata.normalize("NFC", x).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x)).strip()


def test_norm_text(texts):
    assert values(texts, T.norm_text(F.col("text"))) == [norm(x) for x in STRINGS]


def test_dedup_key(texts):
    assert values(texts, T.dedup_key(F.col("text"))) == [hashlib.sha1(re.sub(r"\s+", " ", x.strip().lower()).encode()).hexdigest() for x in STRINGS]


def test_hash_bucket(texts):
    assert values(texts, T.hash_bucket(F.col("text"), 40)) == [int(hashlib.sha1(x.encode()).hexdigest()[:8], 16) % 40 for x in STRINGS]


def guess(x):
    """The rule in words: a script with 30 % of the letters, else the best of three scores if it is high enough."""
    letters = len(re.findall(r"[^\W\d_]", x)) or 1
    for code, pattern in T.SCRIPTS:
        if len(re.findall(pattern, x)) / letters >= 0.3:
            return code
    low = [w.translate({304: "i", 305: "i", 383: "s", 8490: "k"}).lower() for w in re.findall(r"\w+", x)]
    one = lambda chars, words, k=1: k * len(re.findall(chars, x)) + sum(w in words.split("|") for w in low)
    score = {"tr": one(T.TURKISH_LETTERS, T.TURKISH, 2), "de": one(T.GERMAN_LETTERS, T.GERMAN), "fr": one(T.FRENCH_LETTERS, T.FRENCH)}
    best = max(score, key=score.get)
    return best if score[best] >= max(2 if len(x) < 80 else 3, int(0.04 * (len(x.split()) or 1))) else "en"


def test_guess_lang(texts):
    assert values(texts, T.guess_lang(F.col("text"))) == [guess(x) for x in STRINGS]


def test_pre_tokenize(texts):
    def plain(x):
        x = unicodedata.normalize("NFKC", x).lower()
        return [w for w in re.split(rf"\s+|([{re.escape(string.punctuation)}])", x) if w]

    assert values(texts, T.pre_tokenize(F.col("text"))) == [plain(x) for x in STRINGS]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(0, None)], "i int, text string")
    for f in (T.norm_text, T.dedup_key, T.strip, T.snippet, T.pre_tokenize):
        assert values(df, f(F.col("text"))) == [None]


def test_records(spark):
    df = spark.createDataFrame([(0, '{"goal": "x"}'), (1, "{'goal': None, 'injection_text': 'it\\'s'}"), (2, "broken {"), (3, None)], "i int, r string")
    got = df.select("i", T.parse_record(F.col("r"), "injection_text string, goal string").alias("p")).orderBy("i").collect()
    assert [(r.p.injection_text, r.p.goal) if r.p else None for r in got][:2] == [(None, "x"), ("it's", None)]
    assert all(r.p is None or (r.p.injection_text, r.p.goal) == (None, None) for r in got[2:])
