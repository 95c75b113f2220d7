"""Scores, languages and token counts against brute force, libraries and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from textloom.llm import langid, lm_score, token_count
from textloom.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})), "\n"]


def brute_scores(learn, ask):
    u = Counter(w for t in learn for w in t)
    n, v = sum(u.values()), len(u)
    threes = lambda t: zip(["\t", "\t", *t], ["\t", *t], t)
    c3 = Counter(x for t in learn for x in threes(t))
    c2 = Counter((b, c) for _, b, c in c3)  # how many different words stand before a pair
    c1 = Counter(c for _, c in c2)
    d3, d2, d1 = (lm_score.discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)]) for c in (c3, c2, c1))

    def after(counts):
        kinds, total = defaultdict(lambda: [0, 0, 0]), Counter()
        for key, c in counts.items():
            kinds[key[:-1]][min(c, 3) - 1] += 1
            total[key[:-1]] += c
        return kinds, total

    (k3, t3), (k2, t2) = after(c3), after(c2)
    rest = sum(d1[min(c, 3)] for c in c1.values()) / max(len(c2), 1)
    low = lambda w: max(c1[w] - d1[min(c1[w], 3)], 0) / max(len(c2), 1) + rest / (v + 1)

    def over(key, p, counts, kinds, total, d):
        if not total[key[:-1]]:
            return p
        c = counts[key]
        return (max(c - d[min(c, 3)], 0) + sum(k * e for k, e in zip(kinds[key[:-1]], d[1:])) * p) / total[key[:-1]]

    chance = lambda a, b, c: over((a, b, c), over((b, c), low(c), c2, k2, t2, d2), c3, k3, t3, d3)
    out = []
    for t in ask:
        x = sum(math.log10(chance(*key)) for key in threes(t))
        out.append((len(t), sum(u[w] > 0 for w in t), sum(math.log10((u[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), x))
    context = [*learn[0], "\t"][:2]
    assert abs(sum(chance("\t", context[0], w) for w in [*u, "never seen"]) - 1) < 1e-9
    return out, low, u


def test_scores_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    want, low, u = brute_scores([t for i, t in rows.items() if i not in held], rows.values())
    assert abs(sum(map(low, u)) + low("never seen") - 1) < 1e-9
    got = {r.doc_id: r for r in QUERIES["op2_lm_scoring"](spark, sf_dir).collect()}
    for i, (n, known, base, score) in zip(rows, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.held_out) == (n, known, i in held)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_frequent_words_and_large_counts(spark):
    random.seed(1)
    texts = ["the " * 300 + "end", "a the " * 200] + [" ".join(random.choice("the a of x y z".split()) for _ in range(50)) for _ in range(60)]
    docs = cases.documents(spark, texts).repartition(6)
    got, about = lm_score.score_documents(docs, F.col("doc_id").isNotNull())
    assert len(about["frequent"]) > 1
    want, _, _ = brute_scores([tokens(t) for t in [*texts, texts[-1]]], [tokens(t) for t in texts])
    found = {r.doc_id: r for r in got.collect()}
    for i, (n, _, base, score) in enumerate(want):
        assert found[i].n_tokens == n and abs(found[i].base_score - base) < 1e-6 and abs(found[i].score - score) < 1e-6


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark)
    got, _ = lm_score.score_documents(docs, F.lit(False))
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.n_known == 0 and r.score == 0 for r in rows)
    assert lm_score.score_documents(cases.empty(spark), F.lit(True))[0].count() == 0


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_id"](spark, sf_dir.replace("sf0.001", "sf0.01")).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    docs = cases.documents(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 7))
    assert got[3].lang_pred == "en"
    kept = langid.reject_unknown(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (0, 1, 2, 7)").count() == 0 and kept.count() == docs.count() - 4
    assert langid.identify(cases.empty(spark)).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_null_ids_are_held_out(spark, tmp_path):
    rows = [(None, "some words here", "en", "a"), (1, "some other words", "en", "a"), (2, "einige andere", "de", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op2_lm_scoring", "op6_language_id"):
        assert {r.doc_id: r.held_out for r in QUERIES[name](spark, str(tmp_path)).collect()}[None] is True


def test_other_languages_are_refused():
    rng = random.Random(5)
    sample = {"en": "the quick brown fox jumps over the lazy dog and then it goes back to its own house where there is nothing left to eat", "de": "der schnelle braune fuchs springt über den faulen hund und geht dann in sein eigenes haus zurück in dem nichts mehr zu essen ist"}
    pairs = [(lang, " ".join(rng.choices(text.split(), k=60))) for lang, text in sample.items() for _ in range(50)]
    p = langid.Profiles(*langid.Profiles.learn(pairs))
    assert p.accepts(" ".join(rng.choices(sample["en"].split(), k=80))) and p.accepts("Haus") and not p.accepts("123 !!")
    greek = "η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο και μετά πηγαίνει πίσω στο σπίτι της όπου δεν υπάρχει τίποτα"
    encoded = "".join(rng.choice("QWERTZUIOPJKLYXCVBNM0123456789+/qjxzvkwy") for _ in range(600))
    assert not p.accepts(greek) and not p.accepts(encoded)


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        x = f" {w} "
        grams.update(x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n] != " ")
    return grams


def test_distance_equals_a_plain_version():
    rng = random.Random(3)
    texts = {"aa": "abc abd abe ab a " * 9 + "bcd", "bb": "xyz xya xyb xy x " * 9 + "zab", "cc": "mno mnp mab mn m " * 9}
    p = langid.Profiles(*langid.Profiles.learn(list(texts.items()), most=20))
    n = p.grams.size

    def number(g):
        k = [0 if c == " " else int(p.grams.low[ord(c)]) for c in g]
        return [k[0], n + k[0] * n + k[-1], n + n * n + (k[0] * n + k[1 % len(k)]) * n + k[-1]][len(k) - 1]

    def top(text):
        grams = plain_grams(text)
        return sorted(grams, key=lambda g: (-grams[g], number(g)))[:20]

    ranks = {lang: {g: k for k, g in enumerate(top(text))} for lang, text in texts.items()}
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcxyzmn") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12)))
        own = top(text)
        off = {lang: sum(abs(r[g] - k) if g in r else 20 for k, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(sorted(off), key=off.get)
        lang, score = p.predict(text)
        assert lang == best and abs(score - (1 - off[best] / (20 * len(own)))) < 1e-9


def test_far_letters():
    p = langid.Profiles(*langid.Profiles.learn([("ja", "日本語のテキスト 日本語"), ("en", "some english text")]))
    assert p.predict("日本語です😀")[0] == "ja" and p.predict("english 日")[0] == "en" and p.predict("😀 ²")[0] == "und"


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_count.counter(path)
    random.seed(2)
    texts = ["", "a", "<|endoftext|>", "x<|endoftext|> y", "a" * 5000, "ab" * 3000, "    \n\n  x", "日本語😀😀", "é" * 101, "\u0085 x\x1cz", "don't we'll I'M", "-" * 999, " " * 300 + "x", "<|endoftext", cases.LONG]
    texts += ["".join(random.choice("ab \n'st1é<|>日́ԱЖ") for _ in range(random.randint(0, 60))) for _ in range(1500)]
    assert count(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_profiles_are_learned_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    pairs = [(lang, "".join(rng.choice(list(letters), 20_000))) for lang in "xy" for letters in ["abcdefgh " if lang == "x" else "ghijklmn "] * 25]
    tracemalloc.start()
    _, _, tops = langid.Profiles.learn(pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # all n-grams of a language are 6 MB, and a sort copies them
    grams = langid.Grams("abcdefghijklmn")
    for lang, top in tops.items():
        every = np.concatenate([grams.of(t) for x, t in pairs if x == lang])
        assert top.tolist() == langid.ranked(*np.unique(every, return_counts=True), langid.PROFILE).tolist()


def test_the_store_of_counts_is_bounded(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    monkeypatch.setattr(token_count, "REMEMBERED", 50)
    monkeypatch.setattr(token_count, "REMEMBERED_CHARS", 5)
    token_count.cells("bpe-counts").pop(path, None)
    count = token_count.counter(path)
    random.seed(4)
    texts = [" ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(1, 12))) for _ in range(30)) for _ in range(40)]
    want = [len(e) for e in token_count.load(path).library.encode_batch(texts, add_special_tokens=False)]
    assert [n for k in range(0, 40, 4) for n in count(texts[k : k + 4])] == want
    assert len(token_count.cells("bpe-counts")[path]) <= 50 + 30 * 4


def test_token_count_cases(spark):
    docs = cases.documents(spark)
    got = token_count.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == docs.count() and (rows[0].n_bytes, rows[0].n_tokens) == (0, 0) and rows[5].over_limit and rows[9].n_bytes == len("日本語 テキスト 😀".encode())


@pytest.mark.parametrize("counts", [[0, 0, 0, 0], [5, 0, 0, 0], [1, 9, 9, 9], [10, 4, 2, 1]])
def test_discounts_leave_something(counts):
    d = lm_score.discounts(counts)
    assert d[0] == 0 and all(0 <= d[k] < k for k in (1, 2, 3))


def test_tokenizer_files_of_other_settings_are_refused():
    import json

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    small = {**spec, "model": {**spec["model"], "vocab": {}, "merges": []}}
    token_count.check_settings(small)
    for part, change in (("pre_tokenizer", {"add_prefix_space": True}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", {"end_of_word_suffix": "</w>"}), ("model", {"ignore_merges": True})):
        with pytest.raises(ValueError, match=part):
            token_count.check_settings({**small, part: {**small[part], **change}})
    with pytest.raises(ValueError, match="normalizer"):
        token_count.check_settings({**small, "normalizer": {"type": "NFC"}})
    with pytest.raises(ValueError, match="added token"):
        token_count.check_settings({**small, "added_tokens": [{"id": 0, "content": "<x>", "lstrip": True}]})
    with pytest.raises(ValueError, match="pre_tokenizer"):
        token_count.load(tokenizer_path("word_bpe_49k.json"))
