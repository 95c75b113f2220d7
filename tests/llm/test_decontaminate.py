import random
import re

import pytest

from tests.llm import cases
from textloom.llm import decontaminate as D


def words(text):
    low = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    """(n_words, hit places, items) of each text."""
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for text in docs:
        w = words(text)
        hit, items = set(), set()
        for gram, ids in windows.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit.update(range(i + 1, i + len(gram) + 1))
                    items |= ids
        out.append((len(w), sorted(hit), sorted(items)))
    return out


def samples(spark):
    random.seed(3)
    word = lambda: random.choice(["the", "THE", "a", "é", "x1", "of"])
    bench = [(10, " ".join(word() for _ in range(16))), (9, "lone"), (8, " ".join(word() for _ in range(5))), (7, None), (6, "!!"), (5, " ".join(word() for _ in range(13))), (10, "a 2nd text; same id of its own")]
    texts = [None, "", "lone", "x lone lone", bench[0][1] + " tail", "pre, " + bench[5][1].upper() + "! " + bench[2][1], " ".join(word() for _ in range(400)), "clean words only here", bench[0][1] * 3]
    return texts, bench


@pytest.mark.parametrize("plan,most", [(50_000, 0), (0, 2_000_000), (0, 0)])
def test_equals_brute_force(spark, monkeypatch, plan, most):
    monkeypatch.setattr(D, "IN_PLAN", plan)
    monkeypatch.setattr(D, "MOST_BROADCAST", most)
    texts, bench = samples(spark)
    docs = cases.documents(spark, texts)
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as len", "2 as hash")
    got = D.find_contamination(docs, b).collect()
    want = brute([*texts, texts[-1], "no id here"], bench)
    ids = [*range(len(texts)), len(texts) - 1, None]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, r.n_words, list(r.hit_places), list(r["items"])) for r in got), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


@pytest.mark.parametrize("plan", [10_000, 0])
def test_spans_go_and_clean_rows_stay(spark, monkeypatch, plan):
    monkeypatch.setattr(D, "IN_PLAN", plan)
    passage = " ".join(f"w{i}" for i in range(14))
    text = "Start here: " + " ".join(f"filler{i}" for i in range(400)) + ". " + passage + ". The end"
    docs = cases.documents(spark, [passage, text, "clean, text", None, ""])
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = D.decontaminate(docs, b)
    assert got.columns == docs.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    assert 0 not in rows and rows[1] == text.replace(passage + ". ", "") and rows[2] == "clean, text" and rows[3] is None
    assert D.find_contamination(got, b).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("plan", [10_000, -1])
def test_empty_tables(spark, monkeypatch, plan):
    monkeypatch.setattr(D, "IN_PLAN", plan)
    b = spark.createDataFrame([], "item_id long, text string")
    docs = cases.documents(spark)
    assert D.find_contamination(docs, b).filter("n_hit = 0 and not contaminated").count() == docs.count()
    assert D.find_contamination(cases.empty(spark), b).count() == 0


def test_windows_in_the_plan_are_few_nodes(spark):
    docs = cases.documents(spark)

    def plans(n):
        b = spark.createDataFrame([(1, " ".join(f"w{i}é" for i in range(n)))], "item_id long, text string")
        found = D.find_contamination(docs, b)._jdf.queryExecution()
        return found.analyzed().toJSON().count("expressions.Literal"), found.optimizedPlan().toString()

    few, many = plans(14), plans(500)
    assert few[0] == many[0] and "from_json" not in many[1]
