"""Near duplicates and nearest vectors against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from textloom.llm import simhash, topk


def joined(pairs, nodes):
    up = {i: i for i in nodes}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def plain_fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
    x = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(x).view(np.int64)


@pytest.mark.parametrize("n", [2, 3, 64, 65, 2000])
def test_shard_links_join_what_all_pairs_join(n):
    x = noisy(n, n)
    y = x.view(np.uint64)
    pairs = [(int(x[i]), int(x[j])) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(y[i] ^ y) <= 4) if j > i]
    a, b = simhash.component_links(x)
    assert len(a) < max(2, len(x)) and joined(zip(a.tolist(), b.tolist()), x.tolist()) == joined(pairs, x.tolist())


@pytest.mark.parametrize("most", [200_000, 20])
def test_trees_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)  # 20: large shards go to deeper trees
    x = np.unique(np.concatenate([noisy(600, 9), noisy(60, 1)]))
    y = x.view(np.uint64)
    pairs = [(int(x[i]), int(x[j])) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(y[i] ^ y) <= 4) if j > i]
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    links = simhash.near_links(df)
    got = simhash.components(df.withColumn("id", F.col("fp")), links).collect()
    want = joined(pairs, x.tolist())
    assert {r.fp: r.component for r in got} == {k: v for k, v in want.items() if sum(v == w for w in want.values()) > 1}


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fp)
    want = joined([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex(F.col("fp"))).collect()
    assert {r.doc_id: (r.hex, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_near_duplicate_cases(spark):
    docs = cases.documents(spark)
    got = simhash.near_duplicates(docs).collect()
    of = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and {of[i].component_id for i in (0, 1, 2)} == {0} and of[0].fp == 0 and of[4].component_id == 3
    assert of[None].component_id is None
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    chain = spark.createDataFrame([(i, (1 << (3 * i)) - 1) for i in range(20)], "id long, fp long")
    links = simhash.near_links(chain)
    assert {r.component for r in simhash.components(chain, links).collect()} == {0}


def test_one_of_each_group_stays(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(30):
        own = [word() for _ in range(300)]
        near = list(own)
        near[17] = word()
        texts += [" ".join(own), " ".join(near), " ".join(own).upper()]
    docs = cases.documents(spark, texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == list(range(0, 90, 3))
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def shingles_of(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**9)}"
    return out


def pairs_of(rng, shapes, each):
    """Texts of which 2k and 2k + 1 are a pair, with the similarity of each pair."""
    texts, found = [], []
    for size, edits in shapes:
        for _ in range(each):
            own = [f"w{rng.randrange(10**9)}" for _ in range(size)]
            texts += [" ".join(own), " ".join(edited(rng, own, edits))]
            a, b = map(shingles_of, texts[-2:])
            found.append(len(a & b) / len(a | b))
    return texts, found


def kept_ids(spark, texts):
    return {r.i for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "i").collect()}


def test_every_pair_of_similar_texts_is_found(spark):
    texts, found = pairs_of(random.Random(1), [(300, 6), (300, 5), (1000, 20), (100, 2), (40, 1)], 40)
    kept = kept_ids(spark, texts)
    assert sum(x >= 0.8 for x in found) > 100
    assert [k for k, x in enumerate(found) if x >= 0.8 and 2 * k + 1 in kept] == []


def test_texts_below_the_similarity_stay(spark):
    texts, found = pairs_of(random.Random(2), [(300, 8), (300, 10), (1000, 28), (100, 4)], 40)
    kept = kept_ids(spark, texts)
    assert max(found) >= 0.7 and sum(0.65 <= x < 0.8 for x in found) > 100
    assert [k for k, x in enumerate(found) if x < 0.8 and not {2 * k, 2 * k + 1} <= kept] == []


def test_the_trees_join_copies_before_the_wide_search(spark, monkeypatch):
    texts, _ = pairs_of(random.Random(4), [(300, 1)], 40)
    # both have one fingerprint, as most of their words are the same few, but their sets are not similar
    texts += ["one two three four five " * 40 + " ".join(f"{x}{k}" for k in range(20)) for x in "pq"]
    fps = simhash.fingerprints(texts, simhash.WIDE_WORDS)[0].view(np.uint64)
    near = [k for k in range(40) if int(fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= 4]
    assert 10 < len(near) < 40 and fps[80] == fps[81]
    assert kept_ids(spark, texts) == {*range(0, 80, 2), 80, 81}
    monkeypatch.setattr(simhash, "wide_searched", lambda shards, turn: spark.createDataFrame([], "a long, b long, token long, at long"))
    assert kept_ids(spark, texts) == set(range(82)) - {2 * k + 1 for k in near}


@pytest.mark.parametrize("links", [500_000, 0])
def test_large_shards_lose_no_link(spark, monkeypatch, links):
    monkeypatch.setattr(simhash, "PAIRS", 1)  # nearly all shards go through the turns
    monkeypatch.setattr(simhash, "LINKS", links)
    rng = random.Random(3)
    texts = []
    for size, edits in ((60, 1), (80, 2), (200, 5), (120, 4)):
        own = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        texts += [" ".join(edited(rng, own, edits)) for _ in range(25)]
    sets = [shingles_of(x) for x in texts]
    want = joined([(a, b) for a in range(100) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(100))
    got = simhash.wide_duplicates(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "i").collect()
    assert 4 < len(set(want.values())) < 100 and {r.i: r.component_id for r in got} == want


def test_first_turn_makes_rows_in_proportion(spark):
    def rows(m):
        shards = spark.createDataFrame([(5, i, 300 << 32 | i % 7, i) for i in range(m)], "token long, id long, at long, comp long")
        return simhash.wide_searched(shards.coalesce(1), 0).count()

    assert rows(5) == 10 and rows(9) == 36
    assert rows(30) <= 2 * 30 and rows(300) <= 2 * 300  # not 435 pairs; these wait for sketches


def test_the_order_of_shingles_knows_what_recurs_in_large_tables(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 10)
    texts = [(i, f"a{i} b{i} c{i} d{i} e{i}" if i % 8 else "the same five words here") for i in range(400)]
    common, counts = simhash.common_shingles(spark.createDataFrame(texts, "id long, text string"), 5)
    assert common.tolist() == simhash.shingle_set("the same five words here", 5).tolist() and counts[0] > 2


def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 7 + [float("nan")]), (302, [None] + [1.0] * 7), (303, [float("inf")] * 8), (304, [0.5] * 3), (350, [0.5] * 3), (100, rows[0][1]), (400, [0.0] * 8), (450, []), (451, []), (451, []), (401, rows[0][1]), (401, rows[0][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows, df = vectors(spark)
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = defaultdict(list)
    for k, (i, q) in enumerate(good):
        if i % 50 == 0:
            found = sorted((-int(q @ v), j) for n, (j, v) in enumerate(good) if n != k and len(v) == len(q))[:5]
            want[i].append([(r + 1, j, -s) for r, (s, j) in enumerate(found)])
    got = defaultdict(list)
    for r in topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(x for part in v for x in part) for i, v in want.items()}


def test_the_threshold_stops_early():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(4000, 4)) * 256).astype(float)
    lists = np.argsort(v, axis=0).astype(np.int16).T
    ids = np.arange(4000)
    none = tuple(np.empty(0, np.int64) for _ in range(3))
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    got = topk.threshold(np.array([1.0, 2.0, 0.0, -1.0]), -1, v.view(Counted), lists, ids, ids, 5, none)
    assert got[1].tolist() == np.argsort(-(v @ [1.0, 2.0, 0.0, -1.0]), kind="stable")[:5].tolist() and sum(seen) < 2000


def test_rows_that_share_an_id(spark):
    texts = [(5, "one two three four five six seven"), (5, "quite other words stand in this text"), (7, "one two three four five six seven"), (8, "quite other words stand in this text"), (9, "nothing like any of these here"), (None, "nothing like any of these here"), (None, "alone here without an id at all"), (9, "nothing like any of these here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_key", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("_nth", F.lit(3))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9), (None, 9), (None, None)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text[:3]) for r in kept.collect()), key=str) == sorted([(5, "one"), (5, "qui"), (9, "not"), (None, "alo")], key=str)


def test_chains_are_joined_in_few_rounds(spark):
    # ids rise along the chain, the worst case of passing on the smallest one
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(10_000, 10_001)], "a long, b long")
    nodes = spark.createDataFrame([(i, i if i != 1500 else None) for i in [*range(3001), 10_000, 10_001]], "fp long, id long")
    got = {r.fp: r.component for r in simhash.components(nodes, links).collect()}
    assert set(got.values()) == {0, 10_000} and len(got) == 3003


def test_sketches_never_refuse_a_similar_pair():
    rng = np.random.default_rng(4)
    kept = 0
    for n in [1, 2, 5, 40, 500, 3000]:
        for share in [0.0, 0.3, 0.7, 0.78, 0.8, 0.85, 0.95, 1.0]:
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            common = max(0, round(share * 2 * n / (1 + share)))
            b = np.unique(np.concatenate([a[: min(common, n)], rng.integers(0, 2**63, max(0, n - common), dtype=np.uint64)]))
            open_ = len(simhash.plausible(np.array([len(a), len(b)]), [np.frombuffer(simhash.sketch(x), np.uint64) for x in (a, b)], 0, np.array([1])))
            assert open_ or not simhash.similar(a, b)
            kept += open_ and share < 0.75 and n >= 40
    assert kept == 0
