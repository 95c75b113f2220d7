import pytest
from pyspark.sql import functions as F

from textloom import schema as S
from textloom.functions import text as T
from textloom.operators import corpus as C
from textloom.operators import repair, scoring, split, synth, vocab
from textloom.sources import adapters, files, paged
from textloom.streaming.ingest import ingest


def rows(spark, items):
    """(ordinal, text, changes) as corpus rows."""
    base = dict(label="benign", source="s", license="l", lang="en", channel="chat", is_translated=False, is_synthetic=False, weak_seed=False, group="", notes="")
    data = [{"ordinal": o, "text": t, **base, **more} for o, t, more in items]
    return spark.createDataFrame(data, "ordinal int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in S.ROW))


def test_first_wins_and_rejected_rows_claim_nothing(spark):
    a = rows(spark, [(0, "ab", {}), (1, "Hello  World", {"label": "bad"}), (2, "hello world", {}), (3, "HELLO world ", {}), (4, "x" * 4001, {}), (5, None, {})])
    b = rows(spark, [(0, "Hello world", {}), (1, "other text", {})])
    got = C.merge([C.Adapter("a", lambda: a), C.Adapter("b", lambda: b)]).collect()
    assert sorted((r.adapter, r.ordinal) for r in got) == [("a", 2), ("b", 1)]
    assert C.writer_counters(a).first().asDict() == {"wrote": 1, "dup": 1, "len": 2, "bad": 2}


def test_caps_follow_each_other(spark):
    a = rows(spark, [(i, f"text number {i}", {"lang": "en" if i % 2 else "de"}) for i in range(10)])
    b = rows(spark, [(i, f"text number {i}", {}) for i in range(10)])
    got = C.merge([C.Adapter("a", lambda: a, ("lang", "label"), 2), C.Adapter("b", lambda: b)]).collect()
    assert sorted((r.adapter, r.ordinal) for r in got) == [("a", i) for i in range(4)] + [("b", i) for i in range(4, 10)]


def test_append_is_idempotent(spark, tmp_path):
    a = rows(spark, [(i, f"text {i % 3} of three", {}) for i in range(9)])
    path = str(tmp_path / "corpus")
    assert C.append(a, path) == 3
    assert C.append(a, path) == 0
    assert spark.read.parquet(path).count() == 3


def test_stream_adds_once(spark, tmp_path):
    rows(spark, [(i, f"streamed text {i % 4}", {}) for i in range(8)]).repartition(3).write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), str(tmp_path / f"check{run}")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_split_is_stable_and_whole(spark):
    a = rows(spark, [(i, f"some text {i}", {"group": f"g{i // 3}"}) for i in range(300)])
    more = rows(spark, [(i, f"synthetic {i}", {"is_synthetic": True}) for i in range(50)])
    alone, both = split.assign(a), split.assign(a.unionByName(more))
    side = lambda df: {r.text for r in df.filter("side = 'eval'").collect()}
    assert side(alone) == side(both) and 0 < len(side(alone)) < 150
    split.check_leaks(alone)
    with pytest.raises(ValueError):
        split.check_leaks(split.assign(a.withColumn("is_synthetic", F.col("ordinal") % 3 == 0)))
    with pytest.raises(ValueError):
        split.snapshot(a, "ordinal", 10, expect_eval=99)


def test_metrics_without_cases(spark):
    empty = spark.createDataFrame([], "label string, pred string, fp_hard boolean, lang string")
    got = scoring.confusion(empty).first()
    assert (got.tp, got.precision, got.recall, got.f1, got.fp_rate) == (0, 0.0, 0.0, 0.0, 0.0)


def test_best_threshold(spark):
    df = spark.createDataFrame([(0.4, 0.8), (0.5, 0.7), (0.45, 0.8)], "thr double, f1 double")
    assert scoring.best_threshold(df).first().thr == 0.4
    df = spark.createDataFrame([(0.4, 0.7), (0.5, 0.7), (0.6, 0.6)], "thr double, f1 double")
    assert scoring.best_threshold(df).first().thr == 0.5


def test_repair_keeps_one_entry(spark):
    a = rows(spark, [(0, "plain english text here", {"source": "deepset", "lang": "de", "notes": "kept"}), (1, "plain english text", {"source": "other", "lang": "de"}), (2, "plain english text", {"source": "llmail", "lang": "en", "notes": "x | lang-fix:en->fr"})])
    once = repair.repair(a)
    assert [(r.lang, r.notes) for r in once.orderBy("ordinal").collect()] == [("en", "kept | lang-fix:de->en"), ("de", ""), ("en", "x")]
    again = repair.repair(once.drop("old_lang", "was_candidate"))
    assert [(r.lang, r.notes) for r in again.orderBy("ordinal").collect()] == [(r.lang, r.notes) for r in once.orderBy("ordinal").collect()]
    assert repair.transitions(again).count() == 0


def test_strided_product(spark):
    import itertools

    slots = {"a": list("xyz"), "b": list("pq"), "c": list("12345")}
    want = list(itertools.product(*slots.values()))[::4]
    got = [(r.a, r.b, r.c) for r in synth.strided_product(spark, slots, 7).orderBy("combo").collect()]
    assert got == want


def test_splice_in_the_middle(spark):
    import hashlib
    import re

    texts = ["One. Two!  Three? Four", "no end at all", "Ends here. ", "a.b. c.\n\n d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", synth.splice(F.col("t"), F.lit("ATTACK"), F.lit("middle")).alias("s")).orderBy("i").collect()]
    for text, out in zip(texts, got):
        ends = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
        if not ends:
            assert out == text + "\nATTACK"
        else:
            cut = ends[int(hashlib.sha1((text + "ATTACK").encode()).hexdigest()[:8], 16) % len(ends)]
            assert out == text[:cut] + "ATTACK\n" + text[cut:]


def test_bpe_merges_equal_counting_anew():
    from collections import Counter

    freq = {"banana": 5, "bandana": 3, "anna": 4, "aaaa": 2, "nab": 1}
    letters = {c if i == 0 else "##" + c for w in freq for i, c in enumerate(w)}
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in freq}
    want = []
    for _ in range(6):
        count = Counter()
        for w, f in freq.items():
            for pair in zip(words[w], words[w][1:]):
                count[pair] += f
        pair = min((p for p in count if count[p] >= 2), key=lambda p: (-count[p], p))
        piece = pair[0] + pair[1][2:]
        want.append(piece)
        for w, own in words.items():
            new, i = [], 0
            while i < len(own):
                hit = tuple(own[i : i + 2]) == pair
                new.append(piece if hit else own[i])
                i += 2 if hit else 1
            words[w] = new
    assert vocab.bpe_merges(freq, letters, len(letters) + 4 + 6) == want


def test_bpe_memory_is_bounded(spark, monkeypatch):
    import random
    import tracemalloc

    rng = random.Random(7)
    freq = {"".join(rng.choices("abcdefgh", k=rng.randint(1, 14))): rng.randint(1, 30) for _ in range(40_000)}
    letters = {x for c in "abcdefgh" for x in (c, "##" + c)}
    size = len(letters) + 4 + 40
    want = vocab.bpe_merges(freq, letters, size)
    table = spark.createDataFrame(list(freq.items()), "word string, freq long").repartition(8)
    # nothing is held of the words: 40,000 words as lists and an index of their pairs took over 30 MB
    for name, value in (("HELD", 0), ("PART", 10_000)):
        monkeypatch.setattr(vocab, name, value, raising=False)
    monkeypatch.setattr(vocab, "ALWAYS", ((0x61, 0x68),))
    tracemalloc.start()
    got = vocab.train_bpe(table, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[-40:] == want and len(want) == 40 and len(set(want)) > 35
    assert peak < 10 << 20


def test_encoding(spark):
    v = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##s", "!", "a"])}
    df = spark.createDataFrame([(0, "Playing plays!"), (1, "zzz a"), (2, ""), (3, None), (4, "a " * 20)], "i int, text string")
    got = {r.i: r for r in vocab.encode(df, v, length=8).collect()}
    assert got[0].ids == [2, 4, 5, 4, 6, 7, 3, 0] and got[0].mask == [1] * 7 + [0]
    assert got[1].ids[:4] == [2, 1, 8, 3] and got[2].ids[:2] == got[3].ids[:2] == [2, 3]
    assert got[4].ids == [2] + [8] * 6 + [3] and got[4].n_ids == 8


def test_vocab_file(spark, tmp_path):
    df = spark.createDataFrame([(0, "[PAD]"), (1, "b"), (2, "a")], "id int, token string")
    vocab.write_vocab(df, str(tmp_path / "v"))
    assert vocab.read_vocab(spark, str(tmp_path / "v")) == {"[PAD]": 0, "b": 1, "a": 2}


def test_line_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x y", "label": "benign"}\n\n{"text": broken\n{"text": "z", "group": null}\n', encoding="utf-8")
    assert sorted(r.text for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), drop_malformed=True).collect()) == ["x y", "z"]
    assert files.jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "s.jsonl").write_text('# why\n\n{"id": "a", "reason": "r"}\n')
    assert [r.id for r in files.suspects(spark, str(tmp_path / "s.jsonl")).collect()] == ["a"]
    (tmp_path / "p.jsonl").write_text('{"id": "a", "score": 0.9}\n{"id": "a", "pred": "benign"}\n{"id": "b", "score": 0.5}\n{"id": "c"}\n')
    got = scoring.last_predictions(files.predictions(spark, str(tmp_path / "p.jsonl")))
    assert {r.id: r.pred for r in got.collect()} == {"a": "benign", "b": "injection"}
    (tmp_path / "m.json").write_text('{"Instruction": ["a", "b"], "Programming Help": ["c"], "New": ["d"]}')
    known, unknown = adapters.attacks(files.json_lists(spark, str(tmp_path / "m.json")))
    with pytest.warns(UserWarning, match=r"New \(1\)"):
        assert adapters.known_attacks(files.json_lists(spark, str(tmp_path / "m.json"))).count() == 3
    assert {(r.text, r.label) for r in known.collect()} == {("a", "injection"), ("b", "injection"), ("c", "benign")} and unknown.count() == 1


def pages(split, offset, length):
    return {"num_rows_total": 250, "rows": [{"row": {"n": i}} for i in range(offset, min(offset + length, 250))]}


def test_paged_source():
    reader = paged.PagedReader({"fetch": "tests.test_corpus:pages", "page": "100"})
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(got) == 250 and got[249][2] == '{"n": 249}'
    assert paged.page_offsets(1000, 100, 5) == [0, 200, 400, 600, 800]
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {}

    assert paged.with_retries(flaky, sleep=waits.append) == {} and waits == [2, 4]


def test_adapters(spark):
    raw = spark.createDataFrame([(0, "{'injection_text': ' ', 'goal': 'g'}", "d", "a"), (1, '{"injection_text": "t"}', "d", "a"), (2, "x", "d", "a")], "ordinal int, injection string, domain string, attack_category string")
    assert sorted(r.text for r in adapters.nemotron(raw).collect()) == ["t"]  # a text of spaces is no text, and the goal does not stand in for it
    raw = spark.createDataFrame([(0, "Hi", "body", "s1"), (1, "", " only ", "s1"), (2, None, None, "s")], "ordinal int, subject string, body string, scenario string")
    assert sorted(r.text for r in adapters.llmail(raw).collect()) == ["Hi\nbody", "only"]
    raw = spark.createDataFrame([(0, "a", "ham", "ham", "en"), (1, "b", "ham", "spam", "en"), (2, "", "ham", "ham", "en")], "ordinal int, text string, label string, label_3class string, language string")
    assert [r.text for r in adapters.sms_ham(raw).collect()] == ["a"]


def test_contexts_with_attacks(spark):
    import hashlib

    raw = spark.createDataFrame([(0, "Base Encoding", "text", "a1"), (1, "Programming Help", "text", "no"), (2, "Clickbait", "text", "a2"), (3, "Clickbait", "text", "a1"), (4, "Eavesdropping", "code", "c")], "ordinal long, category string, kind string, text string")
    texts = [" First one. Second! Third? End ", "", "no end here", None, "A. B. C. D. E."]
    contexts = spark.createDataFrame(list(enumerate(texts)), "ordinal long, context string")
    got = [(r.text, r.label, r.group, r.notes) for r in adapters.spliced_contexts(contexts, raw).orderBy("ordinal").collect()]
    number = lambda x: int(hashlib.sha1(x.encode()).hexdigest()[:8], 16)
    want, pool = [], ["a1", "a2"]
    for ci, c in enumerate(x.strip() for x in texts if x and x.strip()):
        group = "ctx-" + hashlib.sha1(c.encode()).hexdigest()[:12]
        want.append((c, "benign", group, "clean-context"))
        for j in range(4):
            attack, place = pool[(ci * 4 + j) % 2], ("start", "end", "middle")[number(f"{ci}:{j}") % 3]
            ends = [k + 2 for k in range(len(c) - 2) if c[k] in ".!?" and c[k + 1] == " "]
            text = f"{attack}\n{c}" if place == "start" else f"{c}\n{attack}"
            if place == "middle" and ends:
                at = ends[number(c + attack) % len(ends)]
                text = f"{c[:at]}{attack}\n{c[at:]}"
            want.append((text, "injection", group, f"indirect/{place}"))
    assert got == want


def test_registry_order_caps_and_failures(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    sms = spark.createDataFrame([(i, f"please verify your password {i}", "ham", "ham") for i in range(5)], "ordinal long, text string, label string, label_3class string")
    mail = spark.createDataFrame([(i, f"s{i // 2}", "b", "x", "P") for i in range(250)], "ordinal long, subject string, body string, scenario string, split string")
    broken = spark.createDataFrame([(1,)], "other int")
    own = spark.createDataFrame([(0, " made up ", "benign")], "ordinal long, text string, label string")
    found = adapters.registry({"sms-ham": sms, "llmail": mail, "jackhhao": broken, "synthetic": own})
    assert [a.name for a in found] == ["jackhhao", "llmail", "sms-ham", "synthetic"]
    failures = []
    some = [C.Adapter(a.name, a.rows, a.cap_by, 2 if a.cap_by else a.cap and 60, a.page) for a in found]
    got = C.merge(some, cut=lambda df: df.checkpoint(), failed=lambda name, e: failures.append(name))
    by = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    # pages of 100 rows have 50 new texts each: the third begins when 100 are there, and is not taken
    assert failures == ["jackhhao"] and by == {"llmail": 100, "sms-ham": 2, "synthetic": 1}


def test_long_runs_of_space(spark):
    import time

    text = "a" + "\n" * 300_000 + "b"
    began = time.time()
    row = spark.createDataFrame([(text,), (" \n x  y\u00a0",)], "text string").select(T.strip(F.col("text")).alias("s"), T.dedup_key(F.col("text")).alias("k"), T.norm_text(F.col("text")).alias("n")).collect()
    import hashlib

    assert row[0].s == text and row[0].n == "a\n\nb" and row[0].k == hashlib.sha1(b"a b").hexdigest() and row[1].s == "x  y" and row[1].k == hashlib.sha1(b"x y").hexdigest()
    assert time.time() - began < 20


def test_budgets(spark):
    rows = spark.createDataFrame([(i, f"t{i}", None if i == 3 else i % 2 == 0) for i in range(20)], "n long, text string, h boolean")
    got = C.budgeted(rows, F.col("h"), "n", 4, 3, 1).collect()
    assert sorted(r.n for r in got if r.is_hard) == [0, 2, 4] and sorted(r.n for r in got if not r.is_hard) == [1, 3, 5, 7]
    assert C.budgeted(rows.limit(0), F.col("h"), "n", 4, 3, 1).count() == 0


def test_cjk_quota(spark):
    freq = spark.createDataFrame([("日本", 3), ("日", 4), ("本x", 1), ("abc", 99), ("한글", 2), ("かな", 5)], "word string, freq long")
    assert [(r.ch, r.freq) for r in vocab.cjk_quota(freq, 3).collect()] == [("日", 7), ("か", 5), ("な", 5)]
    assert [r.ch for r in vocab.cjk_quota(freq, 99).collect()] == ["日", "か", "な", "本", "글", "한"]


def test_seeded_slots(spark):
    templates, slots = ["Hello {a}, {b}", "{b} only", "none"], {"a": ["x", "y"], "b": ["1", "2", "3"]}
    every = {t.replace("{a}", a).replace("{b}", b) for t in templates for a in slots["a"] for b in slots["b"]}
    got = [synth.picked(spark, templates, slots, 400, seed).orderBy("ordinal").collect() for seed in (1, 1, 2)]
    assert got[0] == got[1] != got[2] and {r.text for r in got[0]} == every


def test_generators(spark):
    slots = {"a": ["x", "y", "z"], "b": ["1", "2"]}
    rows = synth.each_template(spark, ["{a} and {b}", "alone"], slots, 5).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(5)) and [r.text for r in rows] == ["x and 1", "x and 2", "y and 1", "y and 2", "z and 1"]
    assert synth.each_template(spark, ["alone"], slots, 5).count() == 1
    assert synth.each_template(spark, [], slots, 5).count() == 0
    assert synth.spread_product(spark, {"template": ["{a}"], "a": []}, 3).count() == 0
    got = synth.by_language(spark, {"de": ({"template": [" {a}!"], "a": ["eins", "zwei"]}, ["gut"]), "fr": ({"template": ["{a}"], "a": ["un"]}, [])}, 2)
    assert [(r.text, r.label, r.lang, r.notes) for r in got.orderBy("ordinal").collect()] == [
        ("eins!", "injection", "de", "ml-injection/de"), ("zwei!", "injection", "de", "ml-injection/de"), ("gut", "benign", "de", "ml-benign/de"), ("un", "injection", "fr", "ml-injection/fr"),
    ]
    assert synth.by_language(spark, {}, 2).count() == 0
    rows = adapters.generated(got, "synthetic-ml", "own", translated=True)
    assert rows.filter("is_synthetic and is_translated and lang <> ''").count() == 4
