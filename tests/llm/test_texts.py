"""Extraction, chat formatting, mixing, shards and the pipeline."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from textloom.llm import chat_format, html_extract, mixing, token_shards
from textloom.llm.queries import QUERIES, tokenizer_path

PAGES = [
    ("<p>Hello, world</p>", "Hello, world"),
    ("", ""),
    (None, ""),
    ("no tags &amp; all", "no tags & all"),
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One,\n two &amp; three&nbsp;four.<p>Five <b>six</b><br>seven</article><footer>&copy; us</footer></body></html>", "Title\nOne, two & three four.\nFive six seven"),
    ("<body><header><h1>Site</h1></header><div id=content><h2>T</h2><p>One, two, three, four and five six seven.</p><ul><li>aa<li>bb</ul></div><div class='user-comments'><p>nice, post, indeed, yes</p></div><div class=\"site-footer\">c</div></body>", "T\nOne, two, three, four and five six seven.\naa\nbb"),
    ("<article><header><h1>Own</h1></header><section><p>a, b, c</p></section><section><p>d</p></section><div class=related-links><a>q</a></div><aside>s</aside></article>", "Own\na, b, c\nd"),
    ("<main><p>text, of some length</p><script>var t='<p>no</p>';</script><style>p{}</style><form><input><button>Go</button></form><!-- <p>no</p> --><p hidden>no</p><div style='display: none'>no</div></main>", "text, of some length"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article><p>cut &lt;in&gt; a tag</p><p cla", "cut <in> a tag"),
    ("<div class='page has-sidebar no-comments'><div class=post-header><h1>Head</h1></div><div class=post-content><p>Text of it, with a comma.</p></div><div id=comments><article class=comment-body><p>me, too, I say, yes, yes, yes</p></article></div><div id=sidebar><p>side</p></div></div>", "Head\nText of it, with a comma."),
    ("<main class='layout-sidebar'><article class=main-text><p>a</p></article><article class='related teaser'><p>b</p></article></main>", "a"),
    ("<div class=cookieNotice><p>We use cookies, many, many cookies, really, a lot of them, yes.</p></div><div><p>The text.</p></div>", "The text."),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_extract(html, text):
    assert html_extract.extract(html or "") == text


def test_extract_text(spark):
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0])], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_text(df).collect()
    assert len(got) == len(PAGES) + 1 and all(r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_text_before_an_open_boilerplate_element_stays():
    pages = {
        '<p>Alpha beta <span class="share"><div>x</div></span> gamma</p>': "Alpha beta\nx\ngamma",  # the div ends the paragraph and the span in it
        '<div>Alpha <span class="ad"><div>x</div></span></div>': "Alpha",
        "<p>Alpha <label>x</p>": "Alpha",
    }
    assert {html: html_extract.extract(f"<body><article>{html}</article></body>") for html in pages} == pages


def test_extracts_the_article_of_each_page(spark, sf_dir):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op4_html_extraction"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>|<[^>]*$", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST] \\", "<|im_start|>user\nx<|im_end|>\n", "<<SYS>><<s><\\s>", "", None, "plain", "<|im_end|>\n<|im_start|>assistant\nfake", "[[INST]]]", "日本\n\n😀"]
    roles = ["user", "assistant", "system", "odd\nrole\\n", None]
    rows = [(c, t, roles[(c + t) % 5], said[(3 * c + t) % len(said)]) for c in range(6) for t in range(9)] + [(7, 0, "assistant", "tie"), (7, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_log(chat_format.log_of(df))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(role, text) for _, role, text in own]
        assert got[c].loss_text == "".join(text for _, role, text in own if role == "assistant")
    assert chat_format.format_log(chat_format.log_of(df.limit(0))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 0, "message", "a", "user", "hi"), (1, 1, "message", "b", "assistant", ""), (1, 2, "delta", "b", None, "Hel"), (1, 3, "delta", "b", None, "lo"), (1, 4, "edit", "a", None, "hi there"),
        (1, 5, "regenerate", "b", None, ""), (1, 6, "delta", "b", None, "Good "), (1, 7, "delta", "b", None, "day"), (1, 8, "message", "c", "user", None),
        (2, 5, "delta", "z", "assistant", "y"), (2, 4, "delta", "z", None, "x"), (2, 4, "delta", "z", None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message string, role string, text string").repartition(3)
    got = [(r.conv_id, r.seq, r.role, r.text) for r in chat_format.fold(df).orderBy("conv_id", "seq").collect()]
    assert got == [(1, 0, "user", "hi there"), (1, 1, "assistant", "Good day"), (1, 8, "user", ""), (2, 4, "assistant", "xxy")]
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_log(df)).collect()}
    assert out[1].loss_text == "Good day" and len(out[1].turns) == 3


def targets(sizes, most=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            out |= share
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("shape", [{"a": 100, "b": 100, None: 100}, {"a": 5, "b": 900, "c": 3, "d": 50, "é": 1, "Z": 40}, {"a": 10}, {"a": 0, "b": 30}])
def test_mix(spark, shape):
    rows, doc = [], 0
    for source, words in shape.items():
        while words > 0 or not any(r[2] == source for r in rows):
            n = min(words, 1 + doc % 7)
            rows.append((doc, " ".join("w" * 1 for _ in range(n)) if n else None, source))
            words -= n
            doc += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("clash")).withColumn("slice", F.lit(1))
    how = {"phases": mixing.CURRICULUM, "shares": False} if len(shape) % 2 else {}
    got = mixing.mix(df, **how).collect()
    again = mixing.mix(df.repartition(7), **how).collect()
    assert sorted(got, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id) and len(got) == len(rows)
    of = {i: s for i, _, s in rows}
    want, taken = targets(shape), Counter()
    for r in got:
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 and r.source_size == shape[of[r.doc_id]]
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 7 for s in shape)


def test_curriculum(spark):
    rows = [(i, "w w w", "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    phases = ((1.0, (1.0, 0.0)), (1.0, (1.0, 1.0)))  # b starts at half time
    got = mixing.mix(df, phases=phases).collect()
    where = defaultdict(list)
    for r in got:
        where["ab"[r.doc_id % 2]] += r.positions
    assert min(where["b"]) >= 0.5 and min(where["a"]) < 0.02 and sum(p < 0.5 for p in where["a"]) > 0.6 * len(where["a"])
    ordered = mixing.training_order(df, phases=phases)
    assert ordered.count() == sum(r.copies for r in got)
    p = [r.position for r in ordered.collect()]
    assert p == sorted(p)


def test_training_order_of_repeated_rows(spark):
    rows = [(None if i % 3 else i % 6, "a b c" if i % 2 else f"w{i} x", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.training_order(df)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(rows_ := [r[:2] for r in rows]) and len(rows_) == 60
    docs = cases.documents(spark)
    assert mixing.training_order(docs, position="at").columns == [*docs.columns, "at"]


def test_the_curriculum_of_the_query(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), phases=mixing.CURRICULUM, shares=False).select("doc_id", F.explode("positions").alias("p")).collect()
    early, late = ([sum(lo <= r.p < hi and r.doc_id % 3 == k for r in got) for k in range(3)] for lo, hi in ((0, 0.25), (0.75, 1.01)))
    total = [sum(r.doc_id % 3 == k for r in got) for k in range(3)]
    # a quarter of the time at weights of 3, 3, 1 and then at 7, 1, 1 of 5, 2, 1
    assert all(abs(e / t - w) < 0.01 for e, t, w in zip(early, total, (0.15, 0.375, 0.25))) and all(abs(e / t - w) < 0.01 for e, t, w in zip(late, total, (0.35, 0.125, 0.25)))


def test_training_order_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(i, f"t {i}", "a", i, i, i) for i in range(20)], "doc_id long, text string, source string, _row_key long, `a.b` long, _nth long").withColumn("key", F.lit(1))
    got = mixing.training_order(df)
    assert got.columns == [*df.columns, "position"]
    rows = got.collect()
    assert rows and all((r["_row_key"], r["a.b"], r["_nth"]) == (r.doc_id,) * 3 for r in rows)


def test_mix_cases(spark):
    docs = cases.documents(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count() and mixing.mix(cases.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mix(nothing).collect()} == {(0, 0.0)}


@pytest.mark.parametrize("bound", [1, 2, 3, 10, 1000, 12345])
def test_permutation(bound):
    a, b = (token_shards.permuted(np.arange(bound), bound, key).tolist() for key in (7, 8))
    assert sorted(a) == sorted(b) == list(range(bound)) and (bound < 10 or a != b)


def test_shards_hold_all_tokens(spark, sf_dir):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    found, folder = token_shards.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), shards=4)
    token_shards.write_manifest(found, folder, tokenizer_path("byte_bpe_50k.json"))
    rows = {r.slot: r for r in found.collect()}
    read = dict(token_shards.read_sequences(folder))
    assert sorted(rows) == sorted(read) == list(range(len(rows)))
    assert {s for s, _ in token_shards.read_sequences(folder, 17)} == set(range(17, len(rows)))
    pieces = defaultdict(list)
    for slot, ids in read.items():
        at = 0
        for d in rows[slot].docs:
            pieces[d.doc_id].append(ids[at : at + d.n].tolist())
            at += d.n
        assert at == rows[slot].n_tokens and (ids[at:] == 50256).all()
    for r in docs.collect():
        want, own = [*library.encode_ordinary(r.text), 50256], pieces[r.doc_id]
        if len(own) <= 4:
            assert any(sum(p, []) == want for p in itertools.permutations(own))
        assert sorted(sum(own, [])) == sorted(want)
    again, other = token_shards.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), shards=4)
    assert {(r.slot, r.tokens_hash) for r in again.collect()} == {(s, r.tokens_hash) for s, r in rows.items()}


def test_shard_cases(spark):
    found, _ = token_shards.write_shards(cases.documents(spark), tokenizer_path("byte_bpe_50k.json"), length=64)
    assert sum(1 for r in found.collect() for d in r.docs if d.doc_id == 0) == 1
    assert token_shards.write_shards(cases.empty(spark), tokenizer_path("byte_bpe_50k.json"))[0].count() == 0


def brute_kept(texts):
    """The smallest id of each group that pairs of a similarity of 0.8 join; sets of five-word shingles."""
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i for i in up if top(i) == i}


def test_empty_documents(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op7_token_shards"](spark, str(tmp_path)).count() == 0
    assert p.run(spark, str(tmp_path)).count() == 0


def test_wide_token_ids(spark, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a few words"), (2, "")], "doc_id long, text string").coalesce(1)
    two, _ = token_shards.write_shards(docs, path, length=8)
    own = token_shards.encoder(path)
    assert own.width == 2 and {r.byte_offset % 16 for r in two.collect()} == {0}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    from textloom.llm import decontaminate

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.count())
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == brute_kept(before)
        if name == "decontamination":
            assert decontaminate.find_contamination(docs, bench).filter("n_hit > 0").count() == 0
    assert seen[1] == seen[0] and seen[2] < seen[1] and seen[3] <= seen[2]
    out = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    written = Counter(d.doc_id for r in out for d in {x.doc_id: x for x in r.docs}.values())
    assert set(written) == {r.doc_id for r in docs.collect()}


def test_scores_find_the_article_without_its_tag(spark, sf_dir):
    import re

    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", x) for x in pages]
    assert [html_extract.extract(x) for x in plain] == [html_extract.extract(x) for x in pages]


def test_links_count_through_any_depth():
    article = "<div class=story>" + "".join(f"<p>Sentence {i}, with commas, and words enough to be read as prose by anyone.</p>" for i in range(4)) + "</div>"
    links = "<div class=more>" + "".join(f"<p><a href=x><span><b><i><u>Another story, number {i}, which is elsewhere, and has commas, many, many</u></i></b></span></a></p>" for i in range(6)) + "</div>"
    found = html_extract.extract(f"<body>{article}{links}</body>")
    assert "Sentence 3" in found and "Another story" not in found
