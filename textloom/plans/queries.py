"""The registered queries and, beside them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import distill, model, repair, scoring, split, synth, vocab
from ..operators import windows as W
from ..schema import EVAL_PERCENT
from ..sources import adapters
from . import sql as Q
from .inputs import corpus, sources, spliced, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with SQL where SQL can say the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def n(column) -> F.Column:
    return F.coalesce(column, F.lit(0)).cast("bigint")


# -- corpus -------------------------------------------------------------------


@query(f"WITH {Q.SPLIT} SELECT side, label, lang, count(*) AS n, CAST(count(*) FILTER (WHERE weak_seed) AS BIGINT) AS weak FROM split GROUP BY ALL")
def corpus_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, fingerprint, keep first copies, split by group, count."""
    kept = C.merge([C.Adapter("documents", lambda: corpus(spark, sf_dir))])
    return split.assign(kept).groupBy("side", "label", "lang").agg(F.count("*").alias("n"), F.count_if("weak_seed").alias("weak"))


@query(f"SELECT doc_id, {Q.norm('text')} AS norm FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {Q.key('text')} AS dk FROM documents")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.dedup_key(F.col("text")).alias("dk"))


@query(f"WITH {Q.GUESS} SELECT doc_id, guess FROM guessed")
def guess_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_lang(F.col("text")).alias("guess"))


@query(f"SELECT 'documents' AS origin, doc_id AS id, {Q.any_of('text', T.FP_HARD_WORDS)} AS fp_hard FROM documents UNION ALL SELECT 'pages', page_id, {Q.any_of('html', T.FP_HARD_WORDS)} FROM pages")
def fp_hard_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), T.is_fp_hard(F.col("text")).alias("fp_hard"))
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), T.is_fp_hard(F.col("html")).alias("fp_hard")))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, sha1(array_to_string(w, ' ')) AS tokens_sha1 FROM (SELECT doc_id, {Q.TOKENS} AS w FROM documents)")
def pre_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.pre_tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.sha1(F.array_join("w", " ")).alias("tokens_sha1"))


@query(f"SELECT doc_id, substr({Q.strip(Q.collapse('text'))}, 1, 160) AS head FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), 160).alias("head"))


@query(f"SELECT conv_id, turn, sha1(text) AS id, 'conv-' || conv_id AS gk, {Q.bucket("'conv-' || conv_id", 100)} AS bucket, sha256(text) AS sha256 FROM conversations")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    gk = split.group_key(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.col("text"))
    return rows.select("conv_id", "turn", F.sha1("text").alias("id"), gk.alias("gk"), T.hash_bucket(gk, 100).alias("bucket"), F.sha2("text", 256).alias("sha256"))


@query(f"WITH {Q.KEPT} SELECT doc_id, dk FROM kept")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge([C.Adapter("documents", lambda: corpus(spark, sf_dir))]).select("doc_id", "dk")


@query(f"WITH {Q.UNION} SELECT source, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM merged GROUP BY source")
def adapter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources in their order; a text of an earlier source is not taken again."""
    merged = C.merge([C.Adapter(k, lambda v=v: v) for k, v in sources(spark, sf_dir).items()])
    return merged.groupBy("source").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@query(f"WITH {Q.KEPT}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY ordinal) AS r FROM kept) SELECT doc_id, lang, label FROM r WHERE r <= 40")
def lang_label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of 40 accepted rows for each language and label; what is capped does not claim its key."""
    return C.merge([C.Adapter("documents", lambda: corpus(spark, sf_dir), ("lang", "label"), 40)]).select("doc_id", "lang", "label")


@query(f"WITH b AS (SELECT doc_id, {Q.any_of('text', T.FP_HARD_WORDS)} AS is_hard, {Q.bucket('text', 4)} AS b FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY is_hard ORDER BY doc_id) AS r FROM b WHERE is_hard OR b = 0) SELECT doc_id, is_hard FROM r WHERE r <= CASE WHEN is_hard THEN 50 ELSE 100 END")
def bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.budgeted(table(spark, sf_dir, "documents"), T.is_fp_hard(F.col("text")), "doc_id", 100, 50, 4).select("doc_id", "is_hard")


@query("SELECT doc_id FROM documents WHERE doc_id % greatest(10, (SELECT max(doc_id) + 1 FROM documents) // 20) < 10")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    total = 0 if last is None else last + 1
    return C.spread_sample(docs, "doc_id", total, 20, 10).select("doc_id")


@query(f"WITH {Q.STAGED} SELECT count(DISTINCT dk) FILTER (WHERE stage = 'ok') AS wrote, count(*) FILTER (WHERE stage = 'ok') - count(DISTINCT dk) FILTER (WHERE stage = 'ok') AS dup, count(*) FILTER (WHERE stage = 'len') AS len, count(*) FILTER (WHERE stage = 'bad') AS bad FROM staged")
def writer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.writer_counters(corpus(spark, sf_dir))


@query(f"WITH {Q.KEPT}, known AS (SELECT DISTINCT dk FROM staged WHERE stage = 'ok' AND doc_id % 2 = 0), s AS (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY ordinal) AS r FROM staged WHERE stage = 'ok' AND dk NOT IN (SELECT dk FROM known)) SELECT doc_id FROM s WHERE r = 1")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run over all rows adds to a corpus that has the rows with even ids."""
    rows = corpus(spark, sf_dir)
    known = C.staged(rows.filter("doc_id % 2 = 0")).filter("stage = 'ok'").select("dk")
    return C.merge([C.Adapter("documents", lambda: rows)], known).select("doc_id")


@query(f"WITH {Q.CORPUS} SELECT facet, value, count(*) AS n, count(*) FILTER (WHERE weak_seed) AS weak, count(*) FILTER (WHERE label = 'injection') AS injections FROM (SELECT 'label' AS facet, label AS value, * FROM corpus UNION ALL SELECT 'source', source, * FROM corpus UNION ALL SELECT 'lang', lang, * FROM corpus UNION ALL SELECT 'all', NULL, * FROM corpus) GROUP BY facet, value")
def composition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.composition(corpus(spark, sf_dir).withColumn("is_injection", F.col("label") == "injection"))


@query(f"WITH {Q.CORPUS}, a AS (SELECT count(*) FILTER (WHERE label = 'injection') - count(*) FILTER (WHERE weak_seed) AS real_positives, count(*) FILTER (WHERE label = 'injection' AND lang <> 'en') AS non_en_positives FROM corpus) SELECT *, real_positives < 500 AS low_positives, non_en_positives < 0.2 * real_positives AS en_dominant FROM a")
def corpus_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.limits(corpus(spark, sf_dir))


@query(f"WITH {Q.CORPUS} SELECT lang, label, count(*) AS n FROM corpus GROUP BY lang, label ORDER BY n DESC, lang, label LIMIT 12")
def top_lang_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked_counts(corpus(spark, sf_dir), ["lang", "label"], 12)


# -- windows ------------------------------------------------------------------


@query(f"WITH {Q.WINDOWS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(idx * 600 AS INTEGER) AS start, CAST(least(idx * 600 + 900, length(text)) AS INTEGER) AS \"end\", sha1(window_text) AS hash FROM windows")
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.explode_windows(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "idx", "start", "end", F.sha1("window_text").alias("hash"))


@query(f"WITH {Q.TRAINING} SELECT doc_id, CAST(idx AS INTEGER) AS idx, label, sha1(window_text) AS hash FROM training")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spliced(corpus(spark, sf_dir)).withColumn("hint", W.position_hint(F.col("source"), F.col("notes")))
    return W.training_windows(rows, ["doc_id"]).select("doc_id", "idx", "label", F.sha1("window_text").alias("hash"))


@query(f"WITH {Q.CWINDOWS}, r AS (SELECT sha1(window_text) AS hash, label, lang, row_number() OVER w AS r, first_value(label) OVER w AS fl FROM cw WINDOW w AS (PARTITION BY sha1(window_text) ORDER BY doc_id, idx)) SELECT hash, max(label) FILTER (WHERE r = 1) AS label, max(lang) FILTER (WHERE r = 1) AS lang, count(*) AS n, count(*) FILTER (WHERE label <> fl) AS conflicts FROM r GROUP BY hash")
def window_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.explode_windows(corpus(spark, sf_dir), ["doc_id", "label", "lang"])
    return distill.unique_windows(out, ["doc_id", "idx"]).select("hash", "label", "lang", "n", "conflicts")


@query(f"WITH {Q.CWINDOWS} SELECT label, count(DISTINCT doc_id) AS docs, count(*) AS windows, count(DISTINCT CASE WHEN n_windows > 1 THEN doc_id END) AS multi FROM cw GROUP BY label")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = W.window_count(F.col("text"))
    return corpus(spark, sf_dir).select("label", count.alias("k")).filter("k > 0").groupBy("label").agg(F.count("*").alias("docs"), F.sum("k").cast("bigint").alias("windows"), F.count_if(F.col("k") > 1).alias("multi"))


@query(f"WITH {Q.CWINDOWS}, l AS (SELECT label, length(window_text) AS v, row_number() OVER (PARTITION BY label ORDER BY length(window_text)) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM cw), p AS (SELECT CAST(unnest([0.5, 0.9, 0.99, 1.0]) AS DOUBLE) AS p) SELECT label, p, n, CAST(v AS BIGINT) AS value FROM l, p WHERE i = least(n - 1, CAST(floor(n * p) AS BIGINT))")
def window_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.explode_windows(corpus(spark, sf_dir), ["label"]).select("label", F.length("window_text").cast("bigint").alias("chars"))
    return W.index_percentile(out, "chars", (0.5, 0.9, 0.99, 1.0), ("label",))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.bucket_scorer(W.explode_windows(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("text", F.col("window_text"))).drop("text")


@query(f"WITH {Q.POOLED} SELECT doc_id, doc_score FROM pooled")
def maxpool_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.max_pool(table(spark, sf_dir, "documents").select("doc_id"), scored_windows(spark, sf_dir), "doc_id")


@query(f"WITH {Q.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM scored) SELECT doc_id, score, CAST(idx AS INTEGER) AS idx, sha1(window_text) AS hash FROM r WHERE r = 1")
def top_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_window(scored_windows(spark, sf_dir), "doc_id").select("doc_id", "score", "idx", F.sha1("window_text").alias("hash"))


# -- split --------------------------------------------------------------------


@query(f"WITH {Q.SPLIT} SELECT doc_id, id, fp_hard, gk, side FROM split")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.assign(C.merge([C.Adapter("documents", lambda: corpus(spark, sf_dir))])).select("doc_id", "id", "fp_hard", "gk", "side")


@query("SELECT source, count(*) AS n FROM documents WHERE sha1(text) IN (SELECT sha1(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0) GROUP BY source")
def suspect_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak positives as suspects: how many rows of each source they exclude."""
    rows = corpus(spark, sf_dir).withColumn("id", F.sha1("text"))
    return split.excluded_by_source(rows, rows.filter((F.col("label") == "injection") & F.col("weak_seed")))


@query(f"WITH t AS (SELECT 'conv-' || conv_id AS gk, {Q.bucket("'conv-' || conv_id", 100)} < 18 AND length(coalesce(text, '')) % 7 <> 0 AS ev FROM conversations) SELECT count(*) AS leaked FROM (SELECT gk FROM t WHERE ev INTERSECT SELECT gk FROM t WHERE NOT ev)")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which a synthetic row is forced to train while others evaluate."""
    rows = sources(spark, sf_dir)["conversations"].withColumn("is_synthetic", F.length(F.coalesce("text", F.lit(""))) % 7 == 0).withColumn("label", F.lit("injection"))
    return split.leaks(split.assign(rows)).agg(F.count("*").alias("leaked"))


@query(f"WITH {Q.KEPT}, s AS (SELECT *, label = 'benign' AND {Q.any_of('text', T.FP_HARD_WORDS)} AS fp_hard FROM kept WHERE ordinal < 500) SELECT CASE WHEN NOT weak_seed AND {Q.bucket("'row-' || dk", 100)} < CASE WHEN fp_hard THEN 30 ELSE 18 END THEN 'eval' ELSE 'train' END AS side, count(*) AS n FROM s GROUP BY side")
def prefix_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.merge([C.Adapter("documents", lambda: corpus(spark, sf_dir))])
    return split.snapshot(kept, "ordinal", 500).groupBy("side").agg(F.count("*").alias("n"))


@query(f"WITH {Q.KEPT}, s AS (SELECT * FROM kept WHERE ordinal < 500) SELECT CASE WHEN NOT weak_seed AND {Q.bucket("'row-' || dk", 100)} < 18 THEN 'eval' ELSE 'train' END AS side, count(*) AS n FROM s GROUP BY side")
def old_prefix_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of a prefix by the old rules, under which hard rows have no share of their own."""
    kept = C.merge([C.Adapter("documents", lambda: corpus(spark, sf_dir))])
    return split.snapshot(kept, "ordinal", 500, hard_percent=EVAL_PERCENT).groupBy("side").agg(F.count("*").alias("n"))


# -- scoring ------------------------------------------------------------------


@query(f"WITH {Q.CORPUS} SELECT label, CASE WHEN {Q.any_of('text', T.BASELINE_MARKERS)} THEN 'injection' ELSE 'benign' END AS pred, count(*) AS n FROM corpus GROUP BY ALL")
def keyword_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("label", T.baseline_predict(F.col("text")).alias("pred")).groupBy("label", "pred").agg(F.count("*").alias("n"))


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for two thirds of the documents; some as a label, some as a score; copies repeat an id."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 0")
    score = T.hash_bucket(F.concat(F.col("text"), F.col("doc_id").cast("string")), 1000) / 1000.0
    return docs.select(F.sha1("text").alias("id"), F.when(F.col("doc_id") % 5 == 0, "injection").alias("pred"), F.when(F.col("doc_id") % 7 != 0, score).alias("score"), F.col("doc_id").alias("ordinal"))


_PREDS = f"""raw AS (SELECT sha1(text) AS id, CASE WHEN doc_id % 5 = 0 THEN 'injection' WHEN doc_id % 7 <> 0 THEN CASE WHEN {Q.bucket('text || doc_id', 1000)} / 1000.0 >= 0.5 THEN 'injection' ELSE 'benign' END END AS pred, doc_id FROM documents WHERE doc_id % 3 <> 0),
    preds AS (SELECT id, arg_max(pred, doc_id) AS pred FROM raw WHERE pred IS NOT NULL GROUP BY id)"""


@query(f"WITH {Q.CORPUS}, {_PREDS} SELECT doc_id, label, pred FROM (SELECT doc_id, label, sha1(text) AS id FROM corpus) LEFT JOIN preds USING (id)")
def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("id", F.sha1("text"))
    return rows.join(scoring.last_predictions(raw_predictions(spark, sf_dir)), "id", "left").select("doc_id", "label", "pred")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("id", F.sha1("text")).withColumn("fp_hard", (F.col("label") == "benign") & T.is_fp_hard(F.col("text")))
    return rows.join(scoring.last_predictions(raw_predictions(spark, sf_dir)), "id", "left")


_JUDGED = f"{Q.CORPUS}, {_PREDS}, judged AS (SELECT c.*, p.pred, label = 'benign' AND {Q.any_of('text', T.FP_HARD_WORDS)} AS fp_hard FROM corpus c LEFT JOIN preds p ON p.id = sha1(c.text))"


@query(f"WITH {_JUDGED} {Q.metrics('judged')}")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(judged(spark, sf_dir))


@query(f"WITH {_JUDGED}, a AS (SELECT coalesce(lang, '?') AS lang, count(*) AS positives, count(*) FILTER (WHERE pred = 'injection') AS tp FROM judged WHERE label = 'injection' AND pred IS NOT NULL GROUP BY ALL) SELECT *, CAST(tp AS DOUBLE) / positives AS recall, positives >= 30 AS measurable FROM a")
def lang_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lang_recall(judged(spark, sf_dir))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).withColumn("fp_hard", (F.col("label") == "benign") & T.is_fp_hard(F.col("text")))
    return W.max_pool(rows, scored_windows(spark, sf_dir), "doc_id")


_SWEPT = f"{Q.CORPUS}, {Q.POOLED}, grid AS (SELECT CAST(unnest([0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]) AS DOUBLE) AS thr), each AS (SELECT thr, label, label = 'benign' AND {Q.any_of('text', T.FP_HARD_WORDS)} AS fp_hard, CASE WHEN doc_score >= thr THEN 'injection' ELSE 'benign' END AS pred FROM corpus JOIN pooled USING (doc_id), grid)"


@query(f"WITH {_SWEPT} {Q.metrics('each', 'thr')}")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sweep(scored_docs(spark, sf_dir).select("label", "fp_hard", "doc_score"))


@query(f"WITH {_SWEPT} SELECT thr, f1 FROM ({Q.metrics('each', 'thr')}) ORDER BY f1 DESC, thr = 0.5 DESC, thr LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_threshold(threshold_sweep(spark, sf_dir))


@query(f"WITH {Q.CORPUS}, {Q.POOLED}, top AS (SELECT doc_id, arg_max(window_text, {{'s': score, 'i': -idx}}) AS window_text FROM scored GROUP BY doc_id) SELECT doc_id, doc_score, {Q.any_of('text', T.FP_HARD_WORDS)} AS fp_hard, lang, source, channel, sha1(text) AS id, substr({Q.strip(Q.collapse('text'))}, 1, 160) AS doc_head, substr({Q.strip(Q.collapse('window_text'))}, 1, 300) AS top_window FROM corpus JOIN pooled USING (doc_id) JOIN top USING (doc_id) WHERE label = 'benign' AND doc_score >= 0.6")
def fp_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_docs(spark, sf_dir).withColumn("id", F.sha1("text"))
    return scoring.drill_down(rows, W.top_window(scored_windows(spark, sf_dir), "doc_id"), "doc_id", all_fp=True)


@query("WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings) SELECT count(*) AS windows, max(greatest(abs(a - c), abs(b - d))) AS max_delta_b, max(greatest(abs(a - b), abs(b - a))) AS max_delta_c, count(*) FILTER (WHERE (b >= a) <> (d >= c)) AS flips_b, count(*) FILTER (WHERE (b >= a) <> (a >= b)) AS flips_c FROM v")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda i, j: table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("embedding")[i].cast("double"), F.col("embedding")[j].cast("double")).alias("logits"))
    return scoring.parity(pair(0, 1), pair(2, 3), pair(1, 0), "vec_id")


# -- synthesis ----------------------------------------------------------------

SLOTS = {"who": ["the team", "your bank", "our school", "the library"], "what": ["a letter", "the report", "this form"], "when": ["today", "by Friday", "next week", "in May", "soon"]}
TEMPLATES = ["Please send {what} to {who} {when}.", "{who} asked for {what}; it is due {when}.", "Forget {what}, {who} will write {when}."]
_SLOT_SQL = ", ".join(f"list_value({', '.join(repr(x) for x in v)}) AS {k}s" for k, v in SLOTS.items())
_COMBOS = f"slots AS (SELECT {_SLOT_SQL}), combos AS (SELECT i AS combo, whos[i // 15 % 4 + 1] AS who, whats[i // 5 % 3 + 1] AS what, whens[i % 5 + 1] AS \"when\" FROM slots, (SELECT unnest(range(0, 60, 4)) AS i))"


@query(f"WITH {_COMBOS} SELECT * FROM combos")
def product_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.strided_product(spark, SLOTS, 14)


@query(f"WITH {_COMBOS}, t AS (SELECT unnest([{', '.join(repr(t) for t in TEMPLATES)}]) AS template) SELECT combo, template, replace(replace(replace(template, '{{who}}', who), '{{what}}', what), '{{when}}', \"when\") AS text FROM t, combos")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([(t,) for t in TEMPLATES], "template string")
    return synth.fill_templates(templates, synth.strided_product(spark, SLOTS, 14), list(SLOTS)).select("combo", "template", "text")


_FILLED = "replace(replace(replace(template, '{who}', who), '{what}', what), '{when}', \"when\")"
_TEMPLATE_LIST = f"[{', '.join(repr(t) for t in TEMPLATES)}]"


# 3 templates, a cap of 20: 8 fills asked of each, a stride of 60 // 8
@query(
    f"WITH slots AS (SELECT {_SLOT_SQL}), combos AS (SELECT i AS combo, whos[i // 15 % 4 + 1] AS who, whats[i // 5 % 3 + 1] AS what, whens[i % 5 + 1] AS \"when\" FROM slots, (SELECT unnest(range(0, 60, 7)) AS i)), "
    f"t AS (SELECT unnest(range(3)) AS no), f AS (SELECT no, combo, {_FILLED} AS text FROM (SELECT no, {_TEMPLATE_LIST}[no + 1] AS template FROM t), combos), "
    f"k AS (SELECT text, min(no * 1000 + combo) AS place FROM f GROUP BY text) SELECT row_number() OVER (ORDER BY place) - 1 AS ordinal, text FROM k ORDER BY place LIMIT 20"
)
def capped_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator that spreads a cap over its templates."""
    return synth.each_template(spark, TEMPLATES, SLOTS, 20)


# the template is a slot, too: a product of 180, a cap of 25, a stride of 7
@query(
    f"WITH slots AS (SELECT {_SLOT_SQL}), combos AS (SELECT i AS combo, {_TEMPLATE_LIST}[i // 60 % 3 + 1] AS template, whos[i // 15 % 4 + 1] AS who, whats[i // 5 % 3 + 1] AS what, whens[i % 5 + 1] AS \"when\" FROM slots, (SELECT unnest(range(0, 180, 7)) AS i)) "
    f"SELECT row_number() OVER (ORDER BY combo) - 1 AS ordinal, text FROM (SELECT min(combo) AS combo, {_FILLED} AS text FROM combos GROUP BY text) ORDER BY combo LIMIT 25"
)
def spread_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator whose template is one slot of the product."""
    return synth.spread_product(spark, {"template": TEMPLATES, **SLOTS}, 25, 25)


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = synth.distinct_union(table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("ordinal")))
    return synth.twins(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ci"), "text"), pool, pool.count())


@query(f"""WITH pool AS (SELECT text, row_number() OVER (ORDER BY o) - 1 AS idx FROM (SELECT text, min(item_id) AS o FROM benchmark GROUP BY text)),
    e AS (SELECT doc_id AS ci, j, d.text AS ctx, p.text AS att, ['start', 'end', 'middle'][{Q.bucket("doc_id || ':' || j", 3)} + 1] AS pos FROM documents d, (SELECT unnest(range(4)) AS j) JOIN pool p ON p.idx = (doc_id * 4 + j) % (SELECT count(*) FROM pool))
    SELECT ci, CAST(j AS INTEGER) AS j, 'ctx-' || substr(sha1(ctx), 1, 12) AS "group", 'injection' AS label, 'indirect/' || pos AS notes, CAST(length(ctx) + length(att) + 1 AS BIGINT) AS chars, CASE pos WHEN 'start' THEN sha1(att || chr(10) || ctx) WHEN 'end' THEN sha1(ctx || chr(10) || att) END AS sha1 FROM e
    UNION ALL SELECT doc_id, -1, 'ctx-' || substr(sha1(text), 1, 12), 'benign', 'clean-context', length(text), sha1(text) FROM documents""")
def splice_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _twins(spark, sf_dir)
    return out.select("ci", "j", "group", "label", "notes", F.length("text").cast("bigint").alias("chars"), F.when(~F.col("notes").endswith("/middle"), F.sha1("text")).alias("sha1"))


@query("SELECT text, row_number() OVER (ORDER BY f, o) - 1 AS idx FROM (SELECT text, min(f) AS f, min_by(o, f * 1000000000 + o) AS o FROM (SELECT text, 0 AS f, item_id AS o FROM benchmark UNION ALL SELECT text, 1, conv_id * 100000 + turn FROM conversations) GROUP BY text)")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("ordinal"))
    b = table(spark, sf_dir, "conversations").select("text", (F.col("conv_id") * 100_000 + F.col("turn")).alias("ordinal"))
    return synth.distinct_union(a, b)


# -- vocabulary ---------------------------------------------------------------


@query(f"WITH {Q.WORDS} SELECT word, count(*) AS freq FROM words GROUP BY word")
def word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.word_freq(table(spark, sf_dir, "documents"))


@query(f"WITH {Q.WORDS} SELECT word, CAST(sum(CASE lang WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END) AS BIGINT) AS freq FROM words GROUP BY word")
def weighted_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([("de", 3), ("fr", 2)], "lang string, weight int")
    return vocab.word_freq(table(spark, sf_dir, "documents"), "lang", weights)


@query(f"WITH {Q.WORDS}, {Q.PIECES} SELECT piece, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT freq, unnest(p) AS piece FROM pieces) GROUP BY piece")
def char_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.char_freq(word_freq(spark, sf_dir))


@query(f"WITH {Q.WORDS}, {Q.PIECES}, q AS (SELECT freq, unnest(list_zip(p[:-2], p[2:])) AS x FROM pieces WHERE len(p) > 1) SELECT x[1] AS a, x[2] AS b, CAST(sum(freq) AS BIGINT) AS n FROM q GROUP BY ALL")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.pair_counts(word_freq(spark, sf_dir))


@query(f"WITH {Q.WORDS}, {Q.PIECES}, q AS (SELECT freq, unnest(list_zip(p[:-2], p[2:])) AS x FROM pieces WHERE len(p) > 1) SELECT x[1] AS a, x[2] AS b, CAST(sum(freq) AS BIGINT) AS n FROM q GROUP BY ALL ORDER BY n DESC, a, b LIMIT 1")
def next_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.next_merge(pair_counts(spark, sf_dir))


@query(f"WITH {Q.WORDS}, {Q.PIECES}, f AS (SELECT piece FROM (SELECT freq, unnest(p) AS piece FROM pieces) GROUP BY piece HAVING sum(freq) >= 50), a AS (SELECT chr(CAST(unnest(range(1024, 1120) || range(1568, 1616)) AS INTEGER)) AS c) SELECT piece FROM f UNION SELECT c FROM a UNION SELECT '##' || c FROM a")
def bpe_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.alphabet(word_freq(spark, sf_dir), 50)


@query(f"""WITH {Q.WORDS}, freq AS (SELECT word, count(*) AS f, min(doc_id * 1000000 + i) AS first FROM words GROUP BY word), ch AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM freq), base AS (SELECT 0 AS b, unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']) AS token, unnest(range(4)) AS r UNION ALL SELECT 1, '##' || c, row_number() OVER (ORDER BY c) FROM ch UNION ALL SELECT 2, c, row_number() OVER (ORDER BY c) FROM ch),
    every AS (SELECT * FROM base UNION ALL SELECT 3, word, row_number() OVER (ORDER BY f DESC, first) FROM freq WHERE word NOT IN (SELECT token FROM base)), i AS (SELECT token, row_number() OVER (ORDER BY b, r) - 1 AS id, b FROM every) SELECT CAST(id AS INTEGER) AS id, token FROM i WHERE id < 2000 OR b < 3""")
def word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.word_vocab(table(spark, sf_dir, "documents"), 2000, order="doc_id")


def _vocab(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["token"]: r["id"] for r in word_vocab(spark, sf_dir).collect()}


@query(None)
def encode_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.explode_windows(table(spark, sf_dir, "documents"), ["doc_id"])
    return vocab.encode(out, _vocab(spark, sf_dir), "window_text").select("doc_id", "idx", "ids", "mask", "n_ids")


@query(None)
def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.coverage(table(spark, sf_dir, "documents"), _vocab(spark, sf_dir))


@query(None)
def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = vocab.train_bpe(word_freq(spark, sf_dir), 1000, least=50)
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string")


# -- soft labels --------------------------------------------------------------

_TEACHER = "teacher AS (SELECT DISTINCT hash, {b1} / 500.0 - 1 AS a, {b2} / 500.0 - 1 AS b FROM (SELECT sha1(window_text) AS hash FROM cw WHERE doc_id % 4 <> 0))".format(b1=Q.bucket("hash || 'a'", 1000), b2=Q.bucket("hash || 'b'", 1000))


def teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits that depend on the window's hash, for the windows of three quarters of the documents."""
    rows = W.explode_windows(table(spark, sf_dir, "documents").filter("doc_id % 4 <> 0"), ["doc_id"]).select(F.sha1("window_text").alias("hash")).distinct()
    part = lambda x: T.hash_bucket(F.concat("hash", F.lit(x)), 1000) / 500.0 - 1
    return rows.withColumn("logits", F.array(part("a"), part("b")))


@query(f"WITH {Q.CWINDOWS}, {_TEACHER} SELECT label, count(*) AS windows, count(t.hash) AS covered, CAST(count(t.hash) AS DOUBLE) / count(*) AS share FROM cw LEFT JOIN teacher t ON t.hash = sha1(window_text) GROUP BY label")
def teacher_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distill.with_teacher(W.explode_windows(corpus(spark, sf_dir), ["doc_id", "label"]), teacher(spark, sf_dir))
    out = rows.groupBy("label").agg(F.count("*").alias("windows"), F.count_if("covered").alias("covered"))
    return out.withColumn("share", F.col("covered") / F.col("windows"))


_LOSS = """WITH v AS (SELECT vec_id, label % 2 = 1 AS y, CAST(embedding[1] AS DOUBLE) * 8 AS a, CAST(embedding[2] AS DOUBLE) * 8 AS b, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE CAST(embedding[3] AS DOUBLE) * 8 END AS s, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE CAST(embedding[4] AS DOUBLE) * 8 END AS t FROM embeddings),
    c AS (SELECT *, -(CASE WHEN y THEN b ELSE a END - ln(exp(a) + exp(b))) AS ce, exp(s / 2) / (exp(s / 2) + exp(t / 2)) AS p1, exp(t / 2) / (exp(s / 2) + exp(t / 2)) AS p2, a / 2 - ln(exp(a / 2) + exp(b / 2)) AS q1, b / 2 - ln(exp(a / 2) + exp(b / 2)) AS q2 FROM v)
    SELECT vec_id, round(exp(b) / (exp(a) + exp(b)), 6) AS p_injection, round(pow(1 - exp(-ce), 1.5) * ce, 6) AS focal, round(0.7 * pow(1 - exp(-ce), 1.5) * ce + 0.3 * 4 * CASE WHEN abs(s) + abs(t) > 0 THEN p1 * (ln(p1) - q1) + p2 * (ln(p2) - q2) ELSE 0 END, 6) AS loss FROM c"""


@query(_LOSS)
def distill_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double") * 8
    none = F.col("vec_id") % 5 == 0
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2 == 1).alias("y"), F.array(at(0), at(1)).alias("logits"), F.array(F.when(none, 0.0).otherwise(at(2)), F.when(none, 0.0).otherwise(at(3))).alias("soft"))
    x, s, y = F.col("logits"), F.col("soft"), F.col("y")
    return rows.select("vec_id", F.round(T.softmax_injection(x), 6).alias("p_injection"), F.round(distill.focal_loss(x, y, 1.5), 6).alias("focal"), F.round(distill.distill_loss(x, s, y, 0.3, 2.0, 1.5), 6).alias("loss"))


@query("SELECT step, round(CASE WHEN step < 100 THEN step / 100.0 ELSE 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) END, 6) AS factor FROM (SELECT unnest(range(1001)) AS step)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1001).select(F.col("id").alias("step"), F.round(distill.lr_factor(F.col("id"), 1000, 0.1), 6).alias("factor"))


@query("SELECT doc_id, CAST(least(768, CAST(ceil(n_chars / 32.0) AS BIGINT) * 32) AS INTEGER) AS padded FROM documents")
def pad_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", distill.pad_quantize(F.col("n_chars")).alias("padded"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 4000) AS truncated, CAST(count(*) FILTER (WHERE n_chars > 4000) AS DOUBLE) / count(*) AS share, count(*) FILTER (WHERE n_chars > 4000) > 0.005 * count(*) AS warn FROM documents")
def truncation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.truncation(table(spark, sf_dir, "documents"), "n_chars", 4000)


@query("WITH p AS (SELECT doc_id, n_chars // 8 + 1 AS n, greatest(32, least(768, CAST(ceil((n_chars // 8 + 1) / 32.0) AS BIGINT) * 32)) AS padded FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY padded ORDER BY n, doc_id) - 1 AS r FROM p) SELECT doc_id, CAST(padded AS INTEGER) AS padded, CAST(r // least(32, greatest(1, 8192 // padded)) AS INTEGER) AS batch FROM r")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars div 8 + 1").alias("len"))
    return distill.token_batches(rows, "len", "doc_id").select("doc_id", "padded", "batch")


# -- repair -------------------------------------------------------------------


@query(f"WITH {Q.GUESS} SELECT doc_id, CASE WHEN lang IN ('de', 'fr') THEN guess ELSE lang END AS lang, CASE WHEN lang IN ('de', 'fr') AND guess <> lang THEN 'lang-fix:' || lang || '->' || guess ELSE '' END AS notes FROM guessed")
def lang_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(corpus(spark, sf_dir).withColumn("source", F.lit("deepset"))).select("doc_id", "lang", "notes")


@query(f"WITH {Q.GUESS} SELECT lang AS old_lang, guess AS new_lang, 'deepset' AS source, count(*) AS n FROM guessed WHERE lang IN ('de', 'fr') AND guess <> lang GROUP BY ALL")
def repair_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.transitions(repair.repair(corpus(spark, sf_dir).withColumn("source", F.lit("deepset"))))


# -- sources ------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.parse_record(F.col("props"), "k bigint")["k"].alias("k"))


@query("SELECT doc_id AS ordinal, text, CASE doc_id % 4 WHEN 0 THEN 'injection' ELSE 'benign' END AS label, 'jackhhao' AS source, 'chat' AS channel FROM documents WHERE doc_id % 4 < 2")
def type_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("jailbreak", "benign", "other", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("prompt"), kinds.alias("type"))
    return adapters.jackhhao(raw).select("ordinal", "text", "label", "source", "channel")


@query("WITH r AS (SELECT doc_id, text, ['English', 'German', 'Russian', 'Klingon'][doc_id % 4 + 1] AS name, ['yes', 'no', ''][doc_id % 3 + 1] AS harm FROM documents) SELECT doc_id AS ordinal, CASE name WHEN 'English' THEN 'en' WHEN 'German' THEN 'de' WHEN 'Russian' THEN 'ru' END AS lang, CASE harm WHEN 'yes' THEN 'injection' ELSE 'benign' END AS label, false AS is_translated FROM r WHERE name <> 'Klingon' AND harm <> '' AND (harm = 'no' OR name <> 'Russian')")
def metadata_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    meta = F.concat(F.lit("{'language': '"), pick(("English", "German", "Russian", "Klingon")), F.lit("'}"))
    raw = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("prompt"), pick(("yes", "no", "")).alias("prompt_harm_label"), meta.alias("metadata"))
    return adapters.polyguard(raw).select("ordinal", "lang", "label", "is_translated")


@query("WITH a AS (SELECT doc_id, doc_id // 100 AS page, n_chars > 1000 AS ok FROM documents), p AS (SELECT page, count(*) FILTER (WHERE ok) AS n FROM a GROUP BY page), b AS (SELECT page, coalesce(sum(n) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT doc_id FROM a JOIN b USING (page) WHERE before < 200")
def page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 100").alias("page"), (F.col("n_chars") > 1000).alias("accepted"))
    return adapters.llmail_pages(raw, cap=200).select("doc_id")


def _picked(values: tuple, by: str = "doc_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _adapted(rows: DataFrame) -> DataFrame:
    return rows.select("ordinal", F.sha1("text").alias("sha1"), "label", "source", "license", "lang", "channel", "is_translated", "is_synthetic", "weak_seed", "group", "notes")


def _adapted_sql(frm: str, label: str, source: str, license: str, channel: str, notes: str, lang: str = "''", text: str = "text", flag: str = "false") -> str:
    return f"""SELECT doc_id AS ordinal, sha1({text}) AS sha1, {label} AS label, '{source}' AS source, {license} AS license, {lang} AS lang, {channel} AS channel, {flag} AS is_translated, {flag} AS is_synthetic, false AS weak_seed, '' AS "group", {notes} AS notes FROM {frm}"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("lang").withColumn("ordinal", F.col("doc_id"))


@query(_adapted_sql("documents", "CASE doc_id % 2 WHEN 1 THEN 'injection' ELSE 'benign' END", "deepset", "'apache-2.0'", "'chat'", "'split=' || ['train', 'test'][doc_id % 2 + 1]"))
def source_deepset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapted(adapters.deepset(_documents(spark, sf_dir).withColumn("label", F.col("doc_id") % 2).withColumn("split", _picked(("train", "test")))))


@query(_adapted_sql("documents WHERE doc_id % 3 < 2", "['injection', 'benign'][doc_id % 3 + 1]", "jackhhao", "'apache-2.0'", "'chat'", "['jailbreak-class', 'jailbreak-ds-benign'][doc_id % 3 + 1]"))
def source_jackhhao(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapted(adapters.jackhhao(_documents(spark, sf_dir).withColumnRenamed("text", "prompt").withColumn("type", _picked((" Jailbreak", "benign", "other")))))


@query(_adapted_sql("documents WHERE doc_id % 4 < 3", "['injection', 'benign', 'injection'][doc_id % 4 + 1]", "bipia", "'mit'", "['url_text', 'url_text', 'tool_result'][doc_id % 4 + 1]", "['text/Base Encoding', 'text/Programming Help', 'code/Data Eavesdropping'][doc_id % 4 + 1] || '/test'"))
def source_bipia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and code attacks; the last of four categories is unknown."""
    raw = _documents(spark, sf_dir).withColumn("category", _picked(("Base Encoding", "Programming Help", "Data Eavesdropping", "New"))).withColumn("kind", _picked(("text", "text", "code", "text"))).withColumn("split", F.lit("test"))
    return _adapted(adapters.attacks(raw)[0])


@query(_adapted_sql("documents WHERE doc_id % 3 < 2", "'injection'", "nemotron", "'cc-by-4.0'", "'tool_result'", "'agentic/shop/' || ['?', 'exfiltration'][doc_id % 2 + 1]", text="['goal ', 'text '][doc_id % 3 + 1] || doc_id"))
def source_nemotron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as Python literals and as JSON; every third holds nothing."""
    number = F.col("doc_id").cast("string")
    record = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{'injection_text': '', 'goal': 'goal "), number, F.lit("'}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"injection_text": " text '), number, F.lit(' ", "goal": "g"}'))).otherwise("none")
    return _adapted(adapters.nemotron(_documents(spark, sf_dir).select("doc_id", "ordinal", record.alias("injection"), F.lit("shop").alias("domain"), _picked((None, "exfiltration")).alias("attack_category"))))


@query(_adapted_sql(f"documents WHERE doc_id % 2 = 0 OR length({Q.strip('text')}) > 0", "'injection'", "llmail", "'mit'", "'email'", "'satml2025 Phase1 s' || doc_id % 5", text=f"CASE doc_id % 2 WHEN 0 THEN {Q.strip(chr(39) + 'Hello' + chr(39) + ' || chr(10) || ' + Q.strip('text'))} ELSE {Q.strip('text')} END"))
def source_llmail(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _documents(spark, sf_dir).withColumnRenamed("text", "body").withColumn("subject", _picked((" Hello ", ""))).withColumn("split", F.lit("Phase1")).withColumn("scenario", F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))
    return _adapted(adapters.llmail(raw))


@query("WITH r AS (SELECT *, ['English', 'German', 'Russian', 'Klingon'][doc_id % 4 + 1] AS name, ['yes', 'no', ''][doc_id % 3 + 1] AS harm FROM documents) " + _adapted_sql(f"r WHERE name <> 'Klingon' AND harm <> '' AND (harm = 'no' OR name <> 'Russian') AND length({Q.strip('text')}) > 0", "CASE harm WHEN 'yes' THEN 'injection' ELSE 'benign' END", "polyguard", "'polyguard-card'", "'chat'", "CASE harm WHEN 'yes' THEN 'jailbreak-class' ELSE 'multilingual-benign' END", "['en', 'de', 'ru'][doc_id % 4 + 1]", Q.strip("text")))
def source_polyguard(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.concat(F.lit("{'language': '"), _picked(("English", "German", "Russian", "Klingon")), F.lit("'}"))
    return _adapted(adapters.polyguard(_documents(spark, sf_dir).withColumnRenamed("text", "prompt").withColumn("prompt_harm_label", _picked(("Yes", "no", ""))).withColumn("metadata", meta)))


@query(f"WITH r AS (SELECT *, {Q.any_of('text', T.FP_HARD_WORDS)} AS hard FROM documents WHERE doc_id % 3 = 0 AND text <> '') " + _adapted_sql(f"r WHERE hard OR {Q.bucket('text', 4)} = 0", "'benign'", "sms-ham", "['mit', 'unknown'][doc_id % 2 + 1]", "'sms'", "CASE WHEN hard THEN 'fp-hard' ELSE 'plain-benign' END", "'de'"))
def source_sms_ham(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _documents(spark, sf_dir).withColumn("label", _picked(("ham", "ham", "phishing"))).withColumn("label_3class", _picked(("ham", "spam", "phishing"))).withColumn("language", F.lit("de")).withColumn("license", _picked(("mit", None)))
    return _adapted(adapters.sms_ham(raw, 4))


@query(_adapted_sql("documents", "'benign'", "synthetic-ml", "'own'", "'chat'", "'ml-benign/de'", "'de'", Q.strip("text"), "true"))
def source_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _documents(spark, sf_dir).withColumns({"label": F.lit("benign"), "lang": F.lit("de"), "notes": F.lit("ml-benign/de")})
    return _adapted(adapters.generated(raw, "synthetic-ml", "own", translated=True))


# -- model seam ---------------------------------------------------------------


@query(f"WITH {Q.SCORED} SELECT doc_id, idx, score FROM scored")
def score_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct window goes through the scorer once."""
    out = W.explode_windows(table(spark, sf_dir, "documents"), ["doc_id"])
    return scoring.score_once(out, "window_text", model.bucket_scorer).select("doc_id", "idx", "score")


@query(None)
def model_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model learned from windows of the training side, pooled over the documents of the other."""
    rows = split.assign(corpus(spark, sf_dir))
    out = W.explode_windows(rows, ["doc_id", "label", "side"]).withColumn("text", F.col("window_text"))
    fitted = model.HashedWords(1 << 16).fit(out.filter("side = 'train'").select("text", "label"))
    scores = fitted(out.filter("side = 'eval'"))
    return W.max_pool(rows.filter("side = 'eval'").select("doc_id", "label"), scores, "doc_id")
