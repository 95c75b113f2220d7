"""Payloads of the known sources as corpus rows; each function takes the source's raw table with its ordinal."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import synth
from ..operators.corpus import Adapter, whole_pages
from ..operators.order import running, sliced

# Categories of attack texts by what their instruction is.
MALICIOUS_CATEGORIES = (
    "Alphanumeric Substitution", "Homophonic Substitution", "Misspelling Intentionally", "Anagramming", "Space Removal & Grouping", "Substitution Ciphers", "Base Encoding",
    "Reverse Text", "Emoji Substitution", "Instruction", "Social Interaction", "Persuasion", "Clickbait", "Malware Distribution", "Information Dissemination",
    "Marketing & Advertising", "Entertainment", "Scams & Fraud", "Misinformation & Propaganda",
)
BENIGN_CATEGORIES = (
    "Information Retrieval", "Content Creation", "Learning and Tutoring", "Language Translation", "Programming Help",
    "Task Automation", "Business Intelligence", "Conversational Agent", "Research Assistance", "Sentiment Analysis",
)
POLYGUARD_CAP, LLMAIL_CAP, SMS_CAP, SMS_MODULO, LLMAIL_PAGES, POLYGUARD_PAGES = 200, 4000, 1500, 40, 130, 200


def as_rows(df: DataFrame, text: Column, label: Column, source: str, license: str | Column, channel: str | Column = "url_text", lang: Column | None = None, group: Column | None = None, notes: Column | None = None, **flags: Column) -> DataFrame:
    none = F.lit("")
    return df.select(
        "ordinal", text.alias("text"), label.alias("label"), F.lit(source).alias("source"), (F.lit(license) if isinstance(license, str) else license).alias("license"), (none if lang is None else lang).alias("lang"), (F.lit(channel) if isinstance(channel, str) else channel).alias("channel"),
        *[flags.get(f, F.lit(False)).alias(f) for f in ("is_translated", "is_synthetic", "weak_seed")], (none if group is None else group).alias("group"), (none if notes is None else notes).alias("notes"),
    )


def or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def optional(raw: DataFrame, column: str, otherwise: str) -> Column:
    """A column that some tables lack, or where it is null, a fixed text."""
    return F.coalesce(F.col(column), F.lit(otherwise)) if column in raw.columns else F.lit(otherwise)


def deepset(raw: DataFrame) -> DataFrame:
    """text, label (1 for an injection) and split."""
    label = F.when(F.col("label").cast("int") == 1, "injection").otherwise("benign")
    return as_rows(raw, or_empty("text"), label, "deepset", "apache-2.0", "chat", notes=F.concat(F.lit("split="), optional(raw, "split", "train")))


def jackhhao(raw: DataFrame) -> DataFrame:
    """prompt and type; other types than jailbreak and benign are left out."""
    kind = F.lower(T.strip(or_empty("type")))
    raw = raw.withColumn("_kind", kind).filter(F.col("_kind").isin("jailbreak", "benign"))
    bad = F.col("_kind") == "jailbreak"
    return as_rows(raw, or_empty("prompt"), F.when(bad, "injection").otherwise("benign"), "jackhhao", "apache-2.0", "chat", notes=F.when(bad, "jailbreak-class").otherwise("jailbreak-ds-benign"))


def nemotron(raw: DataFrame) -> DataFrame:
    """The injected text, or the goal where there is none, of a record that is JSON or a Python literal. A text that is only space is left out."""
    raw = raw.withColumn("_r", T.parse_record(F.col("injection"), "injection_text string, goal string"))
    text = T.strip(F.coalesce(F.nullif("_r.injection_text", F.lit("")), F.col("_r.goal"), F.lit("")))
    notes = F.concat_ws("/", F.lit("agentic"), optional(raw, "domain", "?"), optional(raw, "attack_category", "?"))
    return as_rows(raw.withColumn("_text", text).filter("_text <> ''"), F.col("_text"), F.lit("injection"), "nemotron", "cc-by-4.0", "tool_result", notes=notes)


def llmail(raw: DataFrame) -> DataFrame:
    """subject, body, scenario and split; page (100 rows) is kept for the cap on pages."""
    text = T.subject_and_body(T.strip(or_empty("subject")), T.strip(or_empty("body")))
    notes = T.strip(F.concat_ws(" ", F.lit("satml2025"), optional(raw, "split", ""), optional(raw, "scenario", "")))
    rows = as_rows(raw.withColumn("_text", text).filter("_text <> ''"), F.col("_text"), F.lit("injection"), "llmail", "mit", "email", notes=notes)
    return rows.withColumn("page", F.expr("ordinal div 100"))


def llmail_pages(raw: DataFrame, accepted: str = "accepted", page: str = "page", cap: int = LLMAIL_CAP) -> DataFrame:
    """Pages of which the accepted rows before are below the cap: a page is taken whole."""
    return whole_pages(raw, page, cap, F.col(accepted).cast("int"))


def sampled(raw: DataFrame, pages: int, page: int = 100) -> DataFrame:
    """A systematic sample of pages of each split (or of all rows) by their ordinals, which count on from split to split."""
    by = ["split"] if "split" in raw.columns else []
    about = raw.groupBy(*by).agg(F.min("ordinal").alias("_first"), F.greatest(F.lit(page), F.expr(f"count(*) div {pages}")).alias("_step"))  # a row for each split
    rows = raw.join(F.broadcast(about), by) if by else raw.crossJoin(F.broadcast(about))
    return rows.filter(F.pmod(F.col("ordinal") - F.col("_first"), F.col("_step")) < page).drop("_first", "_step")


def polyguard(raw: DataFrame) -> DataFrame:
    """Rows with a known verdict and language; positives in scripts other than Latin are left out."""
    code = T.language_code(T.strip(F.coalesce(T.parse_quoted_json(F.col("metadata"), "language string")["language"], F.lit(""))))
    rows = raw.withColumns({"_code": code, "_harm": F.lower(T.strip(or_empty("prompt_harm_label"))), "_text": T.strip(or_empty("prompt"))})
    rows = rows.filter(F.col("_code").isNotNull() & F.col("_harm").isin("yes", "no") & (F.col("_text") != ""))
    bad = F.col("_harm") == "yes"
    rows = rows.filter(~bad | F.col("_code").isin(*T.LATIN_CODES))
    return as_rows(rows, F.col("_text"), F.when(bad, "injection").otherwise("benign"), "polyguard", "polyguard-card", "chat", lang=F.col("_code"), notes=F.when(bad, "jailbreak-class").otherwise("multilingual-benign"))


def sms_ham(raw: DataFrame, modulo: int = 1) -> DataFrame:
    """Messages that are ham by both labels: all that look like an attack, and of the others one hash bucket of `modulo`."""
    rows = raw.filter((F.col("label") == "ham") & (F.col("label_3class") == "ham") & (or_empty("text") != ""))
    rows = rows.withColumn("_hard", T.is_fp_hard(F.col("text"))).withColumn("_license", optional(rows, "license", "unknown"))
    rows = rows.filter(F.col("_hard") | (T.hash_bucket(F.col("text"), modulo) == 0))
    out = as_rows(rows, F.col("text"), F.lit("benign"), "sms-ham", F.col("_license"), "sms", lang=optional(rows, "language", ""), notes=F.when(F.col("_hard"), "fp-hard").otherwise("plain-benign"))
    return out


def attacks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of (category, ordinal, text, and optionally kind and split): texts in a known category and all code attacks; and the texts in an unknown one."""
    code = optional(raw, "kind", "text") == "code"
    label = F.when(code | F.col("category").isin(*MALICIOUS_CATEGORIES), "injection").when(F.col("category").isin(*BENIGN_CATEGORIES), "benign")
    notes = F.concat_ws("/", F.when(code, "code").otherwise("text"), F.col("category"), optional(raw, "split", "train"))
    rows = as_rows(raw.filter(label.isNotNull()), F.col("text"), label, "bipia", "mit", F.when(code, "tool_result").otherwise("url_text"), notes=notes)
    return rows, raw.filter(label.isNull())


def known_attacks(raw: DataFrame) -> DataFrame:
    """The rows of attacks(); texts in unknown categories are skipped with a warning that names the commonest of these."""
    rows, unknown = attacks(raw)
    if found := unknown.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(20).collect():
        warnings.warn("texts in unknown categories are skipped: " + ", ".join(f"{r['category']} ({r['n']})" for r in found), stacklevel=2)
    return rows


def spliced_contexts(contexts: DataFrame, raw: DataFrame) -> DataFrame:
    """E-mail contexts (ordinal, context), each clean and with four attack texts of `raw` spliced in, all of one group."""
    texts = raw.filter((optional(raw, "kind", "text") == "text") & F.col("category").isin(*MALICIOUS_CATEGORIES))
    pool = synth.distinct_union(texts.select("text", "ordinal"))
    own = contexts.select("ordinal", T.strip(or_empty("context")).alias("text")).filter("text <> ''")
    own = running(own, [], [sliced("ordinal")], ["ordinal"], F.lit(1), "ci")
    rows = synth.twins(own, pool, pool.count())
    rows = rows.withColumn("ordinal", F.col("ci") * (synth.ATTACKS_PER_CONTEXT + 1) + F.col("j") + 1)
    return as_rows(rows, F.col("text"), F.col("label"), "bipia-ctx", "mit", "email", group=F.col("group"), notes=F.col("notes"))


def generated(raw: DataFrame, source: str, license: str, channel: str = "chat", translated: bool = False) -> DataFrame:
    """Texts of a generator (ordinal, text, label, lang, notes; see operators/synth.py) as rows of a synthetic source."""
    return as_rows(raw, T.strip(F.col("text")), F.col("label"), source, license, channel, lang=optional(raw, "lang", ""), notes=optional(raw, "notes", ""), is_synthetic=F.lit(True), is_translated=F.lit(translated))


def registry(raw: dict[str, DataFrame], license: str = "synthetic") -> list[Adapter]:
    """The adapters for which there is a raw table, in their fixed order, with their samples and caps.

    The three generated sources are tables of texts made from the caller's own
    templates; `license` is theirs. bipia-ctx needs the table of bipia, too.
    """
    order = (
        ("deepset", deepset, {}), ("jackhhao", jackhhao, {}), ("bipia", known_attacks, {}), ("bipia-ctx", lambda r: spliced_contexts(r, raw["bipia"]), {}), ("nemotron", nemotron, {}),
        ("llmail", lambda r: llmail(sampled(r, LLMAIL_PAGES)), {"cap": LLMAIL_CAP, "page": "page"}), ("polyguard", lambda r: polyguard(sampled(r, POLYGUARD_PAGES)), {"cap_by": ("lang", "label"), "cap": POLYGUARD_CAP}), ("sms-ham", lambda r: sms_ham(r, SMS_MODULO), {"cap_by": ("notes",), "cap": SMS_CAP}),
        ("synthetic", lambda r: generated(r, "synthetic", license), {}), ("email-benign", lambda r: generated(r, "email-benign", license, "email"), {}), ("synthetic-ml", lambda r: generated(r, "synthetic-ml", license, translated=True), {}),
    )
    return [Adapter(name, lambda f=f, name=name: f(raw[name]), **how) for name, f, how in order if name in raw]
