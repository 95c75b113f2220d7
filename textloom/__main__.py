"""Command line: python -m textloom COMMAND ...

report ROWS                      composition of a corpus (parquet or JSON lines)
build ROWS CORPUS [--fresh]      append the new rows to a corpus, or begin it anew
split CORPUS OUT [--suspects F]  write the train and evaluation sides
score SPLIT [PREDICTIONS]        metrics of predictions, or of the keyword baseline
vocab ROWS OUT [--size N] [--bpe [--min-char-freq N] [--cjk-quota N] [--lang-weights de=4,it=12]]
coverage ROWS VOCAB              word coverage by language, as Markdown
repair CORPUS                    guess languages anew where they were guessed
train SPLIT VOCAB MODEL          fit the stand-in on the training side; the model keeps the vocabulary's fingerprint
predict SPLIT VOCAB MODEL OUT    scores of the evaluation side, as a prediction file; another vocabulary is refused
inspect SPLIT VOCAB MODEL OUT    benign texts with high scores (--least), hard ones or all (--all-fp), with snippets
export MODEL VOCAB OUT           a manifest of the files of both with sizes and hashes
rebuild CORPUS OUT --first N     vocabulary of the first rows' training side under the old split rules (--expect N checks the other side)
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import text as T
from .operators import corpus, model, repair, scoring, split, vocab
from .operators import windows as W
from .plans import reports
from .sources import files


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return files.jsonl(spark, path, missing_ok=False).withColumn("ordinal", F.monotonically_increasing_id())
    return spark.read.parquet(path)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["report", "build", "split", "score", "vocab", "coverage", "repair", "train", "predict", "inspect", "export", "rebuild"])
    p.add_argument("paths", nargs="+")
    p.add_argument("--suspects")
    p.add_argument("--size", type=int, default=S.VOCAB_SIZE)
    p.add_argument("--bpe", action="store_true")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--min-char-freq", type=int, default=2)
    p.add_argument("--cjk-quota", type=int, default=0)
    p.add_argument("--lang-weights", default="", help="how often a language's rows count, as lang=n,...")
    p.add_argument("--least", type=float, default=0.60)
    p.add_argument("--all-fp", action="store_true")
    p.add_argument("--first", type=int)
    p.add_argument("--expect", type=int)
    p.add_argument("--lang", default="lang", help="the column that holds the language")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    first = a.paths[0]
    if a.command == "report":
        rows = read(spark, first).withColumn("is_injection", F.col("label") == "injection")
        corpus.composition(rows).orderBy("facet", F.desc("n"), "value").show(1000, False)
        corpus.limits(rows).show()
    elif a.command == "build":
        if a.fresh and corpus.reset(spark, a.paths[1]):
            print("removed", a.paths[1])
        print(corpus.append(read(spark, first), a.paths[1]), "rows added")
    elif a.command == "split":
        rows = split.assign(read(spark, first))
        if a.suspects:
            rows = split.without(rows, files.suspects(spark, a.suspects))
        split.check_leaks(rows)
        split.write_split(rows, a.paths[1])
    elif a.command == "score":
        rows = files.evaluation_rows(spark, first)
        if len(a.paths) > 1:
            rows = rows.join(scoring.last_predictions(files.predictions(spark, a.paths[1])), "id", "left")
        else:
            rows = rows.withColumn("pred", T.baseline_predict(F.col("text")))
        scoring.confusion(rows).show(vertical=True)
        scoring.lang_recall(rows).orderBy(F.desc("positives"), "lang").show(1000)
    elif a.command == "vocab":
        rows = read(spark, first)
        if a.bpe:
            weights = [(k.strip(), int(v)) for k, _, v in (x.partition("=") for x in a.lang_weights.split(",") if x)]
            freq = vocab.word_freq(rows, a.lang, spark.createDataFrame(weights, "lang string, weight long")) if weights else vocab.word_freq(rows)
            tokens = vocab.train_bpe(freq, a.size, a.min_char_freq, a.cjk_quota)
            vocab.write_vocab(spark.createDataFrame(list(enumerate(tokens)), "id int, token string"), a.paths[1])
        else:
            vocab.write_vocab(vocab.word_vocab(rows, a.size), a.paths[1])
    elif a.command == "coverage":
        print(reports.coverage_markdown(vocab.coverage(read(spark, first), vocab.read_vocab(spark, a.paths[1]), a.lang)))
    elif a.command == "repair":
        print("changed" if repair.rewrite(repair.repair(read(spark, first)), first) else "nothing to change")
    elif a.command == "train":
        fitted = model.HashedWords().fit(spark.read.parquet(first).filter("side = 'train'").select("text", "label"))
        fitted.save(f"{a.paths[2]}/weights")
        write_unit(spark, a.paths[2], model.vocab_fingerprint(vocab.read_vocab(spark, a.paths[1])))
    elif a.command == "predict":
        unit = model.Unit(model.HashedWords.load(f"{a.paths[2]}/weights"), read_unit(spark, a.paths[2]))
        reports.write_predictions(unit.score(files.evaluation_rows(spark, first), vocab.read_vocab(spark, a.paths[1])), a.paths[3])
    elif a.command == "inspect":
        unit = model.Unit(model.HashedWords.load(f"{a.paths[2]}/weights"), read_unit(spark, a.paths[2]))
        rows = files.evaluation_rows(spark, first).withColumn("doc", F.col("id"))
        windows = unit.score(W.explode_windows(rows, ["doc"]).withColumn("text", F.col("window_text")), vocab.read_vocab(spark, a.paths[1]))
        hits = scoring.drill_down(W.max_pool(rows, windows, "doc"), W.top_window(windows, "doc"), "doc", a.least, a.all_fp)
        reports.write_hits(hits, a.paths[3])
        hits.show(40, 80)
    elif a.command == "export":
        about = {"vocab_fingerprint": model.vocab_fingerprint(vocab.read_vocab(spark, a.paths[1])), "threshold": S.SCORE_THRESHOLD, "labels": list(S.LABELS)}
        if about["vocab_fingerprint"] != read_unit(spark, first):
            raise ValueError("the vocabulary is not the one the model was made with")
        print(reports.write_manifest(spark, a.paths[:2], a.paths[2], **about))
    elif a.command == "rebuild":
        if a.first is None:
            p.error("--first is missing")
        rows = read(spark, first).orderBy("ordinal").limit(a.first)
        if (n := rows.count()) < a.first:
            raise ValueError(f"the corpus has {n} rows, not {a.first}")
        old = split.snapshot(rows, "ordinal", (1 << 63) - 1, a.expect, S.EVAL_PERCENT).filter("side = 'train'")
        vocab.write_vocab(vocab.word_vocab(old, a.size), a.paths[1])


def write_unit(spark: SparkSession, path: str, fingerprint: str) -> None:
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/vocabulary")


def read_unit(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/vocabulary").first()["value"]


if __name__ == "__main__":
    main()
