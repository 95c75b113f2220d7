import json

import pytest

from textloom.__main__ import main
from textloom.operators import corpus
from textloom.plans.inputs import corpus as corpus_rows
from textloom.plans import reports


def test_commands(spark, sf_dir, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    corpus_rows(spark, sf_dir).write.parquet(at("rows"))
    main(["build", at("rows"), at("corpus")])
    main(["build", at("rows"), at("corpus")])
    assert "0 rows added" in capsys.readouterr().out
    main(["report", at("corpus")])
    main(["split", at("corpus"), at("split")])
    main(["score", at("split")])
    main(["vocab", at("corpus"), at("vocab"), "--size", "500"])
    main(["coverage", at("corpus"), at("vocab")])
    out = capsys.readouterr().out
    assert "precision" in out and "| TOTAL |" in out
    main(["train", at("split"), at("vocab"), at("model")])
    main(["predict", at("split"), at("vocab"), at("model"), at("predictions")])
    main(["score", at("split"), at("predictions")])
    main(["inspect", at("split"), at("vocab"), at("model"), at("hits"), "--least", "0.0", "--all-fp"])
    hits = spark.read.json(at("hits"))
    sides = spark.read.parquet(at("split"))
    assert hits.count() == sides.filter("side = 'eval' and label = 'benign'").count() and "top_window" in hits.columns
    main(["export", at("model"), at("vocab"), at("manifest")])
    made = json.loads(spark.read.text(at("manifest")).first()["value"])
    assert all(x["bytes"] >= 0 and len(x["sha256"]) == 64 for x in made["artifacts"].values()) and len(made["artifacts"]) > 3
    main(["vocab", at("corpus"), at("other"), "--size", "300", "--bpe", "--min-char-freq", "3", "--cjk-quota", "5", "--lang-weights", "de=4,it=12"])
    with pytest.raises(ValueError, match="vocabulary"):
        main(["predict", at("split"), at("other"), at("model"), at("p2")])
    main(["rebuild", at("corpus"), at("old"), "--first", "50", "--size", "300"])
    with pytest.raises(ValueError, match="not 100000"):
        main(["rebuild", at("corpus"), at("old"), "--first", "100000"])
    with pytest.raises(ValueError, match="evaluation side"):
        main(["rebuild", at("corpus"), at("old"), "--first", "50", "--expect", "51"])
    main(["build", at("rows"), at("corpus"), "--fresh"])
    assert "removed" in capsys.readouterr().out
    main(["repair", at("corpus")])
    assert "nothing to change" in capsys.readouterr().out


def test_bounded_sample(spark, sf_dir):
    rows = corpus_rows(spark, sf_dir)
    a, b = ({r.doc_id for r in corpus.bounded_sample(x, 20, 1, "doc_id").collect()} for x in (rows, rows.repartition(5)))
    assert a == b and len(a) == 20


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.123456789, 1.0], "benign", "en")], "window_text string, logits array<double>, label string, lang string")
    reports.write_logits(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).first().logits == [0.12346, 1.0]
