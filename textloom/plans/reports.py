"""Sinks and reports: small results as files that people and other tools read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def coverage_markdown(coverage: DataFrame) -> str:
    """The coverage table (a row for each language, and TOTAL) as Markdown, largest language first."""
    rows = sorted(coverage.collect(), key=lambda r: (r["lang"] == "TOTAL", -r["messages"], r["lang"]))
    lines = ["| lang | words | unknown | messages | fitting |", "|---|---:|---:|---:|---:|"]
    for r in rows:
        share = lambda a, b: f"{100 * a / b:.2f} %" if b else "-"
        lines.append(f"| {r['lang']} | {r['words']} | {share(r['unknown'], r['words'])} | {r['messages']} | {share(r['fitting'], r['messages'])} |")
    return "\n".join(lines) + "\n"


def write_predictions(rows: DataFrame, path: str) -> None:
    """id and pred or score as JSON lines."""
    rows.select("id", *[c for c in ("pred", "score") if c in rows.columns]).write.mode("overwrite").json(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """A drill-down as JSON lines, in its order."""
    hits.write.mode("overwrite").json(path)


def write_logits(windows: DataFrame, path: str, digits: int = 5) -> None:
    """hash, logits, label and lang of scored windows as JSON lines, longest texts in tasks of their own."""
    rows = windows.select(F.sha1("window_text").alias("hash"), F.transform("logits", lambda x: F.round(x, digits)).alias("logits"), "label", "lang", F.length("window_text").alias("_n"))
    rows.repartitionByRange("_n").sortWithinPartitions("_n").drop("_n").write.mode("overwrite").json(path)


def write_manifest(spark: SparkSession, artifacts: list[str], path: str, **about) -> dict:
    """A JSON file with the bytes and the sha256 of each artifact (a file, or a folder's files), by its name, and what else is known of the export."""
    made = {}
    for artifact in artifacts:
        rows = files.manifest(spark, artifact).collect()  # a row for each file of a model or a vocabulary
        if not rows:
            raise FileNotFoundError(artifact)
        for r in rows:
            made[r["path"].split("/")[-2] + "/" + r["path"].split("/")[-1]] = {"bytes": r["bytes"], "sha256": r["sha256"]}
    out = {"artifacts": dict(sorted(made.items())), **about}
    spark.createDataFrame([(json.dumps(out, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out
