"""The model seam: anything that turns (hash, text) into (hash, score), with a stand-in that Spark trains."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Scorer = Callable[[DataFrame], DataFrame]


def bucket_scorer(rows: DataFrame) -> DataFrame:
    """A score that depends on the text's hash only; for tests and plumbing."""
    return rows.withColumn("score", T.hash_bucket(F.col("text"), 1000) / F.lit(1000.0))


def keyword_scorer(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.when(T.baseline_predict(F.col("text")) == "injection", 1.0).otherwise(0.0))


def vocab_fingerprint(vocab: dict[str, int]) -> str:
    return hashlib.sha256("\n".join(f"{i} {t}" for t, i in sorted(vocab.items(), key=lambda x: x[1])).encode()).hexdigest()


@dataclass
class Unit:
    """A scorer and the vocabulary it was made with, which belong together: with another vocabulary it refuses to score."""

    scorer: Scorer
    fingerprint: str

    def score(self, rows: DataFrame, vocab: dict[str, int]) -> DataFrame:
        if vocab_fingerprint(vocab) != self.fingerprint:
            raise ValueError("the vocabulary is not the one the model was made with")
        return self.scorer(rows)


@dataclass
class HashedWords:
    """Logistic regression over hashed word counts; classes weigh alike."""

    features: int = 1 << 18
    fitted: object = None

    def _vectors(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import HashingTF

        return HashingTF(inputCol="_words", outputCol="features", numFeatures=self.features).transform(rows.withColumn("_words", T.pre_tokenize(F.col("text"), False))).drop("_words")

    def fit(self, rows: DataFrame) -> HashedWords:
        """rows: text, label. With nothing to learn from, every score is 0.5; null texts have no words."""
        from pyspark.ml.classification import LogisticRegression

        rows = rows.withColumn("y", (F.col("label") == "injection").cast("double"))
        n = rows.agg(F.count("*").alias("n"), F.sum("y").alias("pos")).first()
        if not n["n"]:
            self.fitted = None
            return self
        weights = F.when(F.col("y") > 0, n["n"] / (2.0 * max(n["pos"] or 0, 1))).otherwise(n["n"] / (2.0 * max(n["n"] - (n["pos"] or 0), 1)))
        self.fitted = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", maxIter=20, regParam=0.01).fit(self._vectors(rows.withColumn("w", weights)))
        return self

    def __call__(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.fitted is None:
            return rows.withColumn("score", F.lit(0.5))
        out = self.fitted.transform(self._vectors(rows.drop("features", "rawPrediction", "probability", "prediction")))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        """The fitted model at path; a model of nothing cannot be saved."""
        if self.fitted is None:
            raise ValueError("nothing was learned")
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> HashedWords:
        from pyspark.ml.classification import LogisticRegressionModel

        fitted = LogisticRegressionModel.load(path)
        return cls(fitted.numFeatures, fitted)
