"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

LONG = "The quick brown fox, über allem; jumps over 13 lazy dogs! " * 3000


def documents(spark, texts=None):
    """(doc_id, text, lang, source) with columns of names that operators use themselves."""
    if texts is None:
        texts = [None, "", "   ", "one", "one", LONG, "Ünïcödé wörds ünd mehr", "*** 123 ***", "a b c d e f", "日本語 テキスト 😀"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id here", "en", "s1")] if texts else []
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    for name in ("n_words", "score", "size", "n_tokens", "fp", "items", "key", "position"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return documents(spark).limit(0)
