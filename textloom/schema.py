"""Row types, enumerations and constants of the corpus."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels, channels, special tokens, sizes and thresholds.
LABELS = ("benign", "injection")
CHANNELS = ("url_text", "pdf", "image", "email", "tool_result", "sms", "chat")
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
SEQ_LEN, WINDOW_CHARS, STRIDE_CHARS = 256, 900, 600
SPARSE_SOURCES = ("bipia-ctx",)
MIN_CHARS, MAX_CHARS = 3, 4000
VOCAB_SIZE, MIN_LANG_POS, MAX_WORD_CHARS = 20000, 30, 100
EVAL_PERCENT, FP_HARD_EVAL_PERCENT, SCORE_THRESHOLD = 18, 30, 0.5
FP_HARD_FLOOR, REAL_POSITIVE_FLOOR = 150, 500
SWEEP = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)

ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("text", "label", "source", "license", "lang", "channel")]
    + [T.StructField(c, T.BooleanType()) for c in ("is_translated", "is_synthetic", "weak_seed")]
    + [T.StructField(c, T.StringType()) for c in ("group", "notes")]
)
PREDICTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])
SUSPECT = T.StructType([T.StructField("id", T.StringType()), T.StructField("reason", T.StringType())])
TEACHER = T.StructType([T.StructField("hash", T.StringType()), T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType()), T.StructField("lang", T.StringType())])
