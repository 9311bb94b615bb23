"""Fixed schemas of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order are the interface.
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "path", "reference", "language")])
RESULT_COLUMNS = (
    "id", "path", "reference", "hypothesis", "wer", "cer", "duration_s", "processed_s", "orig_sr", "rms_db", "mel_mean", "mel_std",
    "speech_ratio", "preprocess_s", "infer_s", "model_load_s", "language", "ref_language", "worker", "error",
)
TEXT_COLUMNS = ("id", "path", "reference", "hypothesis", "language", "ref_language", "worker", "error")
RESULT = T.StructType([T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.DoubleType()) for c in RESULT_COLUMNS])
