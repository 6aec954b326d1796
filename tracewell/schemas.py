"""Schemas, label sets and other values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, orders and limits that must match for equal results.
SPLITS = ("train", "dev", "calibration", "test")
FAMILIES = ("kgw", "unigram", "unbiased", "synthid")
KEY_SLOTS = ("a", "b")
ATTACKS = ("paraphrase", "translation_roundtrip", "copy_edit", "truncation")
WEAK_ATTACKS = ("paraphrase", "translation_roundtrip")
DETERMINISTIC_ATTACKS = ("copy_edit", "truncation")
PILOT_SLOTS = ("train", "train", "train", "train", "dev", "dev", "calibration", "test")
ROUTES = ("generic", "registered", "gap")
LABELS = (
    "known_scheme_known_key",
    "known_scheme_unknown_key",
    "suspected_unknown_scheme",
    "uncertain",
    "none",
)
ACCEPTED_LABELS = LABELS[:3]
MINIMUM_DETECTOR_TOKENS = {"kgw": 2, "unigram": 1, "unbiased": 6, "synthid": 5}
SCHEME_CODES = {"kgw": 0, "unigram": 1, "unbiased": 2, "synthid": 3}
FAILURE_COLUMNS = (
    "recipe_id",
    "kind",
    "split",
    "source",
    "language",
    "watermark_family",
    "key_id",
    "attack_id",
    "failure_type",
    "failure_message",
)
WINDOW_LENGTHS = (256, 512, 1024)
STRIDE_FRACTION = 0.25
CANDIDATE_QUANTILE = 0.95
MERGE_GAP = 32
MINIMUM_COVERAGE = 0.98
SEED = 20260815

SPAN = T.StructType(
    [T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]
)

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("used_ram", T.DoubleType()),
        T.StructField("free_disk", T.DoubleType()),
    ]
)
