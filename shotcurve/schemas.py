"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

EVAL_RESULTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("shot_count", T.IntegerType()),
    T.StructField("input", T.StringType()),
    T.StructField("expected_output", T.StringType()),
    T.StructField("actual_output", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("scoring_method", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("trial_id", T.IntegerType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("example_selection", T.StringType()),
])

SUMMARY_KEYS = ["run_id", "task_id", "category", "model_name", "example_selection"]

# a task's id is unique within its pack; tables without packs have no pack_id
TASK_KEY = ["pack_id", "task_id"]

EVAL_KEY = ["task_id", "model_name", "shot_count", "trial_id", "input_sha256",
            "example_selection"]

# expected_output is a VARIANT: text or a rubric object
_EXAMPLE = "struct<input: string, output: string>"
_CASE = ("struct<input: string, expected_output: variant, scoring_method: string,"
         " acceptable_variations: array<string>>")
TASK_JSON = (
    "task_id string, category string, description string, difficulty string,"
    f" examples array<{_EXAMPLE}>, test_cases array<{_CASE}>, version string,"
    f" measures array<string>, instruction string, distractors array<{_EXAMPLE}>,"
    " agency_config variant"
)
PACK_JSON = (
    "pack_id string, pack_name string, description string, version string,"
    f" categories array<string>, tasks array<struct<{TASK_JSON}>>"
)

EXAMPLES = "task_id string, pos int, input string, output string, is_distractor boolean"
