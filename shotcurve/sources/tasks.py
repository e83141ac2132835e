"""Task packs and task files (JSON) as tables."""

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.judge import expected_to_text
from shotcurve.schemas import PACK_JSON, TASK_JSON
from shotcurve.scratch import stored


class TaskTables(NamedTuple):
    packs: DataFrame
    tasks: DataFrame
    examples: DataFrame
    test_cases: DataFrame

    def parsed(self) -> "TaskTables":
        """The same tables, stored: JSON is parsed once, however often they are read."""
        return TaskTables(*(stored(t, name.replace("_", "-")) for t, name in zip(self, self._fields)))


def _json_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(
        F.col("value").alias("json"),
        F.regexp_replace("_metadata.file_path", "^file:(//)?", "").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"))


def _missing(fields: list[str], source: str = "") -> Column:
    # names of absent required fields
    return F.filter(
        F.array(*[F.when(F.col(source + f).isNull(), F.lit(f)) for f in fields]),
        lambda f: f.isNotNull())


def _with_required(df: DataFrame, fields: list[str], what: str, strict: bool,
                   source: str = "") -> DataFrame:
    missing = _missing(fields, source)
    if not strict:
        return df.filter(F.size(missing) == 0)
    return df.filter(F.when(F.size(missing) > 0, F.raise_error(F.concat(
        F.lit(f"{what}: required field missing: "), F.array_join(missing, ", "))
    ).cast("boolean")).otherwise(F.lit(True)))


def _parse(json, schema: str, strict: bool) -> Column:
    return F.from_json(json, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def _parsed_columns(json, schema: str, strict: bool) -> Column:
    # As a generator the JSON is parsed once; as a plain struct, filters on its
    # fields would each parse it again.
    return F.inline(F.array(_parse(json, schema, strict)))


_TEXT_CASES = "test_cases array<struct<expected_output: string>>"


def parse_task_packs(raw: DataFrame, json: str = "json", strict: bool = True) -> TaskTables:
    """Pack JSON texts -> packs, tasks, examples and test_cases.

    strict fails on unreadable JSON, missing required fields and unknown
    measures; otherwise such packs are left out."""
    texts = _parse(json, f"tasks array<struct<{_TEXT_CASES}>>", strict)["tasks"]
    parsed = raw.select(texts.alias("texts"), _parsed_columns(json, PACK_JSON, strict))
    parsed = _with_required(parsed, fv.PACK_REQUIRED, "task pack", strict)
    packs = parsed.select("pack_id", "pack_name", "description", "version", "categories",
                          F.size("tasks").alias("task_count"))
    tasks = parsed.select("pack_id", "texts", F.posexplode("tasks").alias("task_pos", "task"))
    tasks = tasks.select(
        "pack_id", "task_pos", "task.*",
        F.get(F.col("texts"), F.col("task_pos"))["test_cases"].alias("text_cases"))
    return TaskTables(packs, *_task_tables(tasks, ["pack_id"], strict))


def _task_tables(tasks: DataFrame, ids: list[str], strict: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    tasks = _with_required(tasks, fv.TASK_REQUIRED, "task", strict)
    table = with_task_defaults(tasks.select(
        *ids, "task_pos", "task_id", "category", "description", "difficulty",
        "version", "measures", "instruction", F.to_json("agency_config").alias("agency_config")))
    if strict:
        table = reject_invalid_tasks(table)

    def rows(field: str, is_distractor: bool) -> DataFrame:
        return tasks.select(*ids, "task_pos", "task_id", F.posexplode(field).alias("pos", "e")).select(
            *ids, "task_pos", "task_id", "pos", "e.input", "e.output",
            F.lit(is_distractor).alias("is_distractor"))

    examples = rows("examples", False).unionByName(rows("distractors", True))
    cases = tasks.select(*ids, "task_pos", "task_id", "category", "text_cases",
                         F.posexplode("test_cases").alias("pos", "c"))
    kind = F.schema_of_variant("c.expected_output")
    cases = cases.select(
        *ids, "task_pos", "task_id", "category", "pos", "c.input",
        F.get(F.col("text_cases"), F.col("pos"))["expected_output"].alias("text"),
        F.coalesce(kind != "STRING", F.lit(False)).alias("expected_is_rubric"),
        "c.scoring_method", "c.acceptable_variations")
    cases = cases.withColumn("expected_output", expected_to_text("text", "expected_is_rubric")).drop("text")
    return table, examples, cases


def with_task_defaults(tasks: DataFrame) -> DataFrame:
    """Defaults of optional task fields. An explicit empty measures list stays."""
    return tasks.withColumns({
        "version": F.coalesce("version", F.lit(fv.DEFAULT_TASK_VERSION)),
        "measures": F.coalesce("measures", F.array(*map(F.lit, fv.DEFAULT_MEASURES))),
        "instruction": F.coalesce("instruction", F.lit(""))})


def _unknown_measures() -> Column:
    known = F.array(*map(F.lit, fv.MEASURES))
    return F.array_except(F.coalesce("measures", F.array().cast("array<string>")), known)


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Violations: task_id and problem, one row per missing field or unknown measure."""
    flat = [f for f in fv.TASK_REQUIRED if f in tasks.columns]
    missing = [F.when(F.col(f).isNull(), F.lit(f"missing field: {f}")) for f in flat]
    problems = F.concat(
        F.filter(F.array(*missing), lambda p: p.isNotNull()),
        F.transform(_unknown_measures(), lambda m: F.concat(F.lit("invalid measure: "), m)))
    return tasks.select("task_id", F.explode(problems).alias("problem"))


def reject_invalid_tasks(tasks: DataFrame) -> DataFrame:
    """The tasks themselves; the job fails on the first unknown measure."""
    unknown = _unknown_measures()
    return tasks.filter(F.when(F.size(unknown) > 0, F.raise_error(F.concat(
        F.lit("invalid measure: "), F.array_join(unknown, ", "))).cast("boolean")).otherwise(F.lit(True)))


def read_task_packs(spark: SparkSession, path: str, strict: bool = True) -> TaskTables:
    """One pack file, or every *.json pack file of a directory."""
    return parse_task_packs(_json_files(spark, path), "json", strict)


def parse_task_files(raw: DataFrame) -> TaskTables:
    """Single-task JSON texts (columns json, file_name) -> task tables. Pack
    files, by name or for want of required fields, are skipped."""
    raw = raw.filter(~F.col("file_name").startswith("task_pack_"))
    tasks = raw.select(
        "file_name", F.lit(0).alias("task_pos"),
        _parse("json", _TEXT_CASES, True)["test_cases"].alias("text_cases"),
        _parsed_columns("json", TASK_JSON, True))
    tasks = _with_required(tasks, fv.TASK_REQUIRED, "task", strict=False)
    table, examples, cases = _task_tables(tasks, ["file_name"], strict=True)
    no_packs = table.limit(0).select(F.lit("").alias("pack_id"))
    return TaskTables(no_packs, table.orderBy("file_name"), examples, cases)


def read_task_files(spark: SparkSession, directory: str) -> TaskTables:
    """Single-task files of a directory, ordered by file_name. A missing
    directory fails."""
    return parse_task_files(_json_files(spark, directory))


_CATALOGUE = "pack_id string, pack_name string, description string, file_path string, task_count int"


def list_task_packs(spark: SparkSession, directory: str) -> DataFrame:
    """Catalogue of task_pack_*.json files by path. Unreadable files and files
    without pack_id are skipped; a missing directory gives an empty table."""
    try:
        raw = _json_files(spark, directory, "task_pack_*.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CATALOGUE)
    return catalogue_of(raw).orderBy("file_path")


def catalogue_of(raw: DataFrame) -> DataFrame:
    """Catalogue rows of pack JSON texts (columns json, file_path)."""
    head = "pack_id string, pack_name string, description string, tasks array<variant>"
    return (
        raw.select("file_path", _parsed_columns("json", head, False))
        .filter(F.col("pack_id").isNotNull())
        .select("pack_id", F.coalesce("pack_name", "pack_id").alias("pack_name"),
                F.coalesce("description", F.lit("")).alias("description"), "file_path",
                F.coalesce(F.size("tasks"), F.lit(0)).alias("task_count")))


def tasks_needing_judge(test_cases: DataFrame) -> DataFrame:
    """Task ids with an llm_judge test case, once each, in file order."""
    return (
        test_cases.filter(F.col("scoring_method") == "llm_judge")
        .groupBy("task_id").agg(F.min(F.struct("task_pos", "pos")).alias("first_seen"))
        .orderBy("first_seen", "task_id").select("task_id"))
