"""Fact and summary files: reading, cataloguing, writing."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotcurve import fixed_values as fv
from shotcurve.schemas import EVAL_RESULTS

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}

_SUMMARY_TYPES = {
    "threshold_shots": "int", "num_trials": "int", "total_input_tokens": "bigint",
    "total_output_tokens": "bigint", "total_latency_ms": "bigint",
    "improvement_rate": "double", "learning_curve_auc": "double", "score_variance": "double",
    "resilience_score": "double", "collapse_pattern": "string", "run_id": "string",
    "task_id": "string", "category": "string", "model_name": "string",
    "example_selection": "string",
}


def conform_results(df: DataFrame, rescued: str | None = None) -> DataFrame:
    """Typed fact columns: trial_id 1 and selection fixed where absent or NULL,
    other absent columns NULL, unknown columns dropped.

    A value that is not of its column's type (a word or a fraction where whole
    numbers belong) fails the job; with rescued, the name of one more column, it
    becomes NULL and stands there as a map from column to text (NULL where all is
    well)."""
    cols, lost = [], []
    for f in EVAL_RESULTS:
        raw = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        c = raw.try_cast(f.dataType)
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            # whole numbers may be written as 1.0
            number = raw.try_cast("double")
            c = F.coalesce(c if dict(df.dtypes).get(f.name) != "string" else raw.try_cast("bigint").try_cast(f.dataType),
                           F.when(number == F.floor(number), number.try_cast(f.dataType)))
        if f.name in df.columns and not isinstance(f.dataType, T.StringType):
            bad = raw.isNotNull() & c.isNull()
            if rescued is None:
                c = F.when(bad, F.raise_error(F.concat(F.lit(f"unreadable {f.name}: "), raw.cast("string"))).cast(
                    f.dataType)).otherwise(c)
            else:
                lost.append(F.when(bad, F.struct(F.lit(f.name).alias("key"), raw.cast("string").alias("value"))))
        if f.name == "trial_id":
            c = F.when(raw.isNull(), F.lit(1)).otherwise(c)
        if f.name == "example_selection":
            c = F.coalesce(c, F.lit(fv.DEFAULT_SELECTION))
        cols.append(c.alias(f.name))
    if rescued is not None:
        found = F.filter(F.array(*lost), lambda e: e.isNotNull()) if lost else None
        cols.append((F.when(F.size(found) > 0, F.map_from_entries(found)) if lost
                     else F.lit(None).cast("map<string, string>")).alias(rescued))
    return df.select(*cols)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVAL_RESULTS)


def read_eval_results(spark: SparkSession, path: str, format: str = "parquet",
                      rescued: str | None = None) -> DataFrame:
    """Fact rows from parquet (the native format, pruned and pushed down) or CSV.
    A missing path or an empty file gives an empty typed table. Unreadable CSV
    values fail the job, or go to the column rescued (see conform_results)."""
    try:
        if format == "parquet":
            raw = spark.read.schema(EVAL_RESULTS).parquet(path)
            return raw.fillna({"trial_id": 1, "example_selection": fv.DEFAULT_SELECTION}).select(
                *EVAL_RESULTS.names)
        raw = spark.read.options(**_CSV).csv(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return _empty(spark)
    return conform_results(raw if raw.columns else _empty(spark), rescued)


def _summary_type(name: str) -> str | None:
    if name.startswith("score_") and name.endswith("shot") or name.startswith("pass_"):
        return "double"
    return _SUMMARY_TYPES.get(name)


def header_index(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """CSV files below paths by their header line; files without one are left out.

    One scan finds the first line of every file, wherever its blocks are read."""
    lines = spark.read.text(paths).select(
        "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    heads = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    index = {}
    for r in heads.orderBy("file").collect():  # the caller's files, one short line each
        if r["header"]:
            index.setdefault(r["header"], []).append(r["file"])
    return index


def read_summaries(spark: SparkSession, paths: list[str], format: str = "csv") -> DataFrame:
    """Summaries whose column sets differ, combined by name; absent columns are NULL.

    CSV files are grouped by their header and each group is one scan; parquet
    schemas are merged in a single read. A value that is not of its column's type
    fails the job."""
    if format == "parquet":
        return spark.read.option("mergeSchema", True).parquet(*paths)
    combined = None
    for files in header_index(spark, paths).values():
        raw = spark.read.options(**_CSV).csv(files)
        cols = []
        for c in raw.columns:
            kind = _summary_type(c)
            value = F.col(f"`{c}`")
            if kind and kind != "string":
                typed = value.try_cast("double").try_cast(kind) if kind != "double" else value.try_cast(kind)
                value = F.when(value.isNotNull() & typed.isNull(), F.raise_error(
                    F.concat(F.lit(f"unreadable {c}: "), value)).cast(kind)).otherwise(typed)
            cols.append(value.alias(c))
        frame = raw.select(*cols)
        combined = frame if combined is None else combined.unionByName(frame, allowMissingColumns=True)
    if combined is None:
        raise ValueError("no summary with a header")
    return combined


_CATALOGUE = "run_id string, raw_path string, summary_path string"


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Names that a file-system glob finds; nothing below them is visited."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().getName() for f in found or []]


def run_catalog(spark: SparkSession, results_dir: str) -> DataFrame:
    """Runs of a results directory and its demo subdirectory: run_id, raw_path
    and summary_path (NULL when there is none), newest name first, the
    directory itself before demo. A run may be one CSV file or a directory of
    part files of that name.

    Four globs list the two directories; other subdirectories and the runs
    themselves are not opened."""
    root, rows = results_dir.rstrip("/"), []
    for folder in (root, f"{root}/demo"):
        summaries = set(_names(spark, f"{folder}/summary_*.csv"))
        runs = sorted((n[len("raw_results_"):-len(".csv")] for n in _names(spark, f"{folder}/raw_results_*.csv")), reverse=True)
        rows += [(run, f"{folder}/raw_results_{run}.csv",
                  f"{folder}/summary_{run}.csv" if f"summary_{run}.csv" in summaries else None) for run in runs]
    return spark.createDataFrame(rows, _CATALOGUE)


def load_run(spark: SparkSession, run) -> tuple[DataFrame, DataFrame | None]:
    """Facts and summary (None without one) of a row of run_catalog."""
    facts = read_eval_results(spark, run["raw_path"], "csv")
    return facts, read_summaries(spark, [run["summary_path"]]) if run["summary_path"] else None


def write_results(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write facts or summaries partitioned by run_id, replacing only the runs
    at hand. Rebalancing splits a run that holds most rows into several files
    and joins small ones."""
    (df.hint("rebalance", "run_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
     .format(format).options(**(_CSV if format == "csv" else {})).save(path))


def write_run(df: DataFrame, results_dir: str, run_id: str, kind: str = "raw_results") -> str:
    """Write one run as CSV under the name run_catalog looks for; returns the path."""
    path = f"{results_dir.rstrip('/')}/{kind}_{run_id}.csv"
    (df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path))
    return path
