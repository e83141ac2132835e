"""Joins that neither multiply rows nor wait for one large task."""

from pyspark.sql import Column, DataFrame, functions as F

from shotcurve.schemas import EVAL_KEY, TASK_KEY
from shotcurve.scratch import stored

# rows of a task from which its join is split
PART_ROWS = 100_000


def shared(keys: list[str], left: DataFrame, right: DataFrame) -> list[str]:
    """keys without pack_id where one side does not tell packs apart."""
    return [k for k in keys if k != "pack_id" or "pack_id" in left.columns and "pack_id" in right.columns]


def task_key(left: DataFrame, right: DataFrame) -> list[str]:
    return shared(TASK_KEY, left, right)


def eval_key(left: DataFrame, right: DataFrame) -> list[str]:
    return shared(["pack_id", *EVAL_KEY], left, right)


def one_per_key(df: DataFrame, keys: list[str], order: list[Column] | None = None,
                refuse: str | None = None) -> DataFrame:
    """One row per key: the first by order, then by its columns in name order, NULLs first.

    The choice is an aggregate with map-side combine. refuse, the name of the
    table, fails the job on keys with several different rows instead."""
    rest = sorted(c for c in df.columns if c not in keys)
    marks = [c.alias(f"_{i}") for i, c in enumerate(order or [])]
    row = F.struct(*marks, *[F.col(f"`{c}`") for c in rest])
    if refuse is None:
        first = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    else:
        both = df.groupBy(*keys).agg(F.min(row).alias("_row"), F.max(row).alias("_last"))
        told = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        first = both.filter(F.when(~F.col("_row").eqNullSafe(F.col("_last")), F.raise_error(
            F.concat(F.lit(f"several rows in {refuse} for: "), told)).cast("boolean")).otherwise(F.lit(True)))
    return first.select(*[c if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def join_one(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column] | None = None,
             refuse: str | None = None) -> DataFrame:
    """Left join that keeps the number of rows, whatever is repeated on the right."""
    return left.join(one_per_key(right, keys, order, refuse), keys, "left")


def by_sorting(right: DataFrame) -> DataFrame:
    """The right side of a join whose rows grow with the grid or its cases.

    Spark takes exploded rows for no larger than the file they come from, so it would
    send a whole grid of answers through the driver to broadcast it."""
    return right.hint("merge")


def by_count(right: DataFrame, name: str, few: int = PART_ROWS // 2) -> DataFrame:
    """right, stored, for an inner join: few rows go to the large table's tasks, so that its
    texts stay where they are; more are sorted with it."""
    right = stored(right, name)
    return F.broadcast(right) if right.count() <= few else by_sorting(right)


def task_parts(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The tasks of more than part_rows rows, and the number of parts they are split into.

    At most one task per part_rows rows is in this table, and it is stored, so that its
    size decides how it is joined."""
    keys = [k for k in TASK_KEY if k in rows.columns]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_rows)
    return stored(counted.select(*keys, F.ceil(F.col("n") / part_rows).cast("int").alias("_parts")), "task-parts")


def join_by_task(left: DataFrame, right: DataFrame, parts: DataFrame) -> DataFrame:
    """Left join of many rows to the one short row of their task.

    The rows of a large task are split by a hash into as many parts as task_parts found
    for it, and its right row is repeated once per part; other tasks are one part."""
    keys = task_key(left, right)
    parts = parts.groupBy(*keys).agg(F.max("_parts").alias("_parts"))
    mark = [c for c in ("pos", "input", "shot_count", "model_name", "trial_id", "example_selection") if c in left.columns]
    spread = left.join(parts, keys, "left").withColumn("_part", F.coalesce(
        F.pmod(F.xxhash64(*mark), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    repeated = right.join(parts, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return spread.join(repeated, [*keys, "_part"], "left").drop("_part")
