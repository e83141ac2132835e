"""Prompts, responses and replies stored by evaluation key, so that they meet without a shuffle.

Each table is dealt out once, when it is written, into buckets by the task and the text of
the key and sorted inside them. Tables with the same key and number of buckets are then
joined, reduced to one row per key and compared with each other bucket by bucket: the texts
of the grid move once and not once per step. All cells of a text stand side by side, in the
shuffle and in the files, so that its copies are compressed to little more than one text;
dealt out by the whole key, they part, and the more so the more buckets and rows there are.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shotcurve.schemas import EVAL_KEY
from shotcurve.scratch import shared_folder

PREFIX = "shotcurve_keyed_"
# the part of the key that says which text a row has
TEXT_KEY = ["pack_id", "task_id", "input_sha256"]
# whether a join deals out anew what is dealt out by a part of its keys
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


# cells of a grid that one task sorts in memory
PART_CELLS = 200_000


def grid_partitions(cases: DataFrame, cells_per_case: int, part_cells: int = PART_CELLS) -> int:
    """Partitions of a keyed_grid: the session's, or as many as keep them at part_cells cells."""
    least = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-cases.count() * cells_per_case // part_cells))


@contextmanager
def by_text(spark: SparkSession) -> Iterator[None]:
    """Inside it, joins by the whole key take tables dealt out by its task and text as they
    are. What is planned after it does not, so a result is to be stored or written in it."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


class KeyedTables:
    """Tables bucketed by the task and text of one key, as a context: they are dropped when it ends.
    Inside it, joins by the whole key take tables as they are stored; what is planned after it
    is not, so a result is to be stored or written in it.

    buckets: the same for all tables of a run, by default the session's number of shuffle
    partitions. packs: the key has pack_id, too. With path, tables are kept in that folder
    and not deleted."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, packs: bool = False, path: str | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys = ["pack_id", *EVAL_KEY] if packs else list(EVAL_KEY)
        self.by = [c for c in TEXT_KEY if c in self.keys]
        # sorted in this order, the cells of a text stay side by side
        self.order = self.by + [c for c in self.keys if c not in self.by]
        self.names, self.setting = [], None

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """df written by task and text and read again; its rows move once."""
        table = f"{PREFIX}{name}_{uuid.uuid4().hex}"
        folder = f"{self.path.rstrip('/')}/{name}" if self.path else shared_folder(self.spark, name)
        (df.repartition(self.buckets, *self.by).write.format("parquet").mode("overwrite")
         .bucketBy(self.buckets, *self.by).sortBy(*self.order).option("path", folder).saveAsTable(table))
        self.names.append(table)
        return self.spark.table(table)

    def __enter__(self):
        self.setting = self.spark.conf.get(ALL_KEYS)
        self.spark.conf.set(ALL_KEYS, "false")
        return self

    def __exit__(self, *error):
        self.spark.conf.set(ALL_KEYS, self.setting)
        # the files of these external tables stay until the session ends, or for good below path
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def exchanges_of(df: DataFrame, column: str = "input_sha256") -> int:
    """Number of shuffles by a key that has the column in the plan of df."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and column in line for line in plan.splitlines())
