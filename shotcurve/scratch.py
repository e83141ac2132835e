"""A folder all executors can reach, for checkpoints and intermediate tables."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, else one below the
    warehouse, which executors share as well."""
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get(WAREHOUSE).rstrip("/")
    local = warehouse.startswith(("file:", "/")) and "://" not in warehouse.removeprefix("file://")
    if local and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors do not share {warehouse}; set {SETTING} to a folder they all reach")
    return f"{warehouse}/scratch"


def shared_folder(spark: SparkSession, name: str) -> str:
    """New path below the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_root(spark)}/shotcurve-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as parquet into the shared folder and read again: cuts
    the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the tables made by stored() that df reads; nothing may read them later."""
    jvm, root = df.sparkSession.sparkContext._jvm, shared_root(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("shotcurve-") and path.getParent().getName() == root.rsplit("/", 1)[-1]:
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside it, the shuffle files of a query go when the query ends, not when the driver
    happens to collect garbage: for chains of stored tables, which read them no more."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept when executors are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
