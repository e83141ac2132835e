"""Exactly-once ingestion of fact rows from a file stream.

The keys seen so far are the state of a streaming aggregation: a micro-batch is
dealt out by key and meets the state of its own keys only, in the state store, so
what a batch reads does not grow with the run. The batch's number is part of the
sink's layout, so a batch repeated after a failure replaces what it wrote before.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotcurve.operators.grid import with_eval_key
from shotcurve.operators.joins import one_per_key
from shotcurve.schemas import EVAL_KEY, EVAL_RESULTS

KEY = ["run_id", *EVAL_KEY]
BATCH = "ingest_batch"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_results_stream(spark: SparkSession, path: str, format: str = "parquet",
                        **options) -> DataFrame:
    return spark.readStream.schema(EVAL_RESULTS).format(format).options(**options).load(path)


def _new_rows(stream: DataFrame) -> DataFrame:
    """Rows of keys that appear for the first time, one per key: the first by its
    columns in name order, so the survivor does not depend on how rows arrived.

    The state of a key is the time of the batch that brought it and its row. In
    update mode a batch gives the keys it holds; a known one has an earlier time."""
    rows = with_eval_key(stream)
    rest = sorted(c for c in rows.columns if c not in KEY)
    seen = rows.withColumn("_now", F.current_timestamp()).groupBy(*KEY).agg(
        F.min("_now").alias("_first"), F.max("_now").alias("_last"),
        F.min(F.struct("_now", *rest)).alias("_row"))
    return seen.select(*[c if c in KEY else F.col(f"_row.{c}").alias(c) for c in rows.columns],
                       (F.col("_first") == F.col("_last")).alias("_new"))


def write_batch(rows: DataFrame, batch: int, sink: str) -> None:
    """Write the new rows of a batch; what an earlier attempt wrote is replaced."""
    (rows.filter("_new").drop("_new").withColumn(BATCH, F.lit(batch))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", BATCH).parquet(sink))


def append_new(batch: DataFrame, sink: str, number: int = -1) -> None:
    """Outside of a stream: append a batch's rows whose key the sink does not hold yet, one per
    key. The keys of the batch's runs are read."""
    rows = one_per_key(with_eval_key(batch), KEY)
    path = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(sink)
    if path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path):
        known = batch.sparkSession.read.parquet(sink).select(*KEY)
        known = known.join(batch.select("run_id").distinct(), "run_id", "left_semi")
        rows = rows.join(known, KEY, "left_anti")
    rows.withColumn(BATCH, F.lit(number)).write.mode("append").partitionBy("run_id", BATCH).parquet(sink)


def _with_store(spark: SparkSession, start) -> StreamingQuery:
    """Start a query whose state may outgrow memory; the session's own choice of a store is kept."""
    if spark.conf.get(STORE, None):
        return start()
    spark.conf.set(STORE, ROCKS)
    try:
        return start()
    finally:
        spark.conf.unset(STORE)


def ingest_results_stream(stream: DataFrame, sink: str, checkpoint: str,
                          watermark: str | None = None, event_time: str = "event_time",
                          **trigger) -> StreamingQuery:
    """Append a stream of fact rows to a parquet sink, one row per run and
    evaluation key.

    Default: keys and their rows stay in the state store of the checkpoint, so
    duplicates are dropped however far apart they arrive, nothing late is lost,
    and a batch repeated after a failure writes nothing twice; the sink is never
    read. With watermark (a delay such as '2 hours') state is dropped behind the
    watermark: duplicates farther apart than the delay stay, and rows behind it
    are lost."""
    trigger = trigger or {"availableNow": True}
    if watermark is None:
        return _with_store(stream.sparkSession, lambda: (
            _new_rows(stream).writeStream.outputMode("update")
            .foreachBatch(lambda rows, batch: write_batch(rows, batch, sink))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()))
    if event_time not in stream.columns:
        stream = stream.withColumn(event_time, F.to_timestamp("timestamp"))
    rows = with_eval_key(stream).withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(KEY)
    return _with_store(stream.sparkSession, lambda: (
        rows.writeStream.format("parquet").partitionBy("run_id")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger).start()))
