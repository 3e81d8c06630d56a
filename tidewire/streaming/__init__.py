"""The ingest half as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewire.shared import shared_path


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def late_dropped(stream: DataFrame, ts: str, hours: int, now) -> DataFrame:
    """Rows not older than ``hours`` at ``now``; the watermark bounds state, the filter drops rows."""
    return stream.withWatermark(ts, f"{hours} hours").where(F.col(ts) >= now - F.expr(f"interval {hours} hours"))


def first_seen(stream: DataFrame, key: str, ts: str, hours: int) -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark([key])


def hourly_health(stream: DataFrame, key: str, ts: str, hours: int = 48) -> DataFrame:
    """Items per key and hour with the newest time."""
    grouped = stream.withWatermark(ts, f"{hours} hours").groupBy(F.window(ts, "1 hour").alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest")).select(key, F.col("w.start").alias("hour"), "n", "newest")


def run_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run what is there to the end into a Parquet folder; the checkpoint makes an interrupted run resume."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, label: str, step) -> DataFrame:
    """Run ``step(batch, epoch)`` on every micro-batch and keep its rows in a folder per epoch.

    A replayed epoch overwrites its own folder, so a resumed run leaves every row once.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, label)

    def sink(batch: DataFrame, epoch: int) -> None:
        step(batch, epoch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def against_store(store: str, step, ts: str | None = None, hours: int | None = None):
    """A batch step ``step(new, stored)`` that also keeps each batch's rows for the ones after it.

    Rows are kept in a folder per epoch; a replayed epoch sees the epochs before it and overwrites its own. With an
    event time ``ts`` they are kept by its day, and a batch reads only days within ``hours`` before its oldest row;
    what is older has expired and its folders may be removed. Rows without a time never match later ones.
    """

    def run(batch: DataFrame, epoch: int) -> DataFrame:
        spark, columns = batch.sparkSession, batch.columns
        day = F.to_date(ts) if ts else F.lit("2000-01-01").cast("date")
        batch.withColumn("_day", day).write.mode("overwrite").partitionBy("_day").parquet(f"{store}/epoch={epoch}")
        schema = T.StructType([*batch.schema.fields]).add("epoch", "long").add("_day", "date")
        kept = spark.read.schema(schema).option("basePath", store).parquet(store)
        new, old = (kept.where(F.col("epoch") == epoch), kept.where(F.col("epoch") < epoch))
        if ts:
            oldest = new.agg(F.min(ts)).first()[0]
            since = F.lit(oldest).cast("timestamp") - F.expr(f"interval {hours} hours")
            old = old.where((F.col("_day") >= F.to_date(since)) & (F.col(ts) >= since))
        return step(new.select(*columns), old.select(*columns))

    return run
