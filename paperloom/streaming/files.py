"""Streams of page files and of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.graphs import shared_folder
from paperloom.sources import pdf

BINARY = "path string, modificationTime timestamp, length long, content binary"
#: State on the executors' disks, with a bound of memory for all partitions of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "512",
}


def read(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder that have a PDF header, as they come."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.where(F.instr(F.substring(F.col("content"), 1, 4096).cast("string"), "%PDF-") > 0).select("path", "content")


def extract_to(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Page texts of a stream of files, as Parquet by batch: a batch that is run again replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        pdf.page_text(pdf.text_runs(df)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events, value) of sessions parted by a gap; events later than the watermark are dropped in a stream."""
    if events.isStreaming:  # watermarks need an instant, not a local time
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")


def whole(result: DataFrame) -> DataFrame:
    """The rows of an aggregated stream at its end.

    Executors write the result of each batch as Parquet in the shared folder, and the last one is read: no row passes
    the driver.
    """
    spark, folder, numbers = result.sparkSession, f"{shared_folder(result.sparkSession)}/stream-{uuid.uuid4().hex}", []

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        numbers.append(number)

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        result.writeStream.foreachBatch(batch).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(result.schema).parquet(f"{folder}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], result.schema)
