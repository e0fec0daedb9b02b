"""Structured Streaming: event-time counts, incremental ingest, and typed event streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.ingest import insert_ignore
from factloom.session import checkpoint_dir

#: Kinds of events that a streamed question sends (fixed values).
KINDS = ("plan", "tool_call", "tool_result", "reflection", "synthesis", "done", "error")
EVENT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.StringType())), T.StructField("trace_id", T.StringType()),
     T.StructField("iteration", T.IntegerType()), T.StructField("timestamp", T.DoubleType())]
)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's Parquet files as a file stream, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling event-time windows: keys, window_start, n, total. Rows later than ``late`` are dropped by a stream
    in append or update mode; a batch and complete mode keep all."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("_w.start").alias("window_start"), *keys, "n", "total")


def _shared_path(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def run_complete(stream: DataFrame, what: str) -> DataFrame:
    """Run a stream of aggregates over everything there is now and return its last complete result.

    State and result live in new folders of the shared checkpoint folder: each call runs the stream from its beginning.
    """
    spark = stream.sparkSession
    out, state = _shared_path(spark, what), _shared_path(spark, f"{what}-state")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest_new(stream: DataFrame, keys: Sequence[str], out: str, state: str) -> None:
    """Append the rows of each micro-batch whose key ``out`` does not have yet; run again, it adds nothing.

    A batch that is repeated after a failure finds its own rows there and adds none twice.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, _: int) -> None:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(out)
        there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
        target = spark.read.schema(schema).parquet(out) if there else None
        insert_ignore(target, batch, keys, nulls_distinct=False).write.mode("append").parquet(out)

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def ingested(stream: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The table after ingesting everything there is now."""
    spark = stream.sparkSession
    out = _shared_path(spark, what)
    ingest_new(stream, keys, out, _shared_path(spark, f"{what}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def parse_event_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of ``data: {json}`` lines; other lines, malformed JSON and unknown kinds are left out."""
    body = F.when(F.col(line).startswith("data: "), F.substring(F.col(line), 7, 1 << 30))
    rows = lines.select(F.from_json(body, EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return rows.where(F.col("type").isin(*KINDS))


def event_line(kind: Column, data: Column, trace_id: Column, iteration: Column, timestamp: Column) -> Column:
    """One event as a ``data:`` line followed by a blank one."""
    body = F.struct(kind.alias("type"), data.alias("data"), trace_id.alias("trace_id"), iteration.alias("iteration"), timestamp.alias("timestamp"))
    return F.concat(F.lit("data: "), F.to_json(body), F.lit("\n\n"))


def until_done(events: DataFrame) -> DataFrame:
    """Events of each trace up to its first ``done`` or ``error``, by timestamp."""
    last = events.where(F.col("type").isin("done", "error")).groupBy("trace_id").agg(F.min("timestamp").alias("_end"))
    return events.join(last, "trace_id", "left").where(F.col("_end").isNull() | (F.col("timestamp") <= F.col("_end"))).drop("_end")
