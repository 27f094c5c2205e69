"""Streaming twins of the run-log operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def windowed_state(spark: SparkSession, path: str, *, watermark: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Counts and latest values by type and tumbling window of an event stream, once it has run through all there is.

    The stream reads files as they come, keeps state up to the watermark, and writes the whole state after each batch;
    the last writing is returned. Its checkpoint and output are in the shared folder.
    """
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # a pattern, as a stream can't take the path of a single file
    path_pattern = f"{path[:-1]}[{path[-1]}]"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path_pattern).withColumn("ts", F.col("ts").cast("timestamp"))
    state = events.withWatermark("ts", watermark).groupBy("event_type", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most"), F.max_by("value", "event_id").alias("latest"))
    flat = state.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("since"), "n", "most", "latest")
    query = flat.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out")
