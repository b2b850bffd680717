"""The two counters of the batch engine that also make sense on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Uses per class and window of (ts, event_type); rows later than the watermark are left out. events may be a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_once(stream: DataFrame, path: str, *keys: str) -> DataFrame:
    """All that the stream has now. Each batch writes the rows that it changed to a folder of its own under path, so a batch that is run again
    replaces what it wrote; of each key the newest row counts. A later call with the same path goes on where this one ended."""

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    try:
        rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(f"{path}/rows")
    except Exception as e:  # no batch yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in stream.columns])
