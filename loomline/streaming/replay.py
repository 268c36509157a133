"""A file stream that processes what is there and stops; its checkpoint is the resume set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.runtime import work_dir

_OUT = "hour timestamp, event_type string, n long, cents long, batch long"


def hourly_events(spark: SparkSession, events_dir: str, name: str, late: str = "30 days", pattern: str = "events*.parquet", base: str | None = None) -> DataFrame:
    """Counts and sums of events per hour and type, kept as state by the stream and read back as a table.

    Each batch writes the hours that it changed; the latest row of an hour counts. Events that
    come later than ``late`` after the newest one of the batches before are left out. A second run
    over the same ``name`` goes on with new files from the state where the first one stopped; with
    ``base``, also in another application.
    """
    base = f"{base or work_dir(spark)}/stream-{name}"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(events_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(events_dir)
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.bround(F.col("value") * 100).cast("long").alias("cents"))
    hours = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))

    def keep(part: DataFrame, number: int) -> None:
        changed = part.select(F.col("w.start").alias("hour"), "event_type", "n", "cents", F.lit(number).cast("long").alias("batch"))
        changed.write.mode("overwrite").parquet(f"{base}/out/number={number}")  # a repeated batch replaces itself

    hours.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(keep).start().awaitTermination()
    parts = spark.read.schema(_OUT).parquet(f"{base}/out")
    last = F.max_by(F.struct("n", "cents"), "batch").alias("x")
    return parts.groupBy("hour", "event_type").agg(last).select("hour", "event_type", "x.n", "x.cents")
