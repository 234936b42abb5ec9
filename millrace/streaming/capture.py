"""Capture of files as they arrive: each micro-batch adds to the latest snapshot and becomes the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.sources.snapshots import Catalog


def merged(base: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """source_key, text: what arrived replaces the base's documents of equal keys; of several arrivals the greatest text stays."""
    last = arrived.groupBy("source_key").agg(F.max("text").alias("text"))
    if base is None:
        return last
    return base.select("source_key", "text").join(last.select("source_key"), "source_key", "left_anti").unionByName(last)


def capture_stream(catalog: Catalog, name: str, path: str, checkpoint: str, schema: str = "source_key string, text string", once: bool = True) -> StreamingQuery:
    """JSON files under path into snapshots of a corpus. A batch that is run again gives the same snapshot."""

    def each(batch: DataFrame, _: int) -> None:
        base = catalog.latest(name)
        catalog.capture(name, merged(catalog.open(name, base) if base else None, batch), base)

    writer = catalog.spark.readStream.schema(schema).json(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_by_key(df: DataFrame, at: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy("source_key").orderBy(F.desc(at)))).where("_n = 1").drop("_n")
