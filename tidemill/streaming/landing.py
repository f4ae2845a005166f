"""Landing files as a stream: each file once, upserted into a versioned table, watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.transforms import dedup
from tidemill.sources.versioned import VersionedTable


def ingest(spark: SparkSession, folder: str, schema: T.StructType, target: str, keys: list[str], order_by: str, checkpoint: str, fmt: str = "parquet"):
    """Take in all files that are there and stop. A batch's place is stored only after its upsert; a batch
    that runs again upserts the same rows. A row older than the target's of its key (by ``order_by``, null being oldest)
    is left out, in whatever batch it comes."""
    stream = spark.readStream.schema(schema).format(fmt).load(folder)

    def load(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        table, rows = VersionedTable(spark, target), batch.transform(dedup(keys, order_by))
        if table.exists():
            have = table.read().select(*keys, F.col(order_by).alias("_have"))
            newer = F.col("_have").isNull() | (F.col(order_by) >= F.col("_have"))
            rows = rows.join(have, keys, "left").where(newer).drop("_have")
        table.upsert(rows, keys)

    query = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
