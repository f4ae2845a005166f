"""Events written out as files of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(events: DataFrame, path: str, day: str | None = None, rows: int = 100_000) -> None:
    """One JSON object a line, in files of at most ``rows`` lines; with ``day`` (a timestamp column) in a folder for each
    date. Files are added, so a stream's batches can be written one after the other."""
    writer = events.withColumn("date", F.to_date(day)).write.partitionBy("date") if day else events.write
    writer.mode("append").option("maxRecordsPerFile", rows).json(path)
