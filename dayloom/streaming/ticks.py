"""A derived view worked out again at every tick of a clock that is given, not read.

The ticks are a stream of moments at an even distance (Spark's rate source by micro-batch), each a batch of one row; at each the view of
that moment is written as the rows of its tick, so a batch that is tried again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(spark: SparkSession, first: datetime, every: timedelta) -> DataFrame:
    """A stream of ``at``: ``first`` (in UTC), and then one moment a batch."""
    start = first.replace(tzinfo=timezone.utc)
    step = round(every.total_seconds() * 1000)
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("startTimestamp", round(start.timestamp() * 1000)).option("advanceMillisPerBatch", step).load()
    return stream.select(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz")).alias("at"))


def recompute(moments: DataFrame, view: Callable[[datetime], DataFrame], path: str, checkpoint: str, times: int | None = None, every: str = "0 seconds"):
    """Writes ``view(moment)`` at every tick to ``path``, with ``at``; stops by itself after so many ``times``.

    ``every`` is the pace in real time (of a live view as the ticks', of a replay none).
    """
    state: dict = {}

    def step(batch: DataFrame, n: int) -> None:
        if times is None or n < times:
            for (at,) in batch.select("at").collect():  # one row
                rows = view(at).withColumns({"at": F.lit(at).cast("timestamp_ntz"), "tick": F.lit(n)})
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tick").parquet(path)
        if times is not None and n + 1 >= times:
            state["done"] = True

    query = moments.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    if times is not None:
        while not state.get("done") and query.isActive:
            query.awaitTermination(0.1)
        failed = query.exception()
        query.stop()
        if failed is not None:
            raise failed
    return query
