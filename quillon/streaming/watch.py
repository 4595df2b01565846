"""Continuous operation: changes as a stream, bursts as sessions, incremental refresh by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.operators import manifest


def bursts(events: DataFrame, key: str, ts: str, quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """Runs of events of a key without a pause of ``quiet``: first and last time and count. On a stream ``late`` is the watermark.

    A burst is complete once it has been quiet, which is what a trailing debounce waits for.
    """
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.col(key), F.session_window(ts, quiet).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events"))
    return out.select(key, "first", "last", "events")


def changes(spark: SparkSession, folder: str, schema: StructType | str, per_batch: int = 1000) -> DataFrame:
    """A stream of rows from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def refreshing(stream: DataFrame, checkpoint: str, current: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], order: str | None = None) -> StreamingQuery:
    """For every micro-batch of ``(path, hash, …)`` rows: replace what changed in ``current()`` and publish the result.

    ``order`` is a column that grows with a path's versions; of several in a batch the last counts (without one, that of the greatest hash). A row whose ``hash`` is null says
    that its path is gone. Batches run one after the other, so that changes during a refresh wait for the next; an unchanged batch publishes nothing.
    """
    def apply(batch: DataFrame, number: int) -> None:
        now = current()
        last = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), order or "hash").alias("v")).select("path", "v.*")
        newest = last.where("hash is not null")
        touched = now.join(last.select("path"), "path", "left_semi")
        diff = manifest.diff(touched.select("path", "hash"), newest.select("path", "hash"))
        if diff.where("status <> 'unchanged'").isEmpty():
            return
        publish(manifest.rebuilt(now, diff, newest.select(*now.columns)), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
