"""Change feeds as streams: snapshots kept up to date per micro-batch, and a live recency index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corvane.operators import changes


def follow(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a stream of file signatures (path, content_hash, seen_at; a null hash is a deletion) to a snapshot.

    Of a batch's rows for one path the last counts. `read` gives the snapshot (path, content_hash) and `write`
    stores the next one; a batch that is run again gives the same snapshot, so a restart does no harm.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content_hash", "seen_at").alias("content_hash"))
        now = changes.upsert(read(), last, ["path"]).filter("content_hash is not null")
        write(now, number)

    out = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def recency(stream: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """(window, path, last): each path's latest touch per window of event time, late rows within `late` included."""
    touched = stream.withWatermark("ts", late)
    return touched.groupBy(F.window("ts", window), "path").agg(F.max("ts").alias("last")).select("window", "path", "last")
