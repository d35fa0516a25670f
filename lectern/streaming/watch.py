"""Watching a folder: a file is ready when its size stands still and it has been quiet for a while.

A file source never emits a changed file again, so a rate stream triggers listings instead, and the seen
table, keyed by path and modification time, holds what the last listing saw and what was handled.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.stages import load, save
from ..sources.books import list_books

QUIET_SECONDS = 5
log = logging.getLogger("lectern.watch")


def first_stable(polls: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """(key, at): the first poll at which a key's size is that of its poll before."""
    w = Window.partitionBy(key).orderBy(order)
    same = polls.withColumn("__last", F.lag(size).over(w)).where(F.col("__last") == F.col(size))
    return same.groupBy(key).agg(F.min(order).alias("at"))


def decide(listing: DataFrame, seen: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Files to process, and the new seen table (path, mtime, length, handled).

    listing and seen: path, mtime, length; seen also handled. A file is ready if the last listing had it at
    the same size and mtime is more than QUIET_SECONDS before now; once handled it comes again only when
    its mtime changes.
    """
    before = seen.select("path", F.col("mtime").alias("m0"), F.col("length").alias("l0"), "handled")
    rows = listing.join(before, "path", "left")
    handled = F.coalesce(F.col("handled") & (F.col("m0") == F.col("mtime")), F.lit(False))
    quiet = F.unix_seconds(now) - F.unix_seconds("mtime") > QUIET_SECONDS
    ready = F.coalesce(F.col("l0") == F.col("length"), F.lit(False)) & quiet & ~handled
    rows = rows.withColumns({"ready": ready, "was": handled})
    return rows.where("ready").select("path", "mtime", "length"), rows.select("path", "mtime", "length", (F.col("was") | F.col("ready")).alias("handled"))


def watch(spark: SparkSession, folder: str, seen_path: str, checkpoint: str, process: Callable[[DataFrame], None], interval: str = "30 seconds") -> StreamingQuery:
    """A streaming query that lists folder at every trigger and hands ready files to process.

    An error in process is kept to its batch: the files count as handled until they change.
    """
    schema = "path string, mtime timestamp, length long, handled boolean"

    def step(_: DataFrame, batch: int) -> None:
        seen = load(spark, seen_path)
        seen = spark.createDataFrame([], schema) if seen is None else seen
        listing = list_books(spark, folder).select("path", F.col("modificationTime").alias("mtime"), "length")
        todo, state = decide(listing, seen, F.lit(datetime.now(UTC)))  # one instant for both
        todo = todo.checkpoint() if spark.sparkContext.getCheckpointDir() else todo.persist()  # what is ready by this listing
        todo.count()
        save(state, seen_path)
        if todo.take(1):
            try:
                process(todo)
            except Exception as e:  # noqa: BLE001  the next files must not wait for this one's error
                log.error("batch %d: %s", batch, e)

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(step).start()
