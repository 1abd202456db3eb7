"""Keeping an index fresh: a stream whose every batch lists the trees and indexes what changed.

Spark's file stream doesn't give a file again that is rewritten in place, so the stream is a clock (the rate source)
and each batch compares a listing with the stored times. The trigger's interval is the debounce: changes within one
interval are taken together. Batches may run again after a failure; an update is a replacement, so that is harmless.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmine.plans.store import Store
from scrollmine.sources import files as sources

log = logging.getLogger(__name__)


def debounce(events: DataFrame, gap: str, keys: list[str], time_col: str = "ts") -> DataFrame:
    """(keys, session_start, session_end, n_events): runs of events of which each follows within `gap`.

    On a stream, give events a watermark first; a session is then final once the watermark has passed it.
    """
    window = F.session_window(time_col, gap)
    grouped = events.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n_events"), F.min(time_col).alias("session_start"), F.max(time_col).alias("session_end"))
    return grouped.select(*keys, "session_start", "session_end", "n_events")


def pending(spark: SparkSession, store: Store, roots: list[str], skip: list[str], suffix: str = ".md") -> DataFrame:
    """The listing of changed files whose path contains none of the `skip` texts."""
    listing = sources.list_tree(spark, roots, suffix=suffix)
    for text in skip:
        listing = listing.filter(~F.col("file_path").contains(text))
    return sources.changed_files(listing, store.files())


def index_changes(store: Store, roots: list[str], skip: list[str], embedder=None) -> int:
    """Index the changed files once; returns how many there were. Errors of single files are logged and stop nothing."""
    changed = pending(store.spark, store, roots, skip).persist()
    try:
        count = changed.count()
        if count:
            for r in store.replace_read(roots, changed).collect():
                log.warning("%s: %s", r["file_path"], r["error"])
            if embedder is not None:
                store.embed(embedder)
        return count
    finally:
        changed.unpersist()


def watch(store: Store, roots: list[str], skip: list[str] = (), debounce_ms: int = 1500, checkpoint: str | None = None, embedder=None):
    """Start the stream and return its query. An error in a batch is logged and the next batch tries again."""

    def batch(_: DataFrame, number: int) -> None:
        try:
            count = index_changes(store, roots, list(skip), embedder)
            if count:
                log.info("batch %d: %d files", number, count)
        except Exception:  # noqa: BLE001  the watcher goes on
            log.exception("batch %d failed", number)

    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    writer = clock.writeStream.foreachBatch(batch).trigger(processingTime=f"{debounce_ms} milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
