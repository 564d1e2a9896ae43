"""Continuous parts: the inbox, hourly counts with a watermark, rate limits, the crawl state and append sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.telemetry import lru_hits
from ..sources.readers import inbox_texts, read_snapshot, with_sidecars, write_snapshot


def inbox(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """A stream of new files of the inbox; with an archive folder, files move there once they are processed."""
    reader = spark.readStream.schema(schemas.BINARY_FILE).format("binaryFile").option("pathGlobFilter", "*.{pdf,txt,docx,PDF,TXT,DOCX}")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def run_inbox(files: DataFrame, sidecars: Callable[[], DataFrame], index: Callable[[DataFrame], None], reject: Callable[[DataFrame], None], checkpoint: str, once: bool = False, seconds: int = 60) -> StreamingQuery:
    """Index each batch of inbox documents (text, title, source, category, doc_type, filename) and hand on those that
    can't be read or are too short. The checkpoint is the lock: one run at a time, no file twice."""

    def batch(found: DataFrame, _: int) -> None:
        texts = inbox_texts(found).persist()
        index(with_sidecars(texts, sidecars()))
        reject(texts.where(F.col("error").isNotNull() | (F.length(F.trim(F.coalesce("text", F.lit("")))) < 100)).select("path", "error"))
        texts.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def hourly_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "2 hours") -> DataFrame:
    """(hour, key, n) by tumbling hours; rows later than `late` are dropped and closed hours leave the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), key, "n")


def over_limit(events: DataFrame, per_hour: int, key: str = "user_id", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """(hour, key, n) of keys with more requests in an hour than allowed."""
    return hourly_counts(events, ts, key, late).where(F.col("n") > per_hour)


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Counters by key for the update or complete mode."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def cache_stream(requests: DataFrame, entries: int = 200, shard: str = "shard", key: str = "key", order: str = "seq") -> DataFrame:
    """(shard, seq, hit): an LRU cache for each shard of a stream of requests, its keys kept as state."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order)
        hits = lru_hits(held + rows[key].tolist(), entries)[len(held) :]
        kept = list(dict.fromkeys(reversed(held + rows[key].tolist())))[:entries][::-1]
        state.update((kept,))
        yield pd.DataFrame({"shard": [name[0]] * len(rows), "seq": rows[order].tolist(), "hit": hits})

    kind = requests.schema[shard].dataType.simpleString()
    return requests.groupBy(shard).applyInPandasWithState(step, f"shard {kind}, seq long, hit boolean", "keys array<string>", "append", "NoTimeout")


def run_crawl_state(pages: DataFrame, root: str, emit: Callable[[DataFrame], None], checkpoint: str, now: Callable[[], str], order: str | None = None, whole: bool = False) -> StreamingQuery:
    """Keep the state (url, hash, ...) of a stream of pages (url, html, title, file) as snapshots and emit new and
    changed pages only. Of several versions of a page in a batch the last by `order` counts, or the last that
    arrived. With `whole`, each batch is a whole crawl, and pages that it lacks leave the state."""
    from ..operators.crawl import diff, merge_index, removed

    def batch(found: DataFrame, _: int) -> None:
        spark = found.sparkSession
        place = F.struct(F.col(order), F.monotonically_increasing_id()) if order else F.monotonically_increasing_id()
        numbered = found.select("url", F.struct("html", "title", "file").alias("p"), place.alias("place_"))
        latest = numbered.groupBy("url").agg(F.max_by("p", "place_").alias("p")).select("url", "p.*").persist()
        state = read_snapshot(spark, root, schemas.STATE)
        if whole:
            state = state.join(removed(state, latest).select("url"), "url", "left_anti")
        status = diff(latest, state).where("status <> 'unchanged'")
        fresh = latest.join(status, "url").persist()
        emit(fresh)
        rows = fresh.select("url", "hash", F.lit(now()).alias("last_crawled"), "title", "file", F.lit(True).alias("changed"))
        write_snapshot(merge_index(state.withColumn("changed", F.lit(False)), rows), root)
        fresh.unpersist()
        latest.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log of JSON lines, exactly once by the checkpoint."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


__all__ = ["append_stream", "cache_stream", "hourly_counts", "inbox", "over_limit", "run_crawl_state", "run_inbox", "running_counts"]
