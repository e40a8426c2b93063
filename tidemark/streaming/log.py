"""Streams over arriving log chunks and metric samples."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes
from tidemark.operators.catalog import retention_plan
from tidemark.operators.snapshots import verification_sweep
from tidemark.operators.wal import wal_filter

SEGMENT = 16 << 20


def cut_chunks(chunks: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """(server, segno, start, len): chunks (server, lsn, len) cut at segment borders. Batch or stream; empty chunks go."""
    size = F.lit(segment_size)
    first, last = F.floor(F.col("lsn") / size), F.floor((F.col("lsn") + F.col("len") - 1) / size)
    c = chunks.filter("len > 0").withColumn("segno", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("lsn"), F.col("segno") * size)
    end = F.least(F.col("lsn") + F.col("len"), (F.col("segno") + 1) * size)
    return c.select("server", "segno", (begin - F.col("segno") * size).alias("start"), (end - begin).alias("len"))


def wal_ingest(chunks: DataFrame, segment_size: int = SEGMENT) -> DataFrame:
    """(server, segno, received, partial) of each segment, growing as chunks arrive; pieces that are sent again count once."""
    pieces = cut_chunks(chunks, segment_size).dropDuplicates(["server", "segno", "start", "len"])
    got = pieces.groupBy("server", "segno").agg(F.sum("len").alias("received"))
    return got.withColumn("partial", F.col("received") < segment_size)


def wal_position(chunks: DataFrame) -> DataFrame:
    """(server, lsn): where each server's log ends so far."""
    return chunks.groupBy("server").agg(F.max(F.col("lsn") + F.col("len")).alias("lsn"))


def resume_point(segments: DataFrame) -> DataFrame:
    """(server, segno) to go on with: the newest segment where it is partial, else the one after it."""
    newest = segments.groupBy("server").agg(F.max_by("partial", "segno").alias("partial"), F.max("segno").alias("segno"))
    return newest.select("server", (F.col("segno") + F.when(F.col("partial"), 0).otherwise(1)).alias("segno"))


def wal_stats_stream(records: DataFrame) -> DataFrame:
    """(rmgr, count, record_size, fpi_size, combined_size) over arriving records; shares of totals are for the reader of the table."""
    sizes = [F.sum(F.col("tot_len") - F.col("fpi_len")).alias("record_size"), F.sum("fpi_len").alias("fpi_size"), F.sum("tot_len").alias("combined_size")]
    return records.groupBy("rmgr").agg(F.count("*").alias("count"), *sizes)


def stats_fold(records: DataFrame, store: str, checkpoint: str, every: str | None = None):
    """Start a query that adds the statistics of arriving records, partial ones and no-ops left out, to a table under store, a version a
    batch. A batch that is run again writes the same version again."""

    def fold(batch: DataFrame, k: int) -> None:
        known = wal_stats_stream(wal_filter(batch))
        if k:
            known = known.unionByName(batch.sparkSession.read.parquet(f"{store}/version={k - 1}"))
        sums = [F.sum(c).alias(c) for c in ("count", "record_size", "fpi_size", "combined_size")]
        known.groupBy("rmgr").agg(*sums).write.mode("overwrite").parquet(f"{store}/version={k}")

    return on_each_batch(records, fold, checkpoint, every)


def stats_so_far(spark: SparkSession, store: str) -> DataFrame:
    return newest_version(spark, store)


def newest_version(spark: SparkSession, store: str) -> DataFrame:
    every = spark.read.parquet(store)
    return every.filter(F.col("version") == every.agg(F.max("version")).scalar()).drop("version")


def on_each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a query that runs a policy (retention, verification, folding of blocks) on each batch; without every, on what is there."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def compact_events(events: DataFrame) -> DataFrame:
    """Block events of which only those are left that a summary of these and of any further events needs: of each block its last
    mark, of each fork the last limit that took effect."""
    marks = events.filter((F.col("phase") == 1) & F.col("blk").isNotNull()).groupBy(*changes.KEY, "blk").agg(F.max("lsn").alias("lsn"))
    marks = marks.select(*changes.KEY, "lsn", F.lit(1).alias("phase"), F.lit(None).cast("long").alias("limit_block"), "blk")
    limits = changes.last_limits(events).select(*changes.KEY, "lsn", F.lit(0).alias("phase"), F.col("limit_block").cast("long").alias("limit_block"), F.lit(None).cast("long").alias("blk"))
    return marks.unionByName(limits)


def brt_stream(events: DataFrame, store: str, checkpoint: str, every: str | None = None):
    """Start a query that folds arriving block events (key, lsn, phase, limit_block, blk) into a table under store, a version a batch. A
    batch that is run again writes the same version again; events may arrive in any order. Versions before the last are not needed."""

    def fold(batch: DataFrame, k: int) -> None:
        known = batch.select(*changes.KEY, "lsn", "phase", "limit_block", "blk")
        if k:
            known = known.unionByName(batch.sparkSession.read.parquet(f"{store}/version={k - 1}"))
        compact_events(known).write.mode("overwrite").parquet(f"{store}/version={k}")

    return on_each_batch(events, fold, checkpoint, every)


def brt_so_far(spark: SparkSession, store: str) -> DataFrame:
    """Modified blocks (key, blk) of the newest version under store."""
    return changes.summarize(newest_version(spark, store))


SERIES = "name string, labels string, times array<timestamp>, samples array<string>"


def metric_series_stream(samples: DataFrame, most: int = 100) -> DataFrame:
    """(name, labels, times, samples) of each series that a batch adds to: its newest most samples by time, oldest first, of arriving
    samples (name, labels, ts, value). labels is the map as JSON text, keys in order. State is most samples a series; of equal times
    the one with the larger value as text counts as newer. Mode update."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    s = samples.select("name", text.alias("labels"), "ts", F.col("value").cast("string").alias("value")).filter("name IS NOT NULL AND ts IS NOT NULL")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, values = state.get if state.exists else ([], [])
        rows = list(zip(times, values, strict=True))
        for b in batches:
            rows += zip((b["ts"].astype("int64") // (1000 if b["ts"].dtype == "datetime64[ns]" else 1)).tolist(), b["value"], strict=True)
            rows = sorted(rows, key=lambda x: (x[0], str(x[1])))[-most:]
        state.update(([t for t, _ in rows], [v for _, v in rows]))
        yield pd.DataFrame({"name": [key[0]], "labels": [key[1]], "times": [[pd.Timestamp(t, unit="us") for t, _ in rows]], "samples": [[v for _, v in rows]]})

    return s.groupBy("name", "labels").applyInPandasWithState(update, SERIES, "times array<bigint>, samples array<string>", "update", "NoTimeout")


def retention_runs(catalog: Callable[[], DataFrame], delete: Callable[[DataFrame], None], today: Callable[[], dt.date] = dt.date.today, **policy) -> Callable[[DataFrame, int], None]:
    """For on_each_batch: each batch reads the catalog anew, plans by the retention policy as of today, and hands the plan
    (server, label) to delete, unless it is empty."""

    def run(_: DataFrame, __: int) -> None:
        plan = retention_plan(catalog(), today(), **policy)
        if not plan.isEmpty():
            delete(plan)

    return run


def verification_runs(catalog: Callable[[], DataFrame], statuses: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For on_each_batch: each batch reads the catalog anew, has statuses (server, label, status of each file) taken of its valid snapshots, and hands
    the catalog to publish, with those invalid of which a file isn't ok; only where that changes any."""

    def run(_: DataFrame, __: int) -> None:
        now = catalog()
        swept = verification_sweep(now, statuses(now.filter("valid")))
        if not swept.filter("NOT valid").join(now.filter("valid").select("server", "label"), ["server", "label"], "left_semi").isEmpty():
            publish(swept)

    return run


def validity_runs(catalog: Callable[[], DataFrame], report: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For on_each_batch: each batch hands (server, n_valid, n_invalid, newest_valid) of the catalog as it then is to report."""

    def run(_: DataFrame, __: int) -> None:
        report(catalog().groupBy("server").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"), F.max(F.when(F.col("valid"), F.col("label"))).alias("newest_valid")))

    return run


def ticks(spark: SparkSession) -> DataFrame:
    """A stream of one row a second, whose batches set off policy runs on the trigger of on_each_batch."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load()
