"""Log segments as a data source, `spark.read.format("wal_records")`, one partition a segment, and as a stream of arriving segments.

The source knows from a segment's name which timeline and positions it holds. Filters on timeline and lsn that Spark pushes down leave out
segments by name, before any is opened; a task opens the segments after its own only where its last record goes on there. Files
are opened by their URI, with Arrow's file systems (local, hdfs, s3, gs); stores beyond those go through wal_files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources import wal_bytes as B
from tidemark.sources.files import WAL, PARTIAL, base_name, file_class, file_name, unpacked

NAME = re.compile(r"^[0-9A-Fa-f]{24}$")
#: Endings under which the segment after one is looked for.
ENDINGS = ("", ".gz", ".zstd", ".zst", ".lz4", ".bz2")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


@dataclass
class SegmentFile(InputPartition):
    path: str
    name: str


@dataclass
class Wanted:
    """Bounds that pushed filters set: lsn within [low, high], and timelines (None: all)."""

    low: int = 0
    high: int = (1 << 63) - 1
    timelines: set[int] | None = None

    def take(self, f: Filter) -> None:
        column = ".".join(getattr(f, "attribute", ()))
        if column == "lsn" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        if column == "lsn" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        if column == "timeline" and isinstance(f, (EqualTo, In)):
            named = set(f.value) if isinstance(f, In) else {f.value}
            self.timelines = named if self.timelines is None else self.timelines & named

    def has(self, name: str, size: int) -> bool:
        """May a segment of that name and size hold a record that is wanted?"""
        start = (int(name[8:16], 16) * ((1 << 32) // size) + int(name[16:], 16)) * size
        return start <= self.high and start + size > self.low and (self.timelines is None or int(name[:8], 16) in self.timelines)


class WalReader(DataSourceReader):
    def __init__(self, path: str, keep_raw: bool):
        self.path, self.keep_raw, self.wanted = path, keep_raw, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f  # segments are left out as a whole; rows are for Spark to filter

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        files = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found = []
        for f in files:
            name = f.base_name.split(".")[0]
            if f.type == fs.FileType.File and NAME.match(name) and not f.base_name.endswith((".partial", ".history", ".tar")):
                found.append(SegmentFile(f.path, name))
        found.sort(key=lambda s: (s.name, s.path))
        if not found:
            return []
        size = self.segment(store, found[0].path).size
        return [s for s in found if self.wanted.has(s.name, size)]

    def segment(self, store, path: str) -> B.Segment:
        with store.open_input_file(path) as f:
            return B.Segment(unpacked(PurePosixPath(path).name, f.read())[1])

    def after(self, store, path: str, name: str) -> dict | None:
        """What the start of the segment of that name, in path's folder, holds of a record before it."""
        from pyarrow import fs

        for ending in ENDINGS:
            at = str(PurePosixPath(path).with_name(name + ending))
            if store.get_file_info(at).type == fs.FileType.File:
                return next((r for r in B.fragments(name, int(name[:8], 16), self.segment(store, at)) if r["kind"] == "head"), None)
        return None

    def read(self, partition: SegmentFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no segment is wanted
            return
        store, _ = _store(self.path)
        segment, name = self.segment(store, partition.path), partition.name
        yield from B.whole_records(name, int(name[:8], 16), segment, self.keep_raw)
        for tail in B.fragments(name, int(name[:8], 16), segment):
            if tail["kind"] == "tail":
                parts, number, left = [], segment.base // segment.size, tail["length"] - len(tail["bytes"])
                while left > 0:
                    number += 1
                    per = (1 << 32) // segment.size
                    head = self.after(store, partition.path, f"{name[:8]}{number // per:08X}{number % per:08X}")
                    if head is None or head["length"] != left:
                        break
                    parts.append(head)
                    left -= len(head["bytes"])
                yield B.finished_record(tail, parts, self.keep_raw)


class WalSource(DataSource):
    """Option path: a folder or a file of segments; keepRaw: true for the records' own bytes."""

    @classmethod
    def name(cls) -> str:
        return "wal_records"

    def schema(self) -> str:
        return B.RECORD_DDL

    def reader(self, schema) -> WalReader:
        return WalReader(self.options["path"], self.options.get("keepraw", self.options.get("keepRaw", "false")).lower() == "true")


def wal_records(spark: SparkSession, path: str, keep_raw: bool = False) -> DataFrame:
    """Rows like those of read_wal_records for the segments at path, of which filters on lsn and timeline open only those that they need.

    A record belongs to the segment where it starts. What a segment's start holds of a record before it gives no row; a record whose
    rest is missing is partial. Switches the pushing of filters into Python sources on in the session.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WalSource)
    return B.with_names(spark.read.format("wal_records").option("keepRaw", str(keep_raw).lower()).load(path), keep_raw)


def _kept(rows: list[dict]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, B.FRAGMENT) as w:
        w.write_table(pa.Table.from_pylist(rows, schema=B.FRAGMENT))
    return sink.getvalue().to_pybytes()


def _finish(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Fragments of a timeline wait in the state until what they need has come; each record that is then whole, or whose rest turns out
    to belong to another record, goes out."""
    rows = pa.ipc.open_stream(state.get[0]).read_all().to_pylist() if state.exists else []
    rows += [r for b in batches for r in pa.Table.from_pandas(b, schema=B.FRAGMENT, preserve_index=False).to_pylist()]
    heads = {r["segment"]: r for r in rows if r["kind"] == "head"}
    out, waiting = [], []
    for tail in (r for r in rows if r["kind"] == "tail"):
        raw, left, used, at = tail["bytes"], tail["length"] - len(tail["bytes"]), [], tail["segment"] + 1
        while left > 0 and at in heads and heads[at]["length"] == left:
            raw, left = raw + heads[at]["bytes"], left - len(heads[at]["bytes"])
            used.append(at)
            at += 1
        if left > 0 and at not in heads:
            waiting.append(tail)
            continue
        out.append(tail | {"bytes": raw})
        for k in used if left <= 0 else []:
            del heads[k]
    state.update((_kept([*heads.values(), *waiting]),))
    yield pa.Table.from_pylist(out, schema=B.FRAGMENT).to_pandas()


def stream_wal_records(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of rows like those of read_wal_records, of segments as they arrive in folder (plain or compressed; partial ones are
    left alone). A record that a segment's end cuts waits in keyed state, one key a timeline, until the segments with its rest have come, in
    whatever order. The state holds the cut parts only: at most two for each segment that has no neighbour yet. Output mode append."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    kind = file_class(F.col("path"))
    plain = files.filter((kind.bitwiseAND(F.lit(WAL)) != 0) & (kind.bitwiseAND(F.lit(PARTIAL)) == 0)).select("path", "content").mapInPandas(B.open_files, "path string, name string, content binary")
    plain = plain.select(base_name(file_name(F.col("name"))).alias("file"), "content")
    whole = plain.mapInArrow(B.whole_rows(), B.RECORD_DDL)
    cut = plain.mapInArrow(B.fragment_rows, B.FRAGMENT_DDL)
    done = cut.groupBy("timeline").applyInPandasWithState(_finish, B.FRAGMENT_DDL, "waiting binary", "append", "NoTimeout")
    done = done.withColumn("parts", F.lit(None).cast("array<struct<segment:bigint,length:bigint,bytes:binary>>"))
    return B.with_names(whole.unionByName(done.mapInArrow(B.joined_rows(), B.RECORD_DDL)))
