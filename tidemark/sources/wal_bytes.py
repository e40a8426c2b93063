"""Decoding of binary log segments: files to rows of records.

A segment is pages of a header and payload; records follow one another in the payload, aligned to eight bytes, over page and segment
borders. Each segment is one task: its page headers are cut off, the chain of lengths is walked, and then all records of the segment
take each step of their headers together, in numpy. A record that the segment's end cuts goes on as a fragment, and so does what a
segment's start holds of a record before it; the length of the first tells which segments hold the rest, so an equi-join
brings the parts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import WAL, base_name, expand_archives, file_class, file_name, open_files, read_compressed  # noqa: F401

#: The magic of each version's pages, and the names of the resource managers in order of their ids.
MAGIC = {0xD106: 13, 0xD10D: 14, 0xD110: 15, 0xD113: 16, 0xD116: 17, 0xD118: 18, 0xD121: 19}
MANAGERS = ["XLOG", "Transaction", "Storage", "CLOG", "Database", "Tablespace", "MultiXact", "RelMap", "Standby", "Heap2", "Heap", "Btree", "Hash", "Gin", "Gist", "Sequence", "SPGist", "BRIN", "CommitTs", "ReplicationOrigin", "Generic", "LogicalMessage"]
FORKS = ["main", "fsm", "vm", "init"]
LONG_HEADER, SHORT_HEADER, RECORD_HEADER = 40, 24, 24
#: Microseconds from 1970 to 2000, where the log's clock starts.
EPOCH = 946_684_800_000_000

_BLOCK = pa.struct([("spc", pa.int64()), ("db", pa.int64()), ("rel", pa.int64()), ("fork", pa.int32()), ("blk", pa.int64()), ("has_image", pa.bool_()), ("bimg_len", pa.int32())])
_REL = pa.struct([("spc", pa.int64()), ("db", pa.int64()), ("rel", pa.int64())])
_RECORD = pa.schema([
    ("file", pa.string()), ("timeline", pa.int64()), ("version", pa.int32()), ("lsn", pa.int64()), ("prev_lsn", pa.int64()), ("tot_len", pa.int64()), ("xid", pa.int64()),
    ("toplevel_xid", pa.int64()), ("info", pa.int32()), ("rmid", pa.int32()), ("crc", pa.int64()), ("xact_us", pa.int64()), ("subxacts", pa.list_(pa.int64())),
    ("dropped_rels", pa.list_(_REL)), ("delete_xmax", pa.int64()), ("partial", pa.bool_()), ("blocks", pa.list_(_BLOCK)), ("main_data", pa.binary()), ("raw", pa.binary()),
])
FRAGMENT = pa.schema([("file", pa.string()), ("timeline", pa.int64()), ("version", pa.int32()), ("segment", pa.int64()), ("kind", pa.string()), ("lsn", pa.int64()), ("length", pa.int64()), ("room", pa.int64()), ("bytes", pa.binary())])
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}


def _sql(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_sql(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{f.name}:{_sql(f.type)}' for f in kind)}>"
    return _SQL[kind]


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_sql(f.type)}" for f in schema)


RECORD_DDL, FRAGMENT_DDL = _ddl(_RECORD), _ddl(FRAGMENT)


def _u(stream: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Little-endian unsigned numbers at the places."""
    return sum(stream[at + k].astype(np.int64) << (8 * k) for k in range(width))


class Segment:
    """A segment's payload without page headers: what continues an earlier record, and the whole records that start in it."""

    def __init__(self, raw: bytes):
        if len(raw) < LONG_HEADER:
            raise ValueError("a log segment holds one long page header at least")
        head = np.frombuffer(raw, np.uint8, LONG_HEADER).astype(np.int64)
        number = lambda at, width: int(_u(head, np.array([at]), width)[0])
        self.version = MAGIC.get(number(0, 2))
        if self.version is None:
            raise ValueError(f"unknown log magic {number(0, 2):#06x}")
        self.base, self.size, self.page = number(8, 8), number(32, 4), number(36, 4)
        if not number(2, 2) & 2 or self.page < LONG_HEADER or self.size % self.page:
            raise ValueError("no long page header")
        data = np.frombuffer(raw, np.uint8)
        data = np.concatenate((data, np.zeros(-len(data) % self.page, np.uint8))).reshape(-1, self.page)
        # pages that an earlier use of the file left behind carry another address: the log ends before them
        address = data[:, 8:16].copy().view("<i8")[:, 0]
        fits = address == self.base + np.arange(len(data)) * self.page
        data = data[: len(fits) if fits.all() else int(np.argmin(fits))]
        self.stream = np.concatenate((data[0, LONG_HEADER:], data[1:, SHORT_HEADER:].reshape(-1)))
        self.room = self.size - LONG_HEADER - (self.size // self.page - 1) * SHORT_HEADER
        left = number(16, 4) if number(2, 2) & 1 else 0
        self.continued = left
        self.start = min(-(-left // 8) * 8, len(self.stream))
        self.full = len(self.stream) == self.room

    def lsn(self, at: np.ndarray | int) -> np.ndarray | int:
        """The log position of a place in the payload."""
        room, at = self.page - SHORT_HEADER, at + LONG_HEADER - SHORT_HEADER
        return self.base + at // room * self.page + at % room + SHORT_HEADER

    def chain(self) -> tuple[np.ndarray, int | None, int]:
        """Places of the whole records, and place and length of a record that the end cuts (None, 0: there is none)."""
        stream = self.stream[: len(self.stream) // 8 * 8]
        lengths, at, out = memoryview(stream.tobytes()).cast("I"), self.start, []
        while at < len(stream):
            n = lengths[at >> 2]
            if n < RECORD_HEADER:  # the log ends here
                return np.array(out, np.int64), None, 0
            if at + n > len(stream):
                return np.array(out, np.int64), at if self.full else None, n
            out.append(at)
            at += (n + 7) & ~7
        return np.array(out, np.int64), None, 0


def decode(stream: np.ndarray, at: np.ndarray, version: int, keep_raw: bool = False) -> dict[str, pa.Array]:
    """Columns of the records at the places of a payload; each header step is taken by all records that have it. raw, a record's own
    bytes, only where it is asked for."""
    s = np.concatenate((stream, np.zeros(64, np.uint8)))
    n, size = len(at), len(stream)
    total, info, rmid = _u(s, at, 4), s[at + 16].astype(np.int32), s[at + 17].astype(np.int32)
    end, cur = at + total, at + RECORD_HEADER
    data = np.zeros(n, np.int64)  # bytes of images, block data and main data, which follow all headers
    top, main_len = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    last = np.zeros((n, 3), np.int64)
    live = np.flatnonzero(end - cur > data)
    refs: list[np.ndarray] = []
    while len(live):
        c = cur[live]
        tag = s[np.minimum(c, size)].astype(np.int64)
        for code, width in ((255, 1), (254, 4)):
            i = live[tag == code]
            main_len[i] = _u(s, np.minimum(cur[i] + 1, size), width)
            cur[i] += 1 + width
            data[i] = end[i] - cur[i]  # main data is the last header
        i = live[tag == 253]
        cur[i] += 3
        i = live[tag == 252]
        top[i] = _u(s, np.minimum(cur[i] + 1, size), 4)
        cur[i] += 5
        i = live[tag <= 32]
        if len(i):
            b = np.minimum(cur[i], size)
            flags, p = s[b + 1].astype(np.int64), b + 4
            length = _u(s, b + 2, 2)
            image = flags & 0x10 > 0
            bimg = np.where(image, _u(s, p, 2), 0)
            how = np.where(image, s[np.minimum(p + 4, size)], 0).astype(np.int64)
            packed = how & (0x02 if version < 15 else 0x1C) > 0
            p = p + np.where(image, 5, 0) + np.where(image & packed & (how & 1 > 0), 2, 0)
            own = flags & 0x80 == 0
            q = np.minimum(p, size)
            last[i] = np.where(own[:, None], np.stack([_u(s, q + 4 * k, 4) for k in range(3)], 1), last[i])
            p = np.minimum(p + np.where(own, 12, 0), size)
            refs.append(np.column_stack((i, last[i], flags & 15, _u(s, p, 4), image, bimg)))
            data[i] += length + bimg
            cur[i] = p + 4
        data[live[(tag > 32) & (tag < 252)]] = np.iinfo(np.int64).max // 2  # no header: what was read so far stays
        live = live[end[live] - cur[live] > data[live]]
    ref = np.concatenate([np.empty((0, 8), np.int64), *refs])
    ref = ref[np.argsort(ref[:, 0], kind="stable")]
    first = np.searchsorted(ref[:, 0], np.arange(n + 1)).astype(np.int32)
    columns = [pa.array(ref[:, k + 1], f.type) if f.name != "has_image" else pa.array(ref[:, k + 1] > 0) for k, f in enumerate(_BLOCK)]
    blocks = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(columns, fields=list(_BLOCK)))

    main_len = np.clip(main_len, 0, end - at - RECORD_HEADER)
    main = end - main_len
    raw = stream.tobytes()
    xact = (rmid == 1) & np.isin(info & 0x70, (0x00, 0x20, 0x30, 0x40)) & (main_len >= 8)
    when = sum(s[np.minimum(main, size) + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8)).view(np.int64) + EPOCH
    subs: list[list[int] | None] = [None] * n
    rels: list[list[dict[str, int]] | None] = [None] * n
    for k in np.flatnonzero(xact & (info & 0x80 > 0) & (main_len >= 12)).tolist():
        words = np.frombuffer(raw, "<u4", main_len[k] // 4, main[k]).astype(np.int64)
        p = 3 + 2 * int(words[2] & 1)  # time, flags, and ids of the database where flagged
        if words[2] & 2 and p < len(words):
            subs[k] = words[p + 1 : p + 1 + words[p]].tolist()
            p += 1 + int(words[p])
        if words[2] & 4 and p < len(words):
            ids = words[p + 1 : p + 1 + 3 * words[p]]
            rels[k] = [dict(zip(("spc", "db", "rel"), x, strict=True)) for x in ids[: len(ids) // 3 * 3].reshape(-1, 3).tolist()]
    deleted = (rmid == 10) & (info & 0x70 == 0x10) & (main_len >= 4)
    return {
        "prev_lsn": pa.array(_u(s, at + 8, 8)), "tot_len": pa.array(total), "xid": pa.array(_u(s, at + 4, 4)), "toplevel_xid": pa.array(top, mask=top < 0), "info": pa.array(info), "rmid": pa.array(rmid),
        "crc": pa.array(_u(s, at + 20, 4)), "xact_us": pa.array(when, mask=~xact), "subxacts": pa.array(subs, pa.list_(pa.int64())), "dropped_rels": pa.array(rels, pa.list_(_REL)),
        "delete_xmax": pa.array(_u(s, np.minimum(main, size), 4), mask=~deleted), "partial": pa.array(np.zeros(n, bool)), "blocks": blocks,
        "main_data": pa.array([raw[a:b] for a, b in zip(main.tolist(), end.tolist(), strict=True)], pa.binary()),
    } | ({"raw": pa.array([raw[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)], pa.binary())} if keep_raw else {})


def _rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _RECORD], schema=_RECORD)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Segment]]:
    for batch in batches:
        for file, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
            yield file, int(file[:8], 16), Segment(content.as_buffer().to_pybytes())


def whole_records(file: str, timeline: int, seg: Segment, keep_raw: bool) -> Iterator[pa.RecordBatch]:
    """The records that lie within a segment."""
    at, _, _ = seg.chain()
    for i in range(0, len(at), 20_000):
        part = at[i : i + 20_000]
        stop = int(part[-1] + _u(seg.stream, part[-1:], 4)[0])
        cols = decode(seg.stream[part[0] : stop], part - part[0], seg.version, keep_raw)
        cols |= {"file": pa.array([file] * len(part)), "timeline": pa.array([timeline] * len(part)), "version": pa.array([seg.version] * len(part)), "lsn": pa.array(seg.lsn(part))}
        yield _rows(len(part), cols)


def fragments(file: str, timeline: int, seg: Segment) -> list[dict]:
    """What a segment's start holds of a record before it (head), and what its end cuts (tail)."""
    common, rows = {"file": file, "timeline": timeline, "version": seg.version, "segment": seg.base // seg.size, "room": seg.room}, []
    if seg.continued:
        rows.append(common | {"kind": "head", "lsn": seg.base, "length": seg.continued, "bytes": seg.stream[: min(seg.continued, len(seg.stream))].tobytes()})
    _, cut, length = seg.chain()
    if cut is not None:
        rows.append(common | {"kind": "tail", "lsn": int(seg.lsn(cut)), "length": length, "bytes": seg.stream[cut:].tobytes()})
    return rows


def finished_record(tail: dict, parts: list[dict], keep_raw: bool) -> pa.RecordBatch:
    """A record from its parts in the order of their segments; without a part, what the header tells, marked partial."""
    raw, left = tail["bytes"], tail["length"] - len(tail["bytes"])
    for p in parts:
        if p["length"] != left:  # continues another record
            break
        raw, left = raw + p["bytes"], left - len(p["bytes"])
    cols = {c: pa.array([tail[c]]) for c in ("file", "timeline", "version", "lsn")}
    if left:
        return _rows(1, cols | {"tot_len": pa.array([tail["length"]]), "partial": pa.array([True])})
    return _rows(1, decode(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64), tail["version"], keep_raw) | cols)


def whole_rows(keep_raw: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches):
            yield from whole_records(*segment, keep_raw)

    return run


def fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for segment in _segments(batches):
        yield pa.RecordBatch.from_pylist(fragments(*segment), schema=FRAGMENT)


def joined_rows(keep_raw: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield finished_record(r, sorted(r["parts"] or [], key=lambda p: p["segment"]), keep_raw)

    return run


def wal_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the segments at path: a file, or a folder of plain and compressed files and tar archives."""
    plain = read_compressed(spark, path).filter(file_class(F.col("name")).bitwiseAND(F.lit(WAL)) != 0)
    packed = expand_archives(spark, path).filter(file_class(F.col("name")).bitwiseAND(F.lit(WAL)) != 0)
    files = plain.unionByName(packed).filter(~F.col("name").endswith(".history"))
    return files.select(base_name(file_name(F.col("name"))).alias("file"), "content")


def described(records: DataFrame) -> Column:
    """The record's operation and blocks in words."""
    one = lambda b, k: F.concat(F.lit("blkref #"), k.cast("string"), F.lit(": rel "), F.concat_ws("/", b["spc"].cast("string"), b["db"].cast("string"), b["rel"].cast("string")), F.lit(" fork "), F.coalesce(F.try_element_at(F.array(*map(F.lit, FORKS)), b["fork"] + 1), b["fork"].cast("string")), F.lit(" blk "), b["blk"].cast("string"))
    return F.concat_ws(", ", F.concat(F.lit("info 0x"), F.lpad(F.hex(records["info"].cast("long")), 2, "0")), F.array_join(F.transform(records["blocks"], one), ", "))


def read_wal_records(files: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Records of the segments in files (file, content), as wal_files gives them: one row each, also for records over page and
    segment borders. file is the segment where a record starts, lsn its position, next_lsn is left to the operator of that name.

    A record whose rest no given segment holds, and a segment's start whose beginning no given segment holds, are one row marked
    partial: the first with lsn and tot_len, the second with the segment's first lsn, tot_len the bytes that were left. Reading
    ends at a length of 0 and at a page of an earlier use. A file that is no segment raises ValueError. A file that is given twice gives
    its records twice. An empty table gives none. With keep_raw, raw has each whole record's own bytes.

    A segment fits one task; segments are read twice, and only cut records are shuffled.
    """
    files = files.select("file", "content")
    whole = files.mapInArrow(whole_rows(keep_raw), RECORD_DDL)
    parts = files.mapInArrow(fragment_rows, FRAGMENT_DDL)
    heads = parts.filter("kind = 'head'").select(F.col("timeline").alias("t"), F.col("segment").alias("s"), F.struct("segment", "length", "bytes").alias("part")).dropDuplicates(["t", "s"])
    tails = parts.filter("kind = 'tail'")
    # the missing bytes and the room of a segment tell how many segments the record goes on in
    many = F.ceil((F.col("length") - F.octet_length("bytes")) / F.col("room")).cast("int")
    asks = tails.withColumn("row", F.monotonically_increasing_id()).withColumn("s", F.explode(F.sequence(F.col("segment") + 1, F.col("segment") + many)))
    found = asks.join(heads, (asks["timeline"] == heads["t"]) & (asks["s"] == heads["s"]), "left")
    first = lambda c: F.first(c).alias(c)
    found = found.groupBy("row").agg(*[first(c) for c in ("file", "timeline", "version", "lsn", "length", "bytes")], F.collect_list("part").alias("parts")).drop("row")
    finished = found.mapInArrow(joined_rows(keep_raw), RECORD_DDL)
    orphans = parts.filter("kind = 'head'").join(asks.select("timeline", F.col("s").alias("segment")).distinct(), ["timeline", "segment"], "left_anti")
    orphans = orphans.select("file", "timeline", "version", "lsn", F.col("length").alias("tot_len"), F.lit(True).alias("partial"))
    return with_names(whole.unionByName(finished).unionByName(orphans, allowMissingColumns=True), keep_raw)


def with_names(out: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Decoded rows with the columns that follow from theirs: rmgr, noop, fpi_len, xact_ts and description."""
    fpi = F.aggregate(F.filter("blocks", lambda b: b["has_image"]), F.lit(0).cast("long"), lambda a, b: a + b["bimg_len"])
    out = out.withColumn("rmgr", F.coalesce(F.try_element_at(F.array(*map(F.lit, MANAGERS)), F.col("rmid") + 1), F.concat(F.lit("custom"), F.col("rmid").cast("string"))))
    out = out.withColumn("noop", (F.col("rmid") == 0) & (F.col("info").bitwiseAND(F.lit(0xF0)) == 0x20)).withColumn("fpi_len", F.coalesce(fpi, F.lit(0).cast("long")))
    return out.withColumn("xact_ts", F.timestamp_micros("xact_us")).withColumn("description", described(out)).drop("xact_us", *([] if keep_raw else ["raw"]))
