"""Operators over decoded log records: columns lsn, prev_lsn, xid, rmgr, tot_len, fpi_len, description and, where named, more."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import crc32c
from tidemark.operators.ordered import by_log, carried


def _among(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is in a list, which is pushed into the scan, or in the first column of a table, which is joined."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi").select(df.columns)
    return df.filter(F.col(column).isin(list(values)))


def wal_filter(records: DataFrame, rmgrs: list[str] | DataFrame | None = None, start_lsn: int = 0, end_lsn: int = 0, xids: list[int] | DataFrame | None = None) -> DataFrame:
    """Keep records by resource manager, bounds (0: none) and transactions; partial records and no-ops never pass. Lists that are
    given as values are part of the scan's filters; lists as large as tables are given as tables."""
    out = records
    if "partial" in records.columns:
        out = out.filter(~F.col("partial"))
    if "noop" in records.columns:
        out = out.filter(~F.col("noop"))
    if start_lsn > 0:
        out = out.filter(F.col("prev_lsn") >= start_lsn)
    if end_lsn > 0:
        out = out.filter(F.col("lsn") <= end_lsn)
    given = lambda values: isinstance(values, DataFrame) or bool(values)
    if given(rmgrs):
        out = _among(out, "rmgr", rmgrs)
    return _among(out, "xid", xids) if given(xids) else out


def _named(records: DataFrame, names: list[str], mapping: DataFrame | None) -> Column:
    """Does the record name any of the objects: in its description, or as tablespace, database or relation of a block, by number or, where
    mapping (oid, name) resolves it, by name?"""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.coalesce(F.contains(F.col("description"), F.lit(n)), F.lit(False))
    if "blocks" not in records.columns:
        return hit
    wanted = F.array(*[F.lit(int(n)).cast("long") for n in names if n.isdecimal()]).cast("array<bigint>")
    if mapping is not None:
        wanted = F.concat(wanted, mapping.filter(F.col("name").isin(names)).agg(F.collect_set(F.col("oid").cast("long")).alias("oids")).scalar())
    touched = F.flatten(F.transform("blocks", lambda b: F.array(b["rel"], b["db"], b["spc"])))
    return hit | F.coalesce(F.arrays_overlap(touched, wanted), F.lit(False))


def wal_filter_objects(records: DataFrame, names: list[str], mapping: DataFrame | None = None) -> DataFrame:
    """Records that name any of the objects: in the description, or in their blocks by number or resolved by mapping (oid, name)."""
    return records.filter(_named(records, names, mapping)) if names else records


def wal_filter_interactive(records: DataFrame, rmgrs: str = "", start_lsn: int = 0, end_lsn: int = 0, xids: str = "", relations: str = "", mapping: DataFrame | None = None) -> DataFrame:
    """Filters given as comma lists; resource managers in any case, a relation by number, by name or as part of the description."""
    parts = lambda s: [x.strip() for x in s.split(",") if x.strip()]
    out = records
    if parts(rmgrs):
        out = out.filter(F.lower("rmgr").isin([x.lower() for x in parts(rmgrs)]))
    if start_lsn:
        out = out.filter(F.col("prev_lsn") >= start_lsn)
    if end_lsn:
        out = out.filter(F.col("lsn") <= end_lsn)
    if parts(xids):
        out = _among(out, "xid", [int(x) for x in parts(xids)])
    return wal_filter_objects(out, parts(relations), mapping)


def wal_search(records: DataFrame, rmgr: str | None = None, start_lsn: int = 0, end_lsn: int = 0, xid: int | None = None, text: str | None = None, most: int | None = None) -> DataFrame:
    """(file, idx, lsn, matched) of records that meet every criterion: idx counts within the file from 0. With most, only the first
    so many of them, in order of file and idx; without, all."""
    w = W.partitionBy("file").orderBy("lsn")
    r = records.withColumn("idx", F.row_number().over(w) - 1)
    tests: list[tuple[str, Column]] = []
    if rmgr is not None:
        tests.append(("rmgr", F.lower("rmgr") == rmgr.lower()))
    if start_lsn:
        tests.append(("start_lsn", F.col("lsn") >= start_lsn))
    if end_lsn:
        tests.append(("end_lsn", F.col("next_lsn") <= end_lsn))
    if xid is not None:
        tests.append(("xid", F.col("xid") == xid))
    if text is not None:
        tests.append(("description", F.instr("description", text) > 0))
    for _, t in tests:
        r = r.filter(t)
    out = r.select("file", "idx", "lsn", F.array(*[F.lit(n) for n, _ in tests]).alias("matched"))
    return out if most is None else out.orderBy("file", "idx").limit(most)


def next_lsn(records: DataFrame, by: str = "timeline") -> DataFrame:
    """next_lsn: the lsn of the following record of the timeline, 0 for the last."""
    r = carried(records.drop("next_lsn"), by, by_log("lsn"), ["lsn"], F.col("lsn"), "next_lsn", backward=True)
    return r.withColumn("next_lsn", F.coalesce("next_lsn", F.lit(0)))


#: Of each resource manager that has named operations the bits of info that tell them, and the names.
OPERATIONS = {
    0: (0xF0, {
        0x00: "CHECKPOINT_SHUTDOWN", 0x10: "CHECKPOINT_ONLINE", 0x20: "NOOP", 0x30: "NEXTOID", 0x40: "SWITCH", 0x50: "BACKUP_END", 0x60: "PARAMETER_CHANGE",
        0x70: "RESTORE_POINT", 0x80: "FPW_CHANGE", 0x90: "END_OF_RECOVERY", 0xA0: "FPI_FOR_HINT", 0xB0: "FPI", 0xE0: "CHECKPOINT_REDO",
    }),
    1: (0x70, {0x00: "COMMIT", 0x10: "PREPARE", 0x20: "ABORT", 0x30: "COMMIT_PREPARED", 0x40: "ABORT_PREPARED"}),
    8: (0xF0, {0x00: "LOCK", 0x10: "RUNNING_XACTS"}),
    10: (0x70, {0x00: "INSERT", 0x10: "DELETE", 0x20: "UPDATE", 0x30: "TRUNCATE", 0x40: "HOT_UPDATE", 0x70: "INPLACE"}),
    11: (0xF0, {0x00: "INSERT_LEAF", 0x10: "INSERT_UPPER", 0x30: "SPLIT_L", 0x40: "SPLIT_R", 0x70: "DELETE"}),
}


def with_op(records: DataFrame, ops: DataFrame | None = None) -> DataFrame:
    """Adds op, the operation's name, null where it has none: of OPERATIONS by rmid and info, or from ops (rmid, mask, info, op), a fixed list
    of other operations."""
    if ops is not None:
        return records.join(F.broadcast(ops), (records["rmid"] == ops["rmid"]) & (records["info"].bitwiseAND(ops["mask"]) == ops["info"]), "left").select(records["*"], ops["op"])
    op = F.lit(None).cast("string")
    for rmid, (mask, names) in OPERATIONS.items():
        code = F.col("info").bitwiseAND(F.lit(mask))
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        op = F.when(F.col("rmid") == rmid, F.try_element_at(table, code.cast("int"))).otherwise(op)
    return records.withColumn("op", op)


def record_lengths(records: DataFrame) -> DataFrame:
    """fpi_len: bytes of block images; rec_len: the rest of the record."""
    fpi = F.aggregate(F.filter("blocks", lambda b: b["has_image"]), F.lit(0).cast("long"), lambda a, b: a + b["bimg_len"])
    return records.withColumn("fpi_len", F.coalesce(fpi, F.lit(0).cast("long"))).withColumn("rec_len", F.col("tot_len") - F.col("fpi_len"))


def explode_blocks(records: DataFrame) -> DataFrame:
    return records.select("lsn", F.posexplode("blocks").alias("block_id", "b")).select("lsn", "block_id", "b.*")


def wal_limit(records: DataFrame, n: int) -> DataFrame:
    return records.orderBy("lsn").limit(n)


def marked_xids(records: DataFrame, marked: Column) -> DataFrame:
    """Distinct transactions above 0 of the marked records, first seen first."""
    return records.filter(marked & (F.col("xid") > 0)).groupBy("xid").agg(F.min("lsn").alias("first_lsn")).orderBy("first_lsn")


def known_values(df: DataFrame, column: str, start: str, most: int) -> DataFrame:
    return df.filter(F.col(column).startswith(start)).select(F.col(column).alias("value")).distinct().orderBy("value").limit(most)


def longest_common_prefix(df: DataFrame, column: str) -> DataFrame:
    """One row: the least and greatest value share what all values share."""
    a, b = F.col("low"), F.col("high")
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.left(a, k) == F.left(b, k))
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high")).select(F.left(a, F.array_max(same)).alias("prefix"))


def translate_oids(records: DataFrame, names: DataFrame, column: str, to: str) -> DataFrame:
    """Adds to: the name of the object whose oid stands in column, else the number as text. names has oid and name."""
    n = names.select(F.col("oid").alias("_oid"), F.col("name").alias("_name"))
    return records.join(n, F.col(column) == F.col("_oid"), "left").withColumn(to, F.coalesce("_name", F.col(column).cast("string"))).drop("_oid", "_name")


def xact_timestamps(records: DataFrame) -> DataFrame:
    """Adds ts: a record's own commit time, else that of its transaction (of several the earliest record's); xid 0 has none."""
    own = records.filter(F.col("xact_ts").isNotNull()).select("lsn", "xact_ts", F.explode(F.array_prepend(F.coalesce("subxacts", F.array().cast("array<long>")), F.col("xid"))).alias("_xid"))
    times = own.filter("_xid <> 0").groupBy("_xid").agg(F.min_by("xact_ts", "lsn").alias("_ts"))
    own_xid = F.nullif("xid", F.lit(0))  # no record of xid 0 takes part in the join
    return records.join(times, own_xid == F.col("_xid"), "left").withColumn("ts", F.coalesce("xact_ts", "_ts")).drop("_xid", "_ts")


def rmgr_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("rmgr").agg(F.count("*").alias("n"))


def wal_stats(records: DataFrame) -> DataFrame:
    """Per resource manager: count, sizes, and each as a percentage of the total (0 where the total is 0)."""
    s = records.groupBy("rmgr").agg(F.count("*").alias("n"), F.sum(F.col("tot_len") - F.col("fpi_len")).alias("record_size"), F.sum("fpi_len").alias("fpi_size"), F.sum("tot_len").alias("combined_size"))
    every = W.partitionBy()
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * F.lit(100.0), F.sum(c).over(every)), F.lit(0.0)), 6)
    return s.select("*", *[share(c).alias(f"{c}_pct") for c in ("n", "record_size", "fpi_size", "combined_size")])


XLOG, NOOP = 0, 0x20
HEADER, CRC_AT = 24, 20


def _as_noops(records: DataFrame, changed: Column) -> DataFrame:
    """Adds changed; such records become no-ops of the log manager in every column that says so. Where raw has a record's bytes, they
    and crc are stamped anew: CRC-32C over what follows the header, then over the header without it."""
    r = records.withColumn("changed", changed)
    now = lambda c, value: F.when(F.col("changed"), value).otherwise(F.col(c))
    new = {"rmgr": F.lit("XLOG"), "rmid": F.lit(XLOG), "info": F.lit(NOOP), "noop": F.lit(True)}
    if "raw" in records.columns:
        part = lambda at, n: F.substring(F.col("raw"), F.lit(at + 1), F.lit(n))
        head = F.concat(part(0, 16), F.lit(bytes([NOOP, XLOG])), part(18, 2))
        rest = F.substring(F.col("raw"), F.lit(HEADER + 1), F.octet_length("raw"))
        r = r.withColumn("_crc", crc32c(F.when(F.col("changed"), F.concat(rest, head))))
        turned = F.lpad(F.hex("_crc"), 8, "0")
        stamp = F.unhex(F.concat(*[F.substring(turned, k, 2) for k in (7, 5, 3, 1)]))
        new |= {"raw": F.concat(head, stamp, rest), "crc": F.col("_crc")}
    return r.select(*[now(c, new[c].cast(records.schema[c].dataType)).alias(c) if c in new else F.col(c) for c in records.columns], "changed")


def _of_transactions(records: DataFrame, xids: list[int] | DataFrame, mark: str) -> DataFrame:
    """Adds mark: is the record's own or top transaction among xids?"""
    own = [c for c in ("xid", "toplevel_xid") if c in records.columns]
    if not isinstance(xids, DataFrame):
        return records.withColumn(mark, reduce(or_, [F.coalesce(F.col(c).isin(list(xids)), F.lit(False)) for c in own], F.lit(False)))
    gone, r = xids.select(F.col(xids.columns[0]).alias("_x")).filter("_x IS NOT NULL").distinct(), records.withColumn(mark, F.lit(False))
    for c in own:
        r = r.join(gone, F.col(c) == F.col("_x"), "left").withColumn(mark, F.col(mark) | F.col("_x").isNotNull()).drop("_x")
    return r


def wal_filter_xids(records: DataFrame, xids: list[int] | DataFrame) -> DataFrame:
    """Records of the transactions become no-ops, with new checksums where the records have their bytes (raw); none goes. Adds changed."""
    return _as_noops(_of_transactions(records, xids, "_a"), F.col("_a")).drop("_a")


def wal_filter_delete(records: DataFrame, deletes: Column, xmax: str) -> DataFrame:
    """Deletes, and records of any transaction that a delete names, become no-ops like those of wal_filter_xids. Adds changed."""
    r = _of_transactions(records, records.filter(deletes).select(xmax), "_a")
    return _as_noops(r, F.coalesce(deletes, F.lit(False)) | F.col("_a")).drop("_a")
