"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

LOW = 4294967295


def lsn_to_string(lsn: Column) -> Column:
    """High and low halves in hexadecimal, joined by a slash."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(LOW))))


def string_to_lsn(text: Column) -> Column:
    half = lambda k: F.conv(F.element_at(F.split(text, "/"), k), 16, 10).cast("long")
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), F.shiftleft(half(1), 32).bitwiseOR(half(2)))


def lsn_from_halves(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def wal_file_name(timeline: Column, segno: Column, segment_size: int = 16 << 20) -> Column:
    per = (1 << 32) // segment_size
    return F.format_string("%08X%08X%08X", timeline.cast("long"), F.floor(segno / per).cast("long"), F.pmod(segno, F.lit(per)).cast("long"))


def wal_segno(name: Column, segment_size: int = 16 << 20) -> Column:
    part = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("long")
    return part(9) * ((1 << 32) // segment_size) + part(17)


def is_wal_file(name: Column) -> Column:
    return name.rlike("^[0-9A-Fa-f]{24}$")


def bytes_to_text(size: Column) -> Column:
    """Whole units or one decimal (halves to even), from EB down to B; 0 is 0."""
    out = F.when(size == 0, F.lit("0"))
    for unit, power in (("EB", 60), ("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("kB", 10)):
        whole = size % F.lit(1 << power) == 0
        text = F.when(whole, F.format_string(f"%d{unit}", F.floor(size / F.lit(1 << power)).cast("long"))).otherwise(F.format_string(f"%.1f{unit}", F.bround(size / F.lit(float(1 << power)), 1)))
        out = out.when(size >= F.lit(1 << power), text)
    return out.otherwise(F.format_string("%dB", size.cast("long")))


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def is_incremental_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).startswith("INCREMENTAL.")


def elapsed_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d:%07.4f", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), (seconds - F.floor(whole / 60) * 60).cast("double"))


def pg_timestamp(micros: Column) -> Column:
    """Microseconds since 2000-01-01 as a timestamp."""
    return F.timestamp_micros(micros + F.lit(946684800000000))


def label_time(label: Column) -> Column:
    return F.try_to_timestamp(label, F.lit("yyyyMMddHHmmss"))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def throughput(size: Column, seconds: Column) -> Column:
    """MB/s; 0 where no time passed. Sinks print four decimals."""
    return F.coalesce(F.try_divide(size, seconds * 1e6), F.lit(0.0))


def version_number(version: Column) -> Column:
    part = lambda k: F.coalesce(F.try_element_at(F.split(version, r"\."), F.lit(k)).cast("long"), F.lit(0))
    return part(1) * 10000 + part(2) * 100 + part(3)


def little_endian(data: Column, at: Column | int, width: int = 4) -> Column:
    """The little-endian unsigned number of width bytes that starts at byte at (from 0) of a binary column; null beyond its end."""
    h = F.hex(F.substring(data, at + 1 if isinstance(at, Column) else F.lit(at + 1), F.lit(width)))
    turned = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.when(F.length(h) == 2 * width, F.conv(turned, 16, 10).cast("long"))


@F.pandas_udf(LongType())
def crc32c(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC-32C of a binary column; the contents of a batch are stepped through together, byte by byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0x82F63B78) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    for s in batches:
        raw = [b or b"" for b in s]
        order = np.argsort([-len(b) for b in raw], kind="stable")
        crc = np.full(len(raw), 0xFFFFFFFF, np.uint32)
        size = np.array([len(b) for b in raw])[order]
        data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        start = np.cumsum(size) - size
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k))
            crc[:n] = table[(crc[:n] ^ data[start[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
        out = np.empty(len(raw), np.int64)
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
        yield pd.Series(out).where(s.notna().to_numpy())
