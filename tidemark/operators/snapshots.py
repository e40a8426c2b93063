"""Manifests, links between snapshots, and files rebuilt from a chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed names that are restored last and never linked.
RESTORE_LAST = ("global/pg_control", "postgresql.conf", "pg_hba.conf", "pg_ident.conf", "backup_label", "backup_manifest")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, checksum): deleted and changed with the old checksum, added with the new one; with any difference the
    manifest itself has changed."""
    o, n = old.select("path", F.col("checksum").alias("o")), new.select("path", F.col("checksum").alias("n"))
    d = o.join(n, "path", "full_outer").select(
        "path", F.when(F.col("n").isNull(), "deleted").when(F.col("o").isNull(), "added").when(F.col("o") != F.col("n"), "changed").alias("status"), F.coalesce("o", "n").alias("checksum")
    )
    d = d.filter("status IS NOT NULL")
    extra = d.agg(F.count("*").alias("c")).filter("c > 0").select(F.lit("backup_manifest").alias("path"), F.lit("changed").alias("status"), F.lit(None).cast("string").alias("checksum"))
    return d.unionByName(extra)


def manifest_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Whether size and checksum of each file are as listed; a missing file matches neither."""
    a = actual.select("path", F.col("size").alias("_s"), F.col("checksum").alias("_c"))
    return manifest.join(a, "path", "left").select("path", F.coalesce(F.col("size") == F.col("_s"), F.lit(False)).alias("size_ok"), F.coalesce(F.col("checksum") == F.col("_c"), F.lit(False)).alias("checksum_ok"))


def verify_files(manifest: DataFrame, files: DataFrame, bits: int = 512, all_rows: bool = False) -> DataFrame:
    """(path, status): ok, failed or missing; only the last two unless all_rows."""
    f = files.select("path", F.sha2("content", bits).alias("_c"))
    out = manifest.join(f, "path", "left").select("path", F.when(F.col("_c").isNull(), "missing").when(F.col("_c") == F.col("checksum"), "ok").otherwise("failed").alias("status"))
    return out if all_rows else out.filter("status <> 'ok'")


def verification_sweep(catalog: DataFrame, statuses: DataFrame) -> DataFrame:
    """catalog with valid false wherever a file of the snapshot isn't ok; statuses has server, label and status."""
    bad = statuses.groupBy("server", "label").agg(F.bool_and(F.col("status") == "ok").alias("_ok"))
    return catalog.join(bad, ["server", "label"], "left").withColumn("valid", F.col("valid") & F.coalesce("_ok", F.lit(True))).drop("_ok")


def link_unchanged(files: DataFrame, diff: DataFrame, previous: str) -> DataFrame:
    """Adds ref_label: files that neither changed nor are new, restored last or incremental refer to the snapshot before."""
    touched = diff.filter("status IN ('added', 'changed')").select("path", F.lit(True).alias("_t"))
    own = F.col("_t").isNotNull() | F.col("path").isin(*RESTORE_LAST) | F.element_at(F.split("path", "/"), -1).startswith("INCREMENTAL.")
    return files.join(touched, "path", "left").withColumn("ref_label", F.when(~own, F.lit(previous))).drop("_t")


def relink_on_delete(dropped: DataFrame, following: DataFrame, label: str) -> DataFrame:
    """following (path, ref_label) after dropped (path, ref_label) is gone: what it only linked is linked deeper, what it held
    becomes data of the following one (null)."""
    d = dropped.select("path", F.col("ref_label").alias("_r"))
    return following.join(d, "path", "left").withColumn("ref_label", F.when(F.col("ref_label") == label, F.col("_r")).otherwise(F.col("ref_label"))).drop("_r")


def dedupe_by_content(base: DataFrame, other: DataFrame) -> DataFrame:
    """Files of other with the same path, size and hash as in base: references."""
    return other.join(base.select("path", "size", "checksum"), ["path", "size", "checksum"], "left_semi")


def restore_file_plan(files: DataFrame) -> DataFrame:
    """Adds action for (path): skip, reconstruct or copy."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("action", F.when(F.col("path").isin("backup_label", "backup_manifest"), "skip").when(name.startswith("INCREMENTAL."), "reconstruct").otherwise("copy"))


def reconstruct_blocks(files: DataFrame, blocks: DataFrame, incremental: bool = True) -> DataFrame:
    """The newest version of every block of each file: (file, blk, payload).

    files (file, depth, kind, truncation_len) gives the file in each snapshot of the chain, depth 0 the newest; blocks (file, depth, blk, payload).
    The chain of a file ends at its first full snapshot. Blocks at or beyond the newest truncation come from the newest only. A chain
    without a full file gives an incremental result; where that isn't wanted it is an error, raised when the rows are computed.
    """
    ends = files.groupBy("file").agg(F.min(F.when(F.col("kind") == "full", F.col("depth"))).alias("last"), F.min_by("truncation_len", "depth").alias("cut"), F.min("depth").alias("newest"))
    if not incremental:
        ends = ends.withColumn("last", F.coalesce("last", F.raise_error(F.concat(F.lit("no snapshot of the chain has the full file "), F.col("file").cast("string"))).cast("int")))
    b = blocks.join(ends, "file").filter((F.col("last").isNull() | (F.col("depth") <= F.col("last"))) & ((F.col("depth") == F.col("newest")) | F.col("cut").isNull() | (F.col("blk") < F.col("cut"))))
    return b.groupBy("file", "blk").agg(F.min_by("payload", "depth").alias("payload"))


def zero_filled(files: DataFrame, rebuilt: DataFrame, zero) -> DataFrame:
    """rebuilt with a row for every block up to each file's length, zero where no snapshot has one."""
    newest = files.groupBy("file").agg(F.min_by("truncation_len", "depth").alias("cut"))
    length = newest.join(rebuilt.groupBy("file").agg(F.max("blk").alias("top")), "file", "left")
    n = F.greatest(F.coalesce("cut", F.lit(0)), F.coalesce(F.col("top") + 1, F.lit(0)))
    every = length.filter(n > 0).select("file", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("blk"))
    return every.join(rebuilt, ["file", "blk"], "left").withColumn("payload", F.coalesce("payload", zero))


def restore_size(files: DataFrame, block_size: int = 8192) -> DataFrame:
    """Total and largest size: an incremental file (truncation_len, top block) counts as long as it will be rebuilt."""
    grown = F.greatest(F.coalesce("truncation_len", F.lit(0)), F.coalesce(F.col("top") + 1, F.lit(0))) * block_size
    size = F.when(F.col("kind") == "incremental", grown).otherwise(F.col("size"))
    return files.groupBy("label").agg(F.sum(size).alias("restore_size"), F.max(size).alias("biggest_file"))


def standby_apply(target: DataFrame | None, newest: DataFrame, diff: DataFrame | None = None, incremental: bool = False) -> DataFrame:
    """target after deleting, overwriting and adding what diff names; rows like newest's (path, checksum). The first time, without target or diff,
    and for an incremental snapshot, whose files stand for nothing alone, all of newest is copied."""
    if target is None or diff is None or incremental:
        return newest
    gone = diff.select("path")
    fresh = newest.join(diff.filter("status IN ('added', 'changed')").select("path"), "path", "left_semi")
    return target.join(gone, "path", "left_anti").unionByName(fresh)


def rollup(chain: DataFrame) -> DataFrame:
    """Files (depth, path, checksum) of a chain as one snapshot: of each path the newest."""
    return chain.groupBy("path").agg(F.min_by("checksum", "depth").alias("checksum"))


def refresh_hash(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    return manifest.join(changed.select("path"), "path", "left_anti").unionByName(changed.select(manifest.columns))


def build_manifest(files: DataFrame, bits: int = 512) -> DataFrame:
    """(path, size, checksum) of files (path, content), and modified where they have modificationTime, as the binaryFile source does."""
    more = [F.col("modificationTime").alias("modified")] if "modificationTime" in files.columns else []
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", bits).alias("checksum"), *more)


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: how many files there are to process, and their bytes."""
    return manifest.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def merged_lists(*lists: DataFrame, by: str, name: str = "name") -> DataFrame:
    """(by, names): the names of several tables (by, name) as one list each, in order; a name that several have stands several times."""
    every = lists[0].select(by, name)
    for other in lists[1:]:
        every = every.unionByName(other.select(by, name))
    return every.groupBy(by).agg(F.sort_array(F.collect_list(name)).alias("names"))


def latest_rows(df: DataFrame, by: list[str], order: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


BLOCK = 8192
#: Fixed value: the first word of an incremental file.
MAGIC = 0xD3AE1F0D
#: Blocks of a file that are put together in one row.
PART = 1024


def file_blocks(files: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(path, blk, payload) of whole files (path, content); the last block may be shorter, an empty file has none."""
    n = F.ceil(F.octet_length("content") / block_size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.cast("long").alias("blk"), F.substring(F.col("content"), k * block_size + 1, F.lit(block_size)).alias("payload")))
    return files.filter(n > 0).select("path", F.explode(cut).alias("b")).select("path", "b.*")


def _read_incremental(block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                raw = memoryview(content.as_buffer())
                if len(raw) < 12 or int.from_bytes(raw[:4], "little") != MAGIC:
                    raise ValueError(f"incremental file {path}: wrong magic")
                n, cut = np.frombuffer(raw, "<u4", 2, 4).tolist()
                head = -(-(12 + 4 * n) // block_size) * block_size if n else 12
                if len(raw) < head + n * block_size:
                    raise ValueError(f"incremental file {path}: cut short")
                numbers = np.frombuffer(raw, "<u4", n, 12)
                for i in range(0, max(n, 1), PART):
                    some = numbers[i : i + PART].tolist() or [None]
                    pages = [None if k is None else bytes(raw[head + (i + j) * block_size :][:block_size]) for j, k in enumerate(some)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([cut] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(pages, pa.binary())], names=["path", "truncation_len", "blk", "payload"])

    return run


def incremental_files(files: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(path, truncation_len, blk, payload) of incremental files (path, content), a row a block; a file without blocks is one row without.

    The header is the magic, the number of blocks, the truncation length and the blocks' numbers, in words of four bytes, filled up to a
    block if there are blocks; then come the blocks. Another magic, or fewer bytes than the header tells, is an error.
    """
    return files.select("path", "content").mapInArrow(_read_incremental(block_size), "path string, truncation_len long, blk long, payload binary")


def incremental_content(blocks: Column, truncation_len: Column, block_size: int = BLOCK) -> Column:
    """The bytes of an incremental file of blocks, an array of (blk, payload)."""
    le = lambda x: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x.cast("bigint")), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    joined = lambda parts: F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    n = F.size(blocks)
    head = joined(F.concat(F.array(le(F.lit(MAGIC)), le(n), le(truncation_len)), F.transform(blocks, lambda b: le(b["blk"]))))
    fill = F.when(n > 0, F.pmod(-(n + 3) * 4, F.lit(block_size))).otherwise(F.lit(0))
    return F.concat(head, F.unhex(F.repeat(F.lit("00"), fill)), joined(F.transform(blocks, lambda b: b["payload"])))


def file_parts(blocks: DataFrame, by: str = "file", part: int = PART) -> DataFrame:
    """(file, part, bytes): blocks (file, blk, payload) put together in order, part of them a row, so that no file is held whole."""
    g = blocks.groupBy(by, F.floor(F.col("blk") / part).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("blk", "payload"))).alias("b"))
    return g.select(by, "part", F.unhex(F.array_join(F.transform("b", lambda x: F.hex(x["payload"])), "")).alias("bytes"))
