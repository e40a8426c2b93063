"""Which blocks of which relation forks changed, and what an incremental snapshot must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import little_endian

KEY = ["spc", "db", "rel", "fork"]
FREE_SPACE = 1
CHUNK = 65536
ARRAY_MOST = 4095
#: Fixed names of the forks.
FORKS = ("", "_fsm", "_vm", "_init")


def effective_limits(events: DataFrame) -> DataFrame:
    """Limit events that are lower than every earlier one of their fork: (key, lsn, phase, limit_block)."""
    before = W.partitionBy(*KEY).orderBy("lsn", "phase").rowsBetween(W.unboundedPreceding, -1)
    e = events.filter("phase = 0 AND limit_block IS NOT NULL").withColumn("low", F.min("limit_block").over(before))
    return e.filter("low IS NULL OR limit_block < low").drop("low")


#: Operations of resource managers that change limits, and log operations of which no block counts.
XACT_ENDS = (0x00, 0x20, 0x30, 0x40)
STORAGE_CREATE, STORAGE_TRUNCATE, TRUNCATES_HEAP, TRUNCATES_VM = 0x10, 0x20, 1, 2
NO_BLOCKS = (0x00, 0x60, 0x90, 0xE0)
MAIN, VM, INIT = 0, 2, 3


def block_events(records: DataFrame) -> DataFrame:
    """Events (spc, db, rel, fork, lsn, phase 0 limit or 1 mark, limit_block, blk) of decoded records, as read_wal_records gives them.

    Ends of transactions cut the forks of dropped relations to 0, a new fork is cut to 0, a truncation cuts the main fork and the visibility map
    as its flags say, and a database that is made or dropped cuts its relation 0 in each tablespace. Then each block reference is
    a mark. Free space maps have no events. Checkpoints of a shutdown or redo, ends of recovery and changed parameters have none, nor do
    partial records. Payloads that are cut short have no limits.
    """
    r = records.filter(~F.coalesce("partial", F.lit(False)) & ~((F.col("rmid") == 0) & F.col("info").bitwiseAND(F.lit(0xF0)).isin(*NO_BLOCKS)))
    op, data = F.col("info").bitwiseAND(F.lit(0xF0)), F.col("main_data")
    at = lambda k: little_endian(data, 4 * k)
    limit = lambda spc, db, rel, fork, blk: F.struct(spc.alias("spc"), db.alias("db"), rel.alias("rel"), fork.cast("int").alias("fork"), blk.cast("long").alias("limit_block"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<spc:bigint,db:bigint,rel:bigint,fork:int,limit_block:bigint>>")
    forks = F.array(*map(F.lit, (MAIN, VM, INIT)))
    dropped = F.flatten(F.transform("dropped_rels", lambda x: F.transform(forks, lambda f: limit(x["spc"], x["db"], x["rel"], f, zero))))
    new = F.array(limit(at(0), at(1), at(2), at(3), zero))
    flags = at(4)
    cut = lambda flag, fork: F.when(flags.bitwiseAND(F.lit(flag)) != 0, limit(at(1), at(2), at(3), F.lit(fork), at(0)))
    cuts = F.array_compact(F.array(cut(TRUNCATES_HEAP, MAIN), cut(TRUNCATES_VM, VM)))
    drops = F.when(F.col("version") >= 15, op == 0x20).otherwise(op == 0x10)
    made = (op == 0x00) | ((F.col("version") >= 15) & (op == 0x10))
    spaces = F.when(at(1) > 0, F.sequence(F.lit(0).cast("long"), at(1) - 1)).otherwise(F.array().cast("array<bigint>"))
    emptied = F.transform(spaces, lambda k: limit(little_endian(data, k * 4 + 8), at(0), zero, F.lit(MAIN), zero))
    made_in = F.array(limit(at(1), at(0), zero, F.lit(MAIN), zero))
    rmid, xact = F.col("rmid"), F.col("info").bitwiseAND(F.lit(0x70))
    limits = (
        F.when((rmid == 1) & xact.isin(*XACT_ENDS), dropped)
        .when((rmid == 2) & (op == STORAGE_CREATE), new)
        .when((rmid == 2) & (op == STORAGE_TRUNCATE), cuts)
        .when((rmid == 4) & drops, emptied)
        .when((rmid == 4) & made, made_in)
    )
    whole = F.filter(F.coalesce(limits, none), lambda x: x["spc"].isNotNull() & x["db"].isNotNull() & x["rel"].isNotNull() & (x["fork"] != FREE_SPACE) & x["limit_block"].isNotNull())
    marks = F.filter("blocks", lambda b: b["fork"] != FREE_SPACE)
    event = lambda x, phase, lim, blk: F.struct(*[x[k].alias(k) for k in KEY], F.lit(phase).alias("phase"), lim.cast("long").alias("limit_block"), blk.cast("long").alias("blk"))
    every = F.concat(F.transform(whole, lambda x: event(x, 0, x["limit_block"], F.lit(None))), F.transform(F.coalesce(marks, F.array().cast(records.schema["blocks"].dataType)), lambda b: event(b, 1, F.lit(None), b["blk"])))
    return r.select("lsn", F.explode(every).alias("e")).select(*[f"e.{k}" for k in KEY], "lsn", "e.phase", "e.limit_block", "e.blk")


def last_limits(events: DataFrame) -> DataFrame:
    """(key, limit_block, lsn): the lowest limit of each fork and where it first came up, which is the last limit that took effect."""
    low = events.filter("phase = 0 AND limit_block IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct("limit_block", "lsn")).alias("low"))
    return low.select(*KEY, "low.limit_block", "low.lsn")


def brt_limits(events: DataFrame) -> DataFrame:
    return events.filter("phase = 0 AND limit_block IS NOT NULL").groupBy(*KEY).agg(F.min("limit_block").alias("limit_block"))


def summarize(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Modified blocks (key, blk) of events (key, lsn, phase 0 limit or 1 mark, limit_block, blk) with start <= lsn < end.

    A limit removes marks at or above it that came before; later marks stay. It only takes effect where it is lower than all before
    it, so of the limits after a mark the last one is the lowest: each mark is held against one row of its fork.
    """
    if start is not None:
        events = events.filter(F.col("lsn") >= start)
    if end is not None:
        events = events.filter(F.col("lsn") < end)
    marks = events.filter((F.col("phase") == 1) & (F.col("fork") != FREE_SPACE) & F.col("blk").isNotNull())
    marks = marks.groupBy(*KEY, "blk").agg(F.max("lsn").alias("last"))
    low = last_limits(events).select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("lsn").alias("_lsn"), "limit_block")
    out = marks.join(low, [F.col(k) == F.col(f"_{k}") for k in KEY], "left")
    return out.filter(F.col("limit_block").isNull() | (F.col("blk") < F.col("limit_block")) | (F.col("last") >= F.col("_lsn"))).select(*KEY, "blk")


def brt_range(blocks: DataFrame, start: int, stop: int) -> DataFrame:
    return blocks.filter((F.col("blk") >= start) & (F.col("blk") < stop))


def brt_chunks(blocks: DataFrame) -> DataFrame:
    """Blocks by chunk of 65,536: how many, how they are best kept, and their offsets."""
    c = blocks.withColumn("chunk", F.floor(F.col("blk") / CHUNK).cast("long"))
    out = c.groupBy(*KEY, "chunk").agg(F.sort_array(F.collect_set((F.col("blk") % CHUNK).cast("int"))).alias("offsets"))
    n = F.size("offsets")
    return out.withColumn("n", n.cast("long")).withColumn("kind", F.when(n <= ARRAY_MOST, "array").otherwise("bitmap"))


#: Spark's bitmaps hold so many bits: half a chunk.
BUCKET = 32768


def brt_packed(blocks: DataFrame) -> DataFrame:
    """(key, bucket, n, offsets, bits): blocks by half chunks, offsets (two bytes each) while those are smaller than a bitmap of all, else
    bits, of which bit k stands for offset k. bucket counts half chunks from 0."""
    c = blocks.select(*KEY, F.floor(F.col("blk") / BUCKET).cast("long").alias("bucket"), (F.col("blk") % BUCKET).alias("at"))
    g = c.groupBy(*KEY, "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    return _smallest(g.withColumn("n", F.bitmap_count("bits")))


def _smallest(packed: DataFrame) -> DataFrame:
    dense = F.col("n") * 2 > BUCKET // 8
    return packed.select(*KEY, "bucket", "n", F.when(~dense, _offsets("bits").cast("array<smallint>")).alias("offsets"), F.when(dense, F.col("bits")).alias("bits"))


def _offsets(bits: str) -> Column:
    """Offsets of the set bits of a bitmap, ascending, word by word."""
    words = F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 32 - 1)), lambda k: F.struct(k.alias("k"), little_endian(F.col(bits), k * 4).alias("w")))
    some = F.filter(words, lambda x: x["w"] != 0)
    return F.flatten(F.transform(some, lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(x["w"], i) == 1), lambda i: (x["k"] * 32 + i).cast("int"))))


def brt_union(*packed: DataFrame) -> DataFrame:
    """Packed tables of several ranges as one, by OR of their bits."""
    every = reduce(DataFrame.unionByName, packed)
    sparse = every.filter("bits IS NULL").select(*KEY, "bucket", F.explode("offsets").alias("at")).groupBy(*KEY, "bucket").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
    both = sparse.unionByName(every.filter("bits IS NOT NULL").select(*KEY, "bucket", "bits"))
    return _smallest(both.groupBy(*KEY, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits")))


def brt_unpacked(packed: DataFrame) -> DataFrame:
    """(key, blk) of packed blocks."""
    at = F.coalesce(F.col("offsets").cast("array<int>"), _offsets("bits"))
    return packed.select(*KEY, "bucket", F.explode(at).alias("at")).select(*KEY, (F.col("bucket") * BUCKET + F.col("at")).alias("blk"))


def relation_path(spc: Column, db: Column, rel: Column, fork: Column, version: str = "PG_17") -> Column:
    name = F.concat(rel.cast("string"), F.element_at(F.array(*map(F.lit, FORKS)), fork.cast("int") + 1))
    return (
        F.when(spc == 1664, F.concat(F.lit("global/"), name))
        .when(spc == 1663, F.concat_ws("/", F.lit("base"), db.cast("string"), name))
        .otherwise(F.concat_ws("/", F.lit("pg_tblspc"), spc.cast("string"), F.lit(version), db.cast("string"), name))
    )


def parse_relation_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds spc, db, rel, fork and segno; null where the path is no relation's."""
    name = r"([0-9]+)(_fsm|_vm|_init)?(?:\.([0-9]+))?$"
    p = F.col(path)
    file = rf"^(?:global|base/[0-9]+|pg_tblspc/[0-9]+/[^/]+/[0-9]+)/{name}"
    number = lambda text: F.when(text != "", text.cast("long"))
    fork = F.regexp_extract(p, file, 2)
    good = p.rlike(file)
    return df.select(
        "*",
        F.when(good, F.when(p.startswith("global/"), F.lit(1664)).when(p.startswith("base/"), F.lit(1663)).otherwise(number(F.regexp_extract(p, "^pg_tblspc/([0-9]+)/", 1)))).cast("long").alias("spc"),
        F.when(good, F.coalesce(number(F.regexp_extract(p, "^(?:base|pg_tblspc/[0-9]+/[^/]+)/([0-9]+)/", 1)), F.lit(0).cast("long"))).alias("db"),
        F.when(good, number(F.regexp_extract(p, file, 1))).alias("rel"),
        F.when(good, F.array_position(F.array(*map(F.lit, FORKS)), fork) - 1).cast("int").alias("fork"),
        F.when(good, F.coalesce(number(F.regexp_extract(p, file, 3)), F.lit(0).cast("long"))).alias("segno"),
    )


def incremental_file_size(blocks: Column, block_size: int = 8192) -> Column:
    """Header of 3 + n words of four bytes, filled up to a block if there are blocks, and the blocks."""
    head = (blocks + 3) * 4
    return F.when(blocks > 0, F.ceil(head / block_size) * block_size + blocks * block_size).otherwise(head).cast("long")


def incremental_plan(files: DataFrame, blocks: DataFrame, limits: DataFrame, block_size: int = 8192, segment_blocks: int = 131072) -> DataFrame:
    """For files (path, size) how each goes into an incremental snapshot: kind full or incremental, blocks relative to the
    segment, truncation_len."""
    f = parse_relation_path(files)
    base = F.col("segno") * segment_blocks
    lim = limits.select(*[F.col(k).alias(f"_{k}") for k in KEY], "limit_block", F.lit(True).alias("_has"))
    known = blocks.select(*KEY).union(limits.select(*KEY)).distinct().select(*[F.col(k).alias(f"k_{k}") for k in KEY], F.lit(True).alias("entry"))
    f = f.join(lim, [F.col(k) == F.col(f"_{k}") for k in KEY], "left").join(known, [F.col(k) == F.col(f"k_{k}") for k in KEY], "left")
    name = F.element_at(F.split("path", "/"), -1)
    full = name.isin("pg_filenode.map", "PG_VERSION", "pg_control") | F.col("rel").isNull() | (F.col("size") % block_size != 0) | (F.col("fork") == FREE_SPACE)
    full = full | ((F.col("size") == 0) & F.col("entry").isNull()) | F.coalesce(F.col("limit_block") <= base, F.lit(False))
    b = blocks.select(*[F.col(k).alias(f"b_{k}") for k in KEY], "blk")
    inner = [F.col(k) == F.col(f"b_{k}") for k in KEY] + [F.col("blk") >= base, F.col("blk") < base + F.least(F.lit(segment_blocks), F.floor(F.col("size") / block_size))]
    out = f.withColumn("full", F.coalesce(full, F.lit(True))).join(b, [~F.col("full"), *inner], "left")
    g = out.groupBy("path", "size", "full").agg(F.sort_array(F.collect_list(F.col("blk") - base)).alias("blocks"), F.max(F.col("limit_block") - base).alias("limit"))
    length = F.greatest(F.floor(F.col("size") / block_size), F.coalesce("limit", F.lit(0)))
    return g.select("path", F.when(F.col("full"), "full").otherwise("incremental").alias("kind"), F.when(~F.col("full"), F.col("blocks")).alias("blocks"), F.when(~F.col("full"), length.cast("long")).alias("truncation_len"))
