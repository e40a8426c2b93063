"""Snapshots as versioned tables, and the changes that take several of them at once: roll-up of a chain, and deletion.

A store is a folder with one folder for each version and table, and a folder of pointers. A change writes the tables of a new version and
then one pointer to it. The newest pointer is what readers see; a job that is lost before its pointer is written leaves the
old state, and what it wrote is never read. One change runs at a time.

catalog (server, label, type, parent_label, valid, keep, size, ...); files (server, label, path, kind full or incremental, size, truncation_len, ref_label: the
snapshot that holds the data of a linked file, null: this one); blocks (server, label, path, blk, payload) of the files that a
snapshot holds itself, whole files by file_blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.catalog import label_chains, valid_neighbours
from tidemark.operators.snapshots import BLOCK, reconstruct_blocks

TABLES = ("catalog", "files", "blocks")


@dataclass
class Snapshots:
    """The tables of one version."""

    version: int
    catalog: DataFrame
    files: DataFrame
    blocks: DataFrame


def _pointers(spark: SparkSession, root: str) -> list[int]:
    try:
        found = spark.read.text(f"{root}/published/*").select(F.col("value").cast("int").alias("v")).filter("v IS NOT NULL").distinct().collect()
    except AnalysisException:
        return []
    return sorted(r.v for r in found)


def current(spark: SparkSession, root: str) -> Snapshots:
    """What the newest pointer names."""
    every = _pointers(spark, root)
    if not every:
        raise ValueError(f"there is no store at {root}")
    v = every[-1]
    return Snapshots(v, *[spark.read.parquet(f"{root}/version={v}/{t}") for t in TABLES])


def publish(spark: SparkSession, root: str, catalog: DataFrame, files: DataFrame, blocks: DataFrame, version: int) -> None:
    """Write the tables of a version, then its pointer. Tables of a version that was never pointed to are replaced."""
    if version in _pointers(spark, root):
        raise ValueError(f"version {version} is already there")
    for name, df in zip(TABLES, (catalog, files, blocks), strict=True):
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    point(spark, root, version)


def point(spark: SparkSession, root: str, version: int) -> None:
    spark.createDataFrame([(str(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/published/{version}")


def _is(server, label: str) -> Column:
    return (F.col("server") == server) & (F.col("label") == label)


def _sizes(files: DataFrame) -> DataFrame:
    """(server, label, _size): bytes that a snapshot holds itself."""
    return files.filter("ref_label IS NULL").groupBy("server", "label").agg(F.sum("size").alias("_size"))


def rolled_up(s: Snapshots, server, newest: str, oldest: str | None = None) -> Snapshots:
    """s with newest rolled up with its chain down to oldest (null: the first full snapshot): its incremental files are rebuilt from the
    chain, all others stay. It becomes full if oldest is, without a parent; else it is incremental to oldest's parent. The others of the
    chain stay as they are. A full newest is an error, and so is a chain that isn't whole."""
    spark = s.catalog.sparkSession
    chain = label_chains(s.catalog, spark.createDataFrame([(server, newest, oldest)], f"server {s.catalog.schema['server'].dataType.simpleString()}, newest string, oldest string"))
    ends = chain.join(s.catalog, ["server", "label"]).select("depth", "label", "type", "parent_label").orderBy("depth")
    ends = ends.agg(F.min_by(F.struct("label", "type"), "depth").alias("new"), F.max_by(F.struct("label", "type", "parent_label"), "depth").alias("old")).first()
    if ends.new.type == "full":
        raise ValueError(f"a full snapshot has no chain to roll up: {newest}")
    full = ends.old.type == "full"

    mine = s.files.filter(_is(server, newest))
    paths = mine.filter("kind = 'incremental'").select("path").distinct()
    # a linked file of the chain stands for the data of the snapshot that it refers to
    held = s.files.filter(F.col("server") == server).join(chain.select("label", "depth"), "label").join(paths, "path", "left_semi")
    held = held.select(F.col("path").alias("file"), "depth", "kind", "truncation_len", F.coalesce("ref_label", "label").alias("at"))
    data = s.blocks.filter(F.col("server") == server).select(F.col("path").alias("file"), F.col("label").alias("at"), "blk", "payload")
    rebuilt = reconstruct_blocks(held.drop("at"), held.select("file", "depth", "at").join(data, ["file", "at"]).drop("at"), incremental=not full)
    cut = held.groupBy("file").agg(F.min_by("truncation_len", "depth").alias("cut"))
    top = cut.join(rebuilt.groupBy("file").agg(F.max("blk").alias("top")), "file", "left").withColumn("n", F.greatest(F.coalesce("cut", F.lit(0)), F.coalesce(F.col("top") + 1, F.lit(0))).cast("long"))
    if full:  # what no snapshot has is zero
        every = top.filter("n > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("blk"))
        zero = F.unhex(F.repeat(F.lit("00"), BLOCK))
        rebuilt = every.join(rebuilt, ["file", "blk"], "left").select("file", "blk", F.coalesce("payload", zero).alias("payload"))
    sizes = rebuilt.groupBy(F.col("file").alias("path")).agg(F.sum(F.octet_length("payload")).alias("_size"))
    merged = mine.filter("kind = 'incremental'").join(sizes, "path", "left").withColumn("size", F.coalesce("_size", F.lit(0)).cast(s.files.schema["size"].dataType))
    merged = merged.withColumn("kind", F.lit("full" if full else "incremental")).withColumn("ref_label", F.lit(None).cast("string"))
    if full:
        merged = merged.withColumn("truncation_len", F.lit(None).cast(s.files.schema["truncation_len"].dataType))
    files = s.files.filter(~_is(server, newest)).unionByName(mine.filter("kind <> 'incremental'")).unionByName(merged.select(s.files.columns))
    fresh = rebuilt.select(F.lit(server).cast(s.blocks.schema["server"].dataType).alias("server"), F.lit(newest).alias("label"), F.col("file").alias("path"), "blk", "payload")
    kept = s.blocks.join(paths.select("path", F.lit(newest).alias("label"), F.lit(server).cast(s.blocks.schema["server"].dataType).alias("server")), ["server", "label", "path"], "left_anti").select(s.blocks.columns)
    hit = _is(server, newest)
    catalog = s.catalog.withColumn("type", F.when(hit, F.lit("full" if full else "incremental")).otherwise(F.col("type"))).withColumn("parent_label", F.when(hit, F.lit(None if full else ends.old.parent_label).cast("string")).otherwise(F.col("parent_label")))
    return Snapshots(s.version + 1, _with_size(catalog, files, server, newest), files, kept.unionByName(fresh))


def _with_size(catalog: DataFrame, files: DataFrame, server, label: str) -> DataFrame:
    own = _sizes(files.filter(_is(server, label)))
    out = catalog.join(own, ["server", "label"], "left")
    return out.withColumn("size", F.when(_is(server, label), F.coalesce("_size", F.lit(0))).otherwise(F.col("size")).cast(catalog.schema["size"].dataType)).select(catalog.columns)


def without(s: Snapshots, server, label: str, force: bool = False) -> Snapshots:
    """s without a snapshot. A kept one is an error unless forced. A child, the first snapshot that names it as parent, is rolled up with it first, and so is each
    further one. Where the snapshot is valid and a later valid one exists, all that links to its data is linked anew: to what a linked file
    referred to, else the data itself moves to the first snapshot that links to it and the others refer to that one; sizes follow."""
    me = s.catalog.filter(_is(server, label)).first()
    if me is None:
        raise ValueError(f"there is no snapshot {label}")
    if me.keep and not force:
        raise ValueError(f"the snapshot {label} is kept")
    version = s.version + 1
    for child in [r.label for r in s.catalog.filter((F.col("server") == server) & (F.col("parent_label") == label)).select("label").orderBy("label").collect()]:
        s = rolled_up(s, server, child, label)
    dropped = s.files.filter(_is(server, label)).select("path", F.col("ref_label").alias("_deeper"))
    links = s.files.filter((F.col("server") == server) & (F.col("ref_label") == label) & (F.col("label") != label))
    catalog, files, blocks = s.catalog.filter(~_is(server, label)), s.files.filter(~_is(server, label)), s.blocks.filter(~_is(server, label))
    if me.valid and not valid_neighbours(s.catalog.filter(F.col("server") == server)).filter((F.col("label") == label) & F.col("next_valid").isNotNull()).isEmpty():
        heirs = links.groupBy("path").agg(F.min("label").alias("_heir")).join(dropped, "path")
        j = files.join(heirs.withColumn("_s", F.lit(server).cast(s.files.schema["server"].dataType)).withColumnRenamed("path", "_p"), (F.col("server") == F.col("_s")) & (F.col("path") == F.col("_p")) & (F.col("ref_label") == label), "left")
        new = F.when(F.col("_deeper").isNotNull(), F.col("_deeper")).otherwise(F.nullif("_heir", "label"))
        files = j.withColumn("ref_label", F.when(F.col("_heir").isNotNull(), new).otherwise(F.col("ref_label"))).select(s.files.columns)
        moved = s.blocks.filter(_is(server, label)).join(heirs.filter("_deeper IS NULL").select("path", "_heir"), "path").withColumn("label", F.col("_heir")).select(s.blocks.columns)
        blocks = blocks.unionByName(moved)
        own = files.join(links.select("server", "label").distinct(), ["server", "label"], "left_semi")
        catalog = catalog.join(_sizes(own), ["server", "label"], "left").withColumn("size", F.coalesce("_size", "size").cast(s.catalog.schema["size"].dataType)).select(s.catalog.columns)
    return Snapshots(version, catalog, files, blocks)


def roll_up(spark: SparkSession, root: str, server, newest: str, oldest: str | None = None) -> None:
    """Roll a chain up in the store at root; see rolled_up."""
    new = rolled_up(current(spark, root), server, newest, oldest)
    publish(spark, root, new.catalog, new.files, new.blocks, new.version)


def delete(spark: SparkSession, root: str, server, label: str, force: bool = False) -> None:
    """Delete a snapshot from the store at root; see without."""
    new = without(current(spark, root), server, label, force)
    publish(spark, root, new.catalog, new.files, new.blocks, new.version)
