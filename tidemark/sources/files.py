"""Readers of snapshot and log folders: inventories, manifests, catalogs, timelines, names, archives and compressed files.

Folders are listed and read by Spark, so any store that Spark reads will do. Python code only sees one file's bytes at a time, in
archives and compressed files.
"""

from __future__ import annotations

import bz2
import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import string_to_lsn

#: The bit of each class of file and the suffixes that tell it.
WAL, GZIP, LZ4, ZSTD, BZ2, AES, TAR, PARTIAL = (1 << k for k in range(8))
SUFFIXES = {GZIP: ["gz"], LZ4: ["lz4"], ZSTD: ["zstd", "zst"], BZ2: ["bz2"], AES: ["aes"], TAR: ["tar", "tgz"], PARTIAL: ["partial"]}
ALL_SUFFIXES = "|".join(s for suffixes in SUFFIXES.values() for s in suffixes)
META = ["path", "length", "modificationTime"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """The name without any suffixes of compression, encryption, archives and partial files."""
    return F.regexp_replace(file_name(path), rf"(\.({ALL_SUFFIXES}))+$", "")


def file_class(path: Column) -> Column:
    """Sum of the class bits that a file's suffixes and its name tell."""
    tail = F.split(F.regexp_extract(file_name(path), rf"((?:\.(?:{ALL_SUFFIXES}))+)$", 1), r"\.")
    out = F.when(base_name(path).rlike("^[0-9A-Fa-f]{24}$"), WAL).otherwise(0)
    for bit, suffixes in SUFFIXES.items():
        out = out + F.when(F.arrays_overlap(tail, F.array(*map(F.lit, suffixes))), bit).otherwise(0)
    return out.alias("file_class")


def file_inventory(spark: SparkSession, folder: str, mask: int = 0, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, name, file_class); with a mask only files that have one of its bits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select(META)
    out = files.select(*META, file_name(F.col("path")).alias("name"), file_class(F.col("path")))
    return out.filter(F.col("file_class").bitwiseAND(F.lit(mask)) != 0) if mask else out


def neither_packed_nor_encrypted(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose suffixes tell of no compression and no encryption yet, so that neither is applied twice."""
    return files.filter(file_class(F.col(path)).bitwiseAND(F.lit(GZIP | LZ4 | ZSTD | BZ2 | AES)) == 0)


def list_wal_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of a folder by name; timeline histories are left out."""
    files = file_inventory(spark, folder, WAL, recursive=False)
    return files.filter(~F.col("name").endswith(".history")).orderBy("name")


def read_manifest_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, checksum). Rows without exactly two columns are left out, or raise an error where strict."""
    bad = "_bad"
    rows = spark.read.schema(f"path string, checksum string, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
    wrong = F.col(bad).isNotNull() | F.col("checksum").isNull()
    if strict:
        rows = rows.withColumn("checksum", F.when(wrong, F.raise_error(F.concat(F.lit("malformed manifest row: "), F.coalesce(bad, "path")))).otherwise(F.col("checksum")))
        return rows.select("path", "checksum")
    return rows.filter(~wrong).select("path", "checksum")


#: One flat JSON object at the end of a text: names, numbers and quoted strings with escapes.
_OBJECT = r'\{(?:[^"{}]|"(?:[^"\\]|\\.)*+")*+\}$'


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, item, value): the flat objects, without objects in them, of the JSON documents at path, in order, each as text.

    A document is split wherever a brace closes, so that tasks read byte ranges of it, however long its lines are. Whether such a
    brace ends an object or stands in a string depends on the quotes before it: each range counts its own, a table of one row a range
    carries the parity on, and pieces that end within a string are put together with the next.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    pieces = spark.read.option("lineSep", "}").text(path).select(*place, F.monotonically_increasing_id().alias("row"), "value")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', "")) % 2
    inside = W.partitionBy("file", "range").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    p = pieces.withColumn("odd", F.sum(quotes).over(inside) % 2)
    ranges = p.groupBy("file", "range").agg(F.max_by("odd", "row").alias("odd"), F.count_if(F.col("odd") == 0).alias("even"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carry = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    ranges = ranges.select("file", "range", carry.alias("flip"), F.when(carry == 0, F.col("even")).otherwise(F.col("n") - F.col("even")).alias("ends"))
    ranges = ranges.withColumn("ended", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    p = p.join(ranges, ["file", "range"]).withColumn("end", ((F.col("odd") + F.col("flip")) % 2 == 0).cast("long"))
    item = F.col("ended") + F.coalesce(F.sum("end").over(W.partitionBy("file", "range").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = p.withColumn("item", item).groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("range", "row", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    return parts.select("file", "item", F.regexp_extract(text, _OBJECT, 0).alias("value")).filter("value <> ''")


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item of the array Files, read by many tasks; see json_objects. Objects without a Path, such as those of other
    arrays, are no files."""
    item = "`Path` string, `Size` bigint, `Last-Modified` string, `Checksum-Algorithm` string, `Checksum` string"
    return json_objects(spark, path).select(F.from_json("value", item).alias("f")).select("f.*").filter("Path IS NOT NULL")


def read_catalog(spark: SparkSession, folder: str, info: str = "backup.info") -> DataFrame:
    """(label, fields) of each snapshot folder: key=value lines as a map, label the folder's name. A later equal key wins."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", info).text(folder)
    at = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    pairs = lines.select(at.alias("label"), F.monotonically_increasing_id().alias("n"), F.regexp_extract("value", r"^\s*([^=#\s]+)\s*=", 1).alias("k"), F.regexp_extract("value", r"=(.*)$", 1).alias("v"))
    last = pairs.filter("k <> ''").groupBy("label", "k").agg(F.max_by("v", "n").alias("v"))
    return last.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields")).orderBy("label")


#: Fixed names: the keys of a snapshot's information file that the catalog reads, and the columns and types that they become.
CATALOG_FIELDS = {
    "STATUS": ("status", "int"), "LABEL": ("label", "string"), "WAL": ("wal", "string"), "BACKUP": ("backup_size", "long"), "RESTORE": ("restore_size", "long"), "BIGGEST_FILE": ("biggest_file_size", "long"),
    "ELAPSED": ("elapsed", "double"), "MAJOR_VERSION": ("major_version", "int"), "MINOR_VERSION": ("minor_version", "int"), "KEEP": ("keep", "int"), "COMMENTS": ("comments", "string"),
    "TYPE": ("type", "int"), "PARENT": ("parent_label", "string"), "COMPRESSION": ("compression", "int"), "ENCRYPTION": ("encryption", "int"),
    "START_TIMELINE": ("start_timeline", "int"), "END_TIMELINE": ("end_timeline", "int"),
    "BASEBACKUP_ELAPSED": ("elapsed_basebackup", "double"), "MANIFEST_ELAPSED": ("elapsed_manifest", "double"), "HASH_ELAPSED": ("elapsed_hash", "double"), "LINKING_ELAPSED": ("elapsed_linking", "double"),
    "COMPRESSION_ZSTD_ELAPSED": ("elapsed_compression_zstd", "double"), "COMPRESSION_GZIP_ELAPSED": ("elapsed_compression_gzip", "double"), "COMPRESSION_BZIP2_ELAPSED": ("elapsed_compression_bzip2", "double"),
    "COMPRESSION_LZ4_ELAPSED": ("elapsed_compression_lz4", "double"), "ENCRYPTION_ELAPSED": ("elapsed_encryption", "double"), "REMOTE_SSH_ELAPSED": ("elapsed_remote_ssh", "double"),
    "REMOTE_S3_ELAPSED": ("elapsed_remote_s3", "double"), "REMOTE_AZURE_ELAPSED": ("elapsed_remote_azure", "double"),
}
CATALOG_POSITIONS = {"START_WALPOS": "start_lsn", "END_WALPOS": "end_lsn", "CHKPT_WALPOS": "checkpoint_lsn"}


def typed_catalog(catalog: DataFrame) -> DataFrame:
    """The rows of read_catalog with a column for each known field: positions as numbers, keep and valid as booleans, type as full or
    incremental, times of the phases as elapsed_*, and tablespaces as an array of (number, name, oid, path) in order of their numbers. What a file lacks,
    or is no such value, is null; fields holds all as they stand."""
    text = lambda k: F.try_element_at("fields", F.lit(k))
    out = {name: F.nullif(F.trim(text(k)), F.lit("")).try_cast(kind) for k, (name, kind) in CATALOG_FIELDS.items()}
    out |= {name: string_to_lsn(F.trim(text(k))) for k, name in CATALOG_POSITIONS.items()}
    out |= {"label": F.coalesce(out["label"], F.col("label")), "keep": out["keep"] == 1, "valid": out.pop("status") == 1, "type": F.when(out["type"] == 0, "full").when(out["type"] == 1, "incremental")}
    numbers = F.transform(F.filter(F.map_keys("fields"), lambda k: k.rlike("^TABLESPACE[0-9]+$")), lambda k: F.substring(k, 11, 9).cast("int"))
    of = lambda key, n: F.trim(F.try_element_at(F.col("fields"), F.concat(F.lit(key), n.cast("string"))))
    one = lambda n: F.struct(n.alias("number"), of("TABLESPACE", n).alias("name"), of("TABLESPACE_OID", n).try_cast("long").alias("oid"), of("TABLESPACE_PATH", n).alias("path"))
    return catalog.select(*[c.alias(name) for name, c in out.items()], F.transform(F.array_sort(numbers), one).alias("tablespaces"), "fields")


def read_timeline_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, parent_tli, switch_lsn): blanks and lines of # are skipped."""
    shape = r"^\s*([0-9]+)\s+([0-9A-Fa-f]+)/([0-9A-Fa-f]+)"
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & F.col("value").rlike(shape))
    half = lambda k: F.conv(F.regexp_extract("value", shape, k), 16, 10).cast("long")
    return lines.select(file_name(F.col("_metadata.file_path")).alias("file"), F.regexp_extract("value", shape, 1).cast("long").alias("parent_tli"), F.shiftleft(half(2), 32).bitwiseOR(half(3)).alias("switch_lsn"))


def read_oid_mappings(spark: SparkSession, path: str) -> DataFrame:
    """(kind, oid, name) of the sections tablespaces, databases and relations: lists of {name: oid}, or one object {oid: name}."""
    doc = spark.read.text(path, wholetext=True)
    parts = []
    for kind in ("tablespaces", "databases", "relations"):
        text = F.get_json_object("value", f"$.{kind}")
        listed = doc.filter(text.startswith("[")).select(F.explode(F.from_json(text, "array<map<string,string>>")).alias("m")).select(F.explode("m").alias("name", "oid"))
        keyed = doc.filter(text.startswith("{")).select(F.explode(F.from_json(text, "map<string,string>")).alias("oid", "name"))
        parts.append(listed.unionByName(keyed).select(F.lit(kind).alias("kind"), F.col("oid").cast("long").alias("oid"), "name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Fixed queries: the objects of a server's catalog tables.
OID_QUERIES = {"tablespaces": "SELECT oid, spcname AS name FROM pg_tablespace", "databases": "SELECT oid, datname AS name FROM pg_database", "relations": "SELECT oid, relname AS name FROM pg_class"}


def read_oid_mappings_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> DataFrame:
    """(kind, oid, name) as read_oid_mappings, from a server's own tables."""
    read = lambda q: spark.read.jdbc(url, f"({q}) q", properties=properties or {})
    parts = []
    for kind, q in OID_QUERIES.items():
        df = read(q)
        parts.append(df.toDF(*[c.lower() for c in df.columns]).select(F.lit(kind).alias("kind"), F.col("oid").cast("long").alias("oid"), F.col("name").cast("string").alias("name")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unpacked(name: str, raw: bytes) -> tuple[str, bytes]:
    """Name and bytes of a file without its outer compression."""
    stem, _, suffix = name.rpartition(".")
    if suffix == "gz" or suffix == "tgz":
        # members follow one another
        out, left = [], raw
        while left:
            d = zlib.decompressobj(31)
            out.append(d.decompress(left) + d.flush())
            left = d.unused_data
        return stem + (".tar" if suffix == "tgz" else ""), b"".join(out)
    if suffix == "bz2":
        return stem, bz2.decompress(raw)
    if suffix in ("zst", "zstd"):
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as r:
            return stem, r.read()
    if suffix == "lz4":
        import pyarrow as pa

        return stem, pa.CompressedInputStream(pa.BufferReader(raw), "lz4").read()
    return name, raw


def open_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            name, data = unpacked(path, raw)
            yield pd.DataFrame({"path": [path], "name": [name.rsplit("/", 1)[-1]], "content": [data]})


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            with tarfile.open(fileobj=io.BytesIO(unpacked(path, raw)[1])) as tar:
                for m in tar:
                    if m.isfile():
                        yield pd.DataFrame({"path": [path], "name": [m.name], "content": [tar.extractfile(m).read()]})


def read_compressed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content) of each file, unpacked by its suffix; others stay as they are. A file must fit a task's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(open_files, "path string, name string, content binary")


def expand_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content) of each regular member of the tar archives of a folder, compressed ones included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    tars = files.filter(F.col("path").rlike(r"\.(tgz|tar(\.(gz|bz2|zst|zstd|lz4))?)$"))
    return tars.select("path", "content").mapInPandas(_members, "path string, name string, content binary")
