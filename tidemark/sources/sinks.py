"""Writers: decoded records, manifests, archives, block tables and published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators.metrics import write_metrics as metric_lines

#: Names of the record fields as readers of the JSON form expect them, and the columns they come from.
RECORD_FIELDS = {
    "ResourceManager": "rmgr", "TotalLength": "tot_len", "Xid": "xid", "Info": "info", "StartLSN": "prev_lsn", "EndLSN": "lsn", "ResourceManagerId": "rmid", "Crc": "crc", "Description": "description",
}
KEY = ["spc", "db", "rel", "fork"]


def record_fields(records: DataFrame) -> DataFrame:
    """Decoded records with the fields of the written form: RecordLength is without block images, Data base64, Timestamp a
    transaction's end as text. Of a partial record only Partial is set. A column that records lack gives null."""
    texts = ("rmgr", "description")
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    out = {name: has(c, "string" if c in texts else "long") for name, c in RECORD_FIELDS.items()}
    out["RecordLength"] = F.col("tot_len") - F.col("fpi_len")
    out["Timestamp"] = F.date_format(has("xact_ts", "timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    out["Data"] = F.base64(has("main_data", "binary"))
    partial = F.coalesce(has("partial", "boolean"), F.lit(False))
    return records.select(*[F.when(~partial, c).alias(name) for name, c in out.items()], F.when(partial, partial).alias("Partial"))


def write_wal_json(records: DataFrame, path: str) -> None:
    """One JSON object a line for each record."""
    record_fields(records).write.mode("overwrite").json(path)


def write_wal_csv(records: DataFrame, path: str) -> None:
    """The same fields, separated by bars."""
    record_fields(records).write.mode("overwrite").option("sep", "|").option("header", "true").csv(path)


def write_manifest_csv(manifest: DataFrame, path: str) -> None:
    manifest.select("path", "checksum").write.mode("overwrite").csv(path)


def write_manifest_json(files: DataFrame, path: str, algorithm: str = "SHA256") -> None:
    """A table of JSON objects with Path, Size, Last-Modified, Checksum-Algorithm and Checksum, of files (path, size, checksum and, if
    they have it, modified): one object a line, so that a manifest of any size is written by many tasks."""
    modified = F.date_format(F.col("modified"), "yyyy-MM-dd HH:mm:ss 'GMT'") if "modified" in files.columns else F.lit(None).cast("string")
    files.select(
        F.col("path").alias("Path"), F.col("size").cast("long").alias("Size"), modified.alias("Last-Modified"), F.lit(algorithm).alias("Checksum-Algorithm"), F.col("checksum").alias("Checksum")
    ).write.mode("overwrite").json(path)


def encrypt_payload(df: DataFrame, key: bytes, column: str = "content") -> DataFrame:
    """column by AES in mode GCM with a key of 16, 24 or 32 bytes, each value under a nonce of its own. Null stays null."""
    return df.withColumn(column, F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM")))


def decrypt_payload(df: DataFrame, key: bytes, column: str = "content", strict: bool = True) -> DataFrame:
    """The reverse. Changed bytes or another key are an error; where not strict, they give null."""
    f = F.aes_decrypt if strict else F.try_aes_decrypt
    return df.withColumn(column, f(F.col(column), F.lit(key), F.lit("GCM")))


def write_metrics(samples: DataFrame, path: str) -> None:
    """Exposition lines of (name, type, help, labels, value) as text, in order of names."""
    metric_lines(samples).write.mode("overwrite").text(path)


def archive_write(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """df as Parquet with the codec gzip, zstd, lz4 or none; as CSV with bzip2, which Parquet lacks."""
    if codec == "bzip2":
        df.write.mode("overwrite").option("compression", codec).option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_brt(blocks: DataFrame, path: str, start_lsn: int, end_lsn: int) -> None:
    """Modified blocks of one range of the log, in order of their keys; writing the range again replaces it."""
    blocks.repartitionByRange(*KEY, "blk").sortWithinPartitions(*KEY, "blk").write.mode("overwrite").parquet(f"{path}/start_lsn={start_lsn}/end_lsn={end_lsn}")


def read_brt(spark: SparkSession, path: str, start_lsn: int = 0, end_lsn: int | None = None) -> DataFrame:
    """Blocks of the ranges that lie within the bounds; only their folders are read."""
    out = spark.read.parquet(path).filter(F.col("start_lsn") >= start_lsn)
    return out if end_lsn is None else out.filter(F.col("end_lsn") <= end_lsn)


def publish_snapshot(files: DataFrame, uri: str, server: str, label: str, previous: str | None = None) -> None:
    """Write (path, sha256, content) under server and label; a file that the snapshot previous holds with an equal sha256 becomes a
    reference (ref_label, no content). References to a reference name the snapshot that has the content."""
    spark, at = files.sparkSession, lambda of: f"{uri}/server={server}/label={of}"
    new = files.select("path", "sha256", "content")
    if previous is None:
        out = new.withColumn("ref_label", F.lit(None).cast("string"))
    else:
        try:
            old = spark.read.parquet(at(previous))
        except AnalysisException as e:
            raise ValueError(f"no published snapshot {previous} of {server}") from e
        old = old.select("path", "sha256", F.coalesce("ref_label", F.lit(previous)).alias("ref_label"))
        out = new.join(old, ["path", "sha256"], "left").withColumn("content", F.when(F.col("ref_label").isNull(), F.col("content")))
    out.write.mode("errorifexists").parquet(at(label))
