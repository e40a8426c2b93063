"""The engine's tables shaped from the given ones, in plain column arithmetic; VIEWS says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def v_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    fpi = F.when(F.col("event_type") == "view", k * 8).otherwise(F.lit(0).cast("long"))
    lsn = F.lit(4096) + F.col("event_id") * 128
    return read(spark, sf_dir, "events").select(
        lsn.alias("lsn"), (lsn - 128).alias("prev_lsn"), F.col("user_id").alias("xid"), F.col("event_type").alias("rmgr"), fpi.alias("fpi_len"), (F.lit(64) + k + fpi).alias("tot_len"),
        F.concat(F.col("event_type"), F.lit(" rel "), (F.col("user_id") % 25).cast("string")).alias("description"), F.col("ts"),
        F.format_string("%06d", F.floor(F.col("event_id") / 1000).cast("long")).alias("file"), (F.col("event_id") % 3).alias("timeline"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("xact_ts"),
        F.array((F.col("user_id") + 1000).cast("long")).alias("subxacts"), (F.col("user_id") % 25).alias("rel"), (F.col("user_id") % 4).alias("db"),
    )


def v_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    limit = F.col("event_type") == "error"
    return e.select(
        F.lit(1663).cast("long").alias("spc"), (F.col("user_id") % 4).alias("db"), (F.col("user_id") % 25).alias("rel"), (F.col("event_id") % 4).alias("fork"), F.col("event_id").alias("lsn"),
        F.when(limit, 0).otherwise(1).alias("phase"), F.when(limit, F.col("event_id") * 13 % 500).alias("limit_block"), F.when(~limit, F.col("event_id") * 7 % 500).alias("blk"),
    )


def v_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded log records with the payloads of storage, transaction and database operations."""
    i, e, fork, blk = F.col("event_id"), F.col("event_type"), F.col("event_id") % 4, F.col("event_id") * 7 % 500
    db, rel, spc = F.col("user_id") % 7, F.col("user_id") % 25, F.lit(1663).cast("long")
    version = (14 + i % 5).cast("int")
    word = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c.cast("long")), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    data = lambda *cs: F.unhex(F.concat(*map(word, cs)))
    drop = F.when(version >= 15, i % 3 == 2).otherwise(i % 3 == 1)
    main = (
        F.when((e == "signup") & (i % 2 == 0), data(spc, db, rel, fork)).when(e == "signup", data(blk, spc, db, rel, i % 8))
        .when((e == "purchase") & drop, data(db, F.lit(2), spc, F.lit(1700))).when(e == "purchase", data(db, spc, F.lit(0), F.lit(0)))
    )
    rmid = F.when(e == "signup", 2).when(e == "error", 1).when(e == "purchase", 4).when(e == "click", 0).otherwise(10)
    info = F.when(e == "signup", F.when(i % 2 == 0, 0x10).otherwise(0x20)).when(e == "purchase", i % 3 * 16).otherwise(i % 16 * 16).cast("int")
    block = lambda k: F.struct(spc.alias("spc"), db.alias("db"), rel.alias("rel"), ((fork + k) % 4).cast("int").alias("fork"), (blk + k).alias("blk"), F.lit(False).alias("has_image"), F.lit(0).alias("bimg_len"))
    rels = F.when(e == "error", F.array(F.struct(spc.alias("spc"), db.alias("db"), rel.alias("rel"))))
    return read(spark, sf_dir, "events").select(
        i.alias("lsn"), version.alias("version"), F.lit(False).alias("partial"), rmid.alias("rmid"), info.alias("info"), main.alias("main_data"), rels.alias("dropped_rels"),
        F.when(e.isin("view", "click"), F.array(block(0), block(1))).alias("blocks"),
    )


def v_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest of all documents."""
    d = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return d.select("path", F.sha2("content", 256).alias("checksum"), F.octet_length("content").cast("long").alias("size"), "content")


def v_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relations: one with every other block of a few chunks, one with few blocks in many."""
    odd = F.col("event_id") % 2
    return read(spark, sf_dir, "events").select(
        F.lit(1663).cast("long").alias("spc"), F.lit(5).cast("long").alias("db"), odd.alias("rel"), F.lit(0).cast("long").alias("fork"), F.when(odd == 1, F.col("event_id")).otherwise(F.col("event_id") * 13).alias("blk")
    )


def v_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segment files of every relation fork of v_blocks, and two files of no relation."""
    fork = F.element_at(F.array(*map(F.lit, ["", "_fsm", "_vm", "_init"])), (F.col("fork") + 1).cast("int"))
    b = v_blocks(spark, sf_dir).select("spc", "db", "rel", "fork").distinct().select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("segno"))
    path = F.concat(F.lit("base/"), F.col("db").cast("string"), F.lit("/"), F.col("rel").cast("string"), fork, F.when(F.col("segno") > 0, F.concat(F.lit("."), F.col("segno").cast("string"))).otherwise(""))
    size = (F.col("rel") * 31 + F.col("db") * 7 + F.col("segno")) % 200 * 8192 + F.when(F.col("rel") % 11 == 10, 5).otherwise(0)
    others = spark.createDataFrame([("global/pg_control", 8192), ("base/1/PG_VERSION", 3)], "path string, size long")
    return b.select(path.alias("path"), size.cast("long").alias("size")).unionByName(others)


def v_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    old = d.filter("doc_id % 10 <> 0").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
    salted = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 7 <> 0").select("path", F.sha2(salted.cast("binary"), 256).alias("checksum"), F.octet_length(salted).cast("long").alias("size"), salted.cast("binary").alias("content"))
    return old, new


def v_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    c = o.select(
        (F.col("o_custkey") % 20).alias("server"), F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.format_string("%09d", F.col("o_orderkey"))).alias("label"), F.floor("o_totalprice").cast("long").alias("size"),
        (F.col("o_orderstatus") != "F").alias("valid"), F.col("o_orderpriority").startswith("1").alias("keep"), F.when(F.col("o_orderkey") % 5 == 0, "full").otherwise("incremental").alias("type"),
        (F.col("o_orderkey") * 4096).alias("start_lsn"), (F.col("o_orderkey") % 3).alias("major_version"), F.concat(F.lit("k"), (F.col("o_orderkey") % 2).cast("string"), F.lit("|v,z|1")).alias("comments"),
    )
    w = W.partitionBy("server").orderBy("label")
    return c.withColumn("parent_label", F.when(F.col("type") != "full", F.lag("label").over(w)))


def v_chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, blocks) of snapshot chains: the fifth and later snapshots of a file are full."""
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_linenumber").cast("long").alias("depth"), (F.col("l_suppkey") % 50).alias("blk")).agg(F.max("l_extendedprice").alias("payload"))
    f = b.select("file", "depth").distinct().select("*", F.when(F.col("depth") >= 5, "full").otherwise("incremental").alias("kind"), ((F.col("file") + F.col("depth")) % 40).alias("truncation_len"))
    return f, b


def v_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat_ws("_", F.col("event_type"), F.element_at(F.array(F.lit("total"), F.lit("size"), F.lit("time_ms")), (F.col("event_id") % 3 + 1).cast("int")), (F.col("user_id") % 7).cast("string")).alias("name"),
        F.col("user_id"), F.col("value"), F.col("ts"), F.col("event_id"), F.col("event_type"),
    )


VIEWS = r"""
v_wal AS (SELECT 4096+event_id*128 AS lsn, 4096+event_id*128-128 AS prev_lsn, user_id AS xid, event_type AS rmgr,
  CASE WHEN event_type='view' THEN CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)*8 ELSE 0 END AS fpi_len,
  64+CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)+CASE WHEN event_type='view' THEN CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)*8 ELSE 0 END AS tot_len,
  event_type||' rel '||(user_id%25) AS description, ts, printf('%06d', event_id//1000) AS file, event_id%3 AS timeline,
  CASE WHEN event_type='purchase' THEN ts END AS xact_ts, user_id%25 AS rel, user_id%4 AS db FROM events),
v_blocks AS (SELECT 1663::BIGINT AS spc, user_id%4 AS db, user_id%25 AS rel, event_id%4 AS fork, event_id AS lsn, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS phase,
  CASE WHEN event_type='error' THEN event_id*13%500 END AS limit_block, CASE WHEN event_type<>'error' THEN event_id*7%500 END AS blk FROM events),
m_all AS (SELECT source||'/'||doc_id AS path, sha256(text) AS checksum, strlen(text) AS size FROM documents),
v_many AS (SELECT 1663::BIGINT AS spc, 5::BIGINT AS db, event_id%2 AS rel, 0::BIGINT AS fork, CASE WHEN event_id%2=1 THEN event_id ELSE event_id*13 END AS blk FROM events),
v_files AS (SELECT 'base/'||db||'/'||rel||['','_fsm','_vm','_init'][fork+1]||CASE WHEN segno>0 THEN '.'||segno ELSE '' END AS path, CAST((rel*31+db*7+segno)%200*8192+CASE WHEN rel%11=10 THEN 5 ELSE 0 END AS BIGINT) AS size, false AS special, spc, db, rel, fork, segno
  FROM (SELECT DISTINCT spc,db,rel,fork FROM v_blocks), (VALUES (0::BIGINT),(1::BIGINT)) t(segno) UNION ALL VALUES ('global/pg_control',8192,true,NULL,NULL,NULL,NULL,0), ('base/1/PG_VERSION',3,true,NULL,NULL,NULL,NULL,0)),
m_old AS (SELECT source||'/'||doc_id AS path, sha256(text) AS checksum, strlen(text) AS size FROM documents WHERE doc_id%10<>0),
m_new AS (SELECT source||'/'||doc_id AS path, sha256(CASE WHEN doc_id%5=0 THEN text||'x' ELSE text END) AS checksum, strlen(CASE WHEN doc_id%5=0 THEN text||'x' ELSE text END) AS size FROM documents WHERE doc_id%7<>0),
m_diff AS (SELECT path, CASE WHEN n.checksum IS NULL THEN 'deleted' WHEN o.checksum IS NULL THEN 'added' ELSE 'changed' END AS status, coalesce(o.checksum,n.checksum) AS checksum
  FROM m_old o FULL JOIN m_new n USING (path) WHERE o.checksum IS DISTINCT FROM n.checksum),
c0 AS (SELECT o_custkey%20 AS server, strftime(o_orderdate + to_seconds(o_orderkey%86400),'%Y%m%d%H%M%S')||'-'||printf('%09d',o_orderkey) AS label, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus<>'F' AS valid,
  o_orderpriority LIKE '1%' AS keep, CASE WHEN o_orderkey%5=0 THEN 'full' ELSE 'incremental' END AS type, o_orderkey*4096 AS start_lsn, o_orderkey%3 AS major_version, 'k'||(o_orderkey%2)||'|v,z|1' AS comments FROM orders),
v_catalog AS (SELECT *, CASE WHEN type<>'full' THEN lag(label) OVER (PARTITION BY server ORDER BY label) END AS parent_label FROM c0),
ch_b AS (SELECT l_partkey AS file, l_linenumber::BIGINT AS depth, l_suppkey%50 AS blk, max(l_extendedprice) AS payload FROM lineitem GROUP BY ALL),
ch_f AS (SELECT DISTINCT file, depth, CASE WHEN depth>=5 THEN 'full' ELSE 'incremental' END AS kind, (file+depth)%40 AS truncation_len FROM ch_b),
v_metrics AS (SELECT event_type||'_'||['total','size','time_ms'][event_id%3+1]||'_'||(user_id%7) AS name, user_id, value, ts, event_id, event_type FROM events)
"""
