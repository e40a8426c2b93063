"""Registered queries of the engine's operators over the shaped tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.functions import scalar as X
from tidemark.functions import text as Y
from tidemark.operators import catalog as C
from tidemark.operators import changes as B
from tidemark.operators import metrics as M
from tidemark.operators import snapshots as S
from tidemark.operators import wal
from tidemark.plans import shapes as V
from tidemark.sources import files as R
from tidemark.streaming import log as T

NOW = dt.date(1998, 1, 15)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIFF_ALL = "SELECT * FROM m_diff UNION ALL SELECT 'backup_manifest','changed',NULL FROM (SELECT count(*) c FROM m_diff) WHERE c>0"


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE_SQL[name] = (f"WITH {V.VIEWS} {sql}" if not sql.startswith("RECURSIVE") else f"WITH RECURSIVE {V.VIEWS}, {sql[9:]}").strip()
        return f

    return add


def on(shape: Callable, f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = shape(spark, sf_dir)
        return f(*made) if isinstance(made, tuple) else f(made)

    return run


def _chunked(blocks: DataFrame) -> DataFrame:
    return B.brt_chunks(blocks).withColumn("offsets", F.concat_ws(",", F.transform("offsets", lambda x: x.cast("string"))))


def _all_targets(c: DataFrame) -> DataFrame:
    c = c.withColumn("start_timeline", F.floor(F.col("start_lsn") / 4096) % 5 + 1)
    none = lambda kind: F.lit(None).cast(kind)
    lsn, line, time = F.col("start_lsn") - F.col("start_lsn") % 1000000, F.col("start_timeline"), F.left("label", F.lit(7))
    kinds = [(time, none("long"), none("long")), (none("string"), lsn, none("long")), (none("string"), none("long"), line), (none("string"), lsn, line)]
    t = c.select("server", F.explode(F.array(*[F.struct(a.alias("time"), b.alias("lsn"), d.alias("timeline")) for a, b, d in kinds])).alias("t")).select("server", "t.*")
    ways = F.array(*[F.struct(F.lit(a).cast("long").alias("tli"), F.lit(b).cast("long").alias("parent_tli")) for a, b in ((3, 1), (3, 2), (4, 1), (5, 2), (5, 4))])
    history = c.select("server").distinct().select("server", F.explode(ways).alias("w")).select("server", "w.*", (F.col("w.parent_tli") * 20000000).alias("switch_lsn"))
    return C.resolve_targets(c, t, history)


def _chains(c: DataFrame) -> DataFrame:
    """Chains of each server's newest snapshot that is not full, where they are whole."""
    c = shared.written(c.select("server", "label", "type", "parent_label"))  # read several times, and its parents are a sort of each server
    new = c.filter("type <> 'full'").join(c.select(F.col("label").alias("parent_label")), "parent_label", "left_semi").groupBy("server").agg(F.max("label").alias("newest"))
    return C.label_chains(c, new.withColumn("oldest", F.lit(None).cast("string")), strict=False).select("server", "newest", "label", "depth")


SELECT = "SELECT lsn, prev_lsn, xid, rmgr, tot_len, fpi_len, description"
COLS = ["lsn", "prev_lsn", "xid", "rmgr", "tot_len", "fpi_len", "description"]

query("p1_wal_filter", f"{SELECT} FROM v_wal WHERE prev_lsn>=100000 AND lsn<=900000 AND rmgr IN ('click','view') AND xid IN (1,2,3,5,8,13,21,34)")(
    on(V.v_wal, lambda w: wal.wal_filter(w, ["click", "view"], 100000, 900000, [1, 2, 3, 5, 8, 13, 21, 34]).select(COLS)))
query("p2_wal_filter_objects", f"{SELECT} FROM v_wal WHERE contains(description,'rel 3') OR contains(description,'rel 17')")(on(V.v_wal, lambda w: wal.wal_filter_objects(w, ["rel 3", "rel 17"]).select(COLS)))
query("p3_wal_filter_interactive", f"{SELECT} FROM v_wal WHERE lower(rmgr) IN ('click','error') AND prev_lsn>=5000 AND contains(description,'rel 4')")(
    on(V.v_wal, lambda w: wal.wal_filter_interactive(w, "CLICK, error", 5000, 0, "", "rel 4").select(COLS)))
query("p4_wal_search", """, i AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lsn)-1 AS idx FROM v_wal)
  SELECT file, idx, lsn, 'rmgr,start_lsn,description' AS matched FROM i WHERE rmgr='view' AND lsn>=9000 AND contains(description,'rel 7')""".replace(", i AS", ", i AS", 1))(
    on(V.v_wal, lambda w: wal.wal_search(w, "VIEW", 9000, text="rel 7").withColumn("matched", F.concat_ws(",", "matched"))))
query("p5_op_name", ", ops(rmid,mask,info,op) AS (VALUES (0,1,0,'INSERT'),(0,1,1,'UPDATE'),(1,3,0,'COMMIT'),(1,3,1,'ABORT')) SELECT lsn, op FROM v_wal LEFT JOIN ops ON xid%3=rmid AND (timeline&mask)=info")(
    lambda s, d: wal.with_op(V.v_wal(s, d).withColumn("rmid", F.col("xid") % 3).withColumn("info", F.col("timeline")), s.createDataFrame([(0, 1, 0, "INSERT"), (0, 1, 1, "UPDATE"), (1, 3, 0, "COMMIT"), (1, 3, 1, "ABORT")], "rmid long, mask long, info long, op string")).select("lsn", "op"))
query("p6_record_lengths", "SELECT lsn, fpi_len, tot_len-fpi_len AS rec_len FROM v_wal")(
    on(V.v_wal, lambda w: wal.record_lengths(w.withColumn("blocks", F.array(F.struct((F.col("fpi_len") > 0).alias("has_image"), F.col("fpi_len").alias("bimg_len")), F.struct(F.lit(False).alias("has_image"), F.lit(9).cast("long").alias("bimg_len"))))).select("lsn", "fpi_len", "rec_len")))
query("p7_explode_blocks", "SELECT lsn, block_id, rel+block_id AS rel FROM v_wal, (VALUES (0),(1)) b(block_id)")(
    on(V.v_wal, lambda w: wal.explode_blocks(w.withColumn("blocks", F.array(F.struct(F.col("rel").alias("rel")), F.struct((F.col("rel") + 1).alias("rel")))))))
query("p8_relation_path", "SELECT DISTINCT db, rel, fork, CASE WHEN db=0 THEN 'global/' WHEN db=1 THEN 'pg_tblspc/1700/PG_17/'||db||'/' ELSE 'base/'||db||'/' END||rel||['','_fsm','_vm','_init'][fork+1] AS path FROM v_blocks")(
    on(V.v_blocks, lambda b: b.select("db", "rel", "fork", B.relation_path(F.when(F.col("db") == 0, 1664).when(F.col("db") == 1, 1700).otherwise(1663), F.col("db"), F.col("rel"), F.col("fork")).alias("path")).distinct()))
query("p9_parse_relation_path", "SELECT DISTINCT 'base/'||db||'/'||rel||['','_fsm','_vm','_init'][fork+1]||'.'||(rel%3) AS path, spc, db, rel, fork, rel%3 AS segno FROM v_blocks")(
    on(V.v_blocks, lambda b: B.parse_relation_path(b.select(F.concat(B.relation_path(F.col("spc"), F.col("db"), F.col("rel"), F.col("fork")), F.lit("."), (F.col("rel") % 3).cast("string")).alias("path")).distinct())))
query("p9_all_spaces", "SELECT DISTINCT CASE WHEN db=0 THEN 'global/' WHEN db=1 THEN 'pg_tblspc/1700/PG_17/1/' ELSE 'base/'||db||'/' END||rel||['','_fsm','_vm','_init'][fork+1] AS path, CASE WHEN db=0 THEN 1664 WHEN db=1 THEN 1700 ELSE 1663 END::BIGINT AS spc, db, rel, fork, 0::BIGINT AS segno FROM v_blocks")(
    on(V.v_blocks, lambda b: B.parse_relation_path(b.select(B.relation_path(F.when(F.col("db") == 0, 1664).when(F.col("db") == 1, 1700).otherwise(1663), F.col("db"), F.col("rel"), F.col("fork")).alias("path")).distinct())))
query("p10_wal_limit", f"{SELECT} FROM v_wal ORDER BY lsn LIMIT 100")(on(V.v_wal, lambda w: wal.wal_limit(w, 100).select(COLS)))
query("p11_list_backups", "SELECT server, label, size, type, parent_label FROM v_catalog")(on(V.v_catalog, lambda c: C.list_backups(c, True).select("server", "label", "size", "type", "parent_label")))
query("p12_backup_info", "SELECT server, label, size FROM v_catalog WHERE server=3 ORDER BY label DESC LIMIT 1")(on(V.v_catalog, lambda c: C.backup_info(c, 3, "newest").select("server", "label", "size")))
query("p13_marked_xids", "SELECT xid, min(lsn) AS first_lsn FROM v_wal WHERE rmgr='error' AND xid>0 GROUP BY xid")(on(V.v_wal, lambda w: wal.marked_xids(w, F.col("rmgr") == "error")))
query("p14_known_values", "SELECT DISTINCT description AS value FROM v_wal WHERE starts_with(description,'view rel 1') ORDER BY 1 LIMIT 8")(on(V.v_wal, lambda w: wal.known_values(w, "description", "view rel 1", 8)))
query("p15_double_compression_guard", "SELECT path FROM (SELECT path||CASE WHEN size%4=0 THEN '.gz' WHEN size%4=1 THEN '.aes' ELSE '.txt' END AS path FROM m_all) WHERE NOT regexp_matches(path,'\\.(gz|zstd|lz4|bz2|aes)$')")(
    on(V.v_manifest, lambda m: R.neither_packed_nor_encrypted(m.select(F.concat("path", F.when(F.col("size") % 4 == 0, ".gz").when(F.col("size") % 4 == 1, ".aes").otherwise(".txt")).alias("path")))))
query("j1_translate_oids", "SELECT lsn, coalesce(n_name, CAST(xid%40 AS VARCHAR)) AS name FROM v_wal LEFT JOIN nation ON n_nationkey=xid%40")(
    lambda s, d: wal.translate_oids(V.v_wal(s, d).withColumn("oid40", F.col("xid") % 40), V.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("oid"), F.col("n_name").alias("name")), "oid40", "name").select("lsn", "name"))
query("j2_xact_timestamps", """, x AS (SELECT lsn, xact_ts, unnest([xid, xid+1000]) AS x FROM v_wal WHERE xact_ts IS NOT NULL), t AS (SELECT x, arg_min(xact_ts, lsn) AS t FROM x WHERE x<>0 GROUP BY x)
  SELECT lsn, coalesce(xact_ts, t) AS ts FROM v_wal LEFT JOIN t ON x=xid""")(on(V.v_wal, lambda w: wal.xact_timestamps(w.drop("ts")).select("lsn", "ts")))
query("j3_manifest_diff", DIFF_ALL)(on(V.v_manifests, S.manifest_diff))
query("j4_manifest_check", "SELECT path, coalesce(o.size=n.size,false) AS size_ok, coalesce(o.checksum=n.checksum,false) AS checksum_ok FROM m_old o LEFT JOIN m_new n USING (path)")(on(V.v_manifests, S.manifest_check))
query("j5_verify_files", "SELECT path, CASE WHEN n.checksum IS NULL THEN 'missing' WHEN n.checksum=o.checksum THEN 'ok' ELSE 'failed' END AS status FROM m_old o LEFT JOIN m_new n USING (path)")(
    on(V.v_manifests, lambda o, n: S.verify_files(o.select("path", "checksum"), n, 256, True)))
query("j6_verification_sweep", "SELECT server, label, valid AND coalesce(ok,true) AS valid FROM v_catalog LEFT JOIN (SELECT o_custkey%20 AS server, bool_and(o_totalprice>1000) AS ok FROM orders GROUP BY 1) USING (server)".replace("LEFT JOIN (SELECT", "LEFT JOIN (SELECT", 1).replace("o_custkey%20 AS server, bool_and(o_totalprice>1000) AS ok FROM orders GROUP BY 1) USING (server)", "server, label, size%3<>0 AS ok FROM v_catalog) USING (server,label)"))(
    on(V.v_catalog, lambda c: S.verification_sweep(c, c.select("server", "label", F.when(F.col("size") % 3 != 0, "ok").otherwise("failed").alias("status"))).select("server", "label", "valid")))
query("j7_link_unchanged", "SELECT path, CASE WHEN path NOT IN (SELECT path FROM m_diff WHERE status IN ('added','changed')) THEN 'prev' END AS ref_label FROM m_new")(
    on(V.v_manifests, lambda o, n: S.link_unchanged(n.select("path"), S.manifest_diff(o, n), "prev")))
query("j8_relink_on_delete", "SELECT path, CASE WHEN n.size%3=0 THEN CASE WHEN o.size%2=0 THEN 'deep' END WHEN n.size%3=1 THEN 'other' END AS ref_label FROM m_new n LEFT JOIN m_old o USING (path)")(
    on(V.v_manifests, lambda o, n: S.relink_on_delete(o.select("path", F.when(F.col("size") % 2 == 0, "deep").alias("ref_label")), n.select("path", F.when(F.col("size") % 3 == 0, "gone").when(F.col("size") % 3 == 1, "other").alias("ref_label")), "gone")))
query("j9_dedupe_by_content", "SELECT path, size, checksum FROM m_new SEMI JOIN m_old USING (path,size,checksum)")(on(V.v_manifests, lambda o, n: S.dedupe_by_content(o, n).select("path", "size", "checksum")))
query("j10_backup_relatives", "SELECT c.server, c.label, c.parent_label, k.child_label FROM v_catalog c LEFT JOIN (SELECT server, parent_label, min(label) AS child_label FROM v_catalog WHERE parent_label IS NOT NULL GROUP BY 1,2) k ON k.server=c.server AND k.parent_label=c.label")(on(V.v_catalog, C.backup_relatives))
query("j11_backup_root", """RECURSIVE up AS (SELECT server, label, label AS ancestor, type, parent_label, 0 AS depth FROM v_catalog UNION ALL
  SELECT u.server, u.label, c.label, c.type, c.parent_label, u.depth+1 FROM up u JOIN v_catalog c ON u.server=c.server AND u.parent_label=c.label WHERE u.type<>'full')
  SELECT server, label, arg_max(ancestor, depth) AS root, max(depth) AS depth FROM up GROUP BY 1,2""")(on(V.v_catalog, C.backup_root))
TARGETS = "SELECT DISTINCT server, substr(label,1,6)||'15' AS target FROM v_catalog"
query("j12_resolve_target", f", t AS ({TARGETS}) SELECT t.server, t.target, max(c.label) AS label FROM t LEFT JOIN v_catalog c ON c.server=t.server AND c.valid AND c.label<=t.target GROUP BY 1,2")(
    on(V.v_catalog, lambda c: C.resolve_targets(c, c.select("server", F.concat(F.left("label", F.lit(6)), F.lit("15")).alias("time"))).withColumnRenamed("time", "target")))
query("j12_resolve_all", """, c AS (SELECT server, label, valid, start_lsn, start_lsn//4096%5+1 AS start_timeline FROM v_catalog),
  h AS (SELECT server, tli, parent_tli, parent_tli*20000000 AS switch_lsn FROM (SELECT DISTINCT server FROM c), (VALUES (3,1),(3,2),(4,1),(5,2),(5,4)) t(tli, parent_tli)),
  t AS (SELECT DISTINCT server, CASE WHEN k=0 THEN substr(label,1,7) END AS time, CASE WHEN k IN (1,3) THEN start_lsn-start_lsn%1000000 END AS lsn, CASE WHEN k>=2 THEN start_timeline END AS timeline FROM c, (VALUES (0),(1),(2),(3)) u(k)),
  w AS (SELECT *, timeline AS on_, lsn AS upto FROM t WHERE lsn IS NOT NULL AND timeline IS NOT NULL UNION ALL SELECT t.*, parent_tli, least(lsn, switch_lsn) FROM t JOIN h ON h.server=t.server AND h.tli=t.timeline WHERE lsn IS NOT NULL)
  SELECT t.server, t.time, t.lsn, t.timeline, max(c.label) AS label FROM t LEFT JOIN c ON c.server=t.server AND c.valid AND CASE WHEN t.time IS NOT NULL THEN c.label<=t.time WHEN t.lsn IS NULL THEN c.start_timeline=t.timeline WHEN t.timeline IS NULL THEN c.start_lsn<=t.lsn END
    WHERE t.lsn IS NULL OR t.timeline IS NULL GROUP BY ALL
  UNION ALL SELECT w.server, w.time, w.lsn, w.timeline, max(c.label) FROM w LEFT JOIN c ON c.server=w.server AND c.valid AND c.start_timeline=w.on_ AND c.start_lsn<=w.upto GROUP BY ALL""")(on(V.v_catalog, _all_targets))
query("j11_label_chains", """RECURSIVE a AS (SELECT server, max(label) AS newest FROM v_catalog WHERE type<>'full' AND parent_label IN (SELECT label FROM v_catalog) GROUP BY 1),
  up AS (SELECT a.server, newest, label, type, parent_label, 0 AS depth FROM a JOIN v_catalog c ON c.server=a.server AND c.label=a.newest UNION ALL
  SELECT u.server, u.newest, c.label, c.type, c.parent_label, u.depth+1 FROM up u JOIN v_catalog c ON u.server=c.server AND u.parent_label=c.label WHERE u.type<>'full'),
  whole AS (SELECT server FROM up WHERE type='full') SELECT server, newest, label, depth FROM up WHERE server IN (SELECT server FROM whole)""")(on(V.v_catalog, _chains))
query("j13_remote_reconcile", "SELECT server, label, CASE WHEN size%2=0 THEN 'remote' ELSE 'local' END AS verify FROM v_catalog")(on(V.v_catalog, lambda c: C.remote_reconcile(c, c.filter("size % 2 = 0")).select("server", "label", "verify")))
query("j14_wal_between", """, b AS (SELECT server, label, label AS wal, lead(label) OVER (PARTITION BY server ORDER BY label) AS upto FROM v_catalog WHERE type='full')
  SELECT b.server, b.label, count(s.label) AS segments FROM b LEFT JOIN v_catalog s ON s.server=b.server AND s.label>=b.wal AND (b.upto IS NULL OR s.label<b.upto) GROUP BY 1,2""")(
    on(V.v_catalog, lambda c: C.wal_between(c.select("server", F.col("label").alias("name")), c.filter("type = 'full'").select("server", "label", F.col("label").alias("wal")), 6)))
query("j15_restore_file_plan", "SELECT path, CASE WHEN size%5=0 THEN 'reconstruct' ELSE 'copy' END AS action FROM (SELECT CASE WHEN size%5=0 THEN 'd/INCREMENTAL.'||size ELSE path END AS path, size FROM m_all)")(
    on(V.v_manifest, lambda m: S.restore_file_plan(m.select(F.when(F.col("size") % 5 == 0, F.concat(F.lit("d/INCREMENTAL."), F.col("size").cast("string"))).otherwise(F.col("path")).alias("path")))))
query("a1_rmgr_counts", "SELECT rmgr, count(*) AS n FROM v_wal WHERE prev_lsn>=10000 GROUP BY 1")(on(V.v_wal, lambda w: wal.rmgr_counts(wal.wal_filter(w, start_lsn=10000))))
query("a2_wal_stats", """, s AS (SELECT rmgr, count(*) AS n, sum(tot_len-fpi_len)::BIGINT AS record_size, sum(fpi_len)::BIGINT AS fpi_size, sum(tot_len)::BIGINT AS combined_size FROM v_wal GROUP BY 1)
  SELECT *, round(n*100.0/sum(n) OVER (),6)::DOUBLE AS n_pct, round(record_size*100.0/sum(record_size) OVER (),6)::DOUBLE AS record_size_pct, round(fpi_size*100.0/sum(fpi_size) OVER (),6)::DOUBLE AS fpi_size_pct, round(combined_size*100.0/sum(combined_size) OVER (),6)::DOUBLE AS combined_size_pct FROM s""")(on(V.v_wal, wal.wal_stats))
LIMITS = "e AS (SELECT *, min(limit_block) OVER (PARTITION BY spc,db,rel,fork ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM v_blocks WHERE phase=0), l AS (SELECT * FROM e WHERE low IS NULL OR limit_block<low), m AS (SELECT spc,db,rel,fork,blk,max(lsn) AS last FROM v_blocks WHERE phase=1 AND fork<>1 GROUP BY ALL), s AS (SELECT spc,db,rel,fork,blk FROM m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.db=m.db AND l.rel=m.rel AND l.fork=m.fork AND l.limit_block<=m.blk AND l.lsn>m.last))"
query("a3_summarize_wal", f", {LIMITS} SELECT * FROM s")(on(V.v_blocks, B.summarize))
query("a3_brt_limits", "SELECT spc,db,rel,fork,min(limit_block) AS limit_block FROM v_blocks WHERE phase=0 GROUP BY ALL")(on(V.v_blocks, B.brt_limits))
query("a3_block_events", """, r AS (SELECT event_id AS i, event_type AS e, 14+event_id%5 AS version, user_id%7 AS db, user_id%25 AS rel, event_id%4 AS fork, event_id*7%500 AS blk FROM events),
  x AS (SELECT i AS lsn, 1 AS phase, 1663::BIGINT AS spc, db, rel, (fork+k)%4 AS fork, NULL::BIGINT AS limit_block, blk+k AS blk FROM r, (VALUES (0),(1)) t(k) WHERE e IN ('view','click') AND (fork+k)%4<>1 AND NOT (e='click' AND i%16 IN (0,6,9,14))
  UNION ALL SELECT i, 0, 1663, db, rel, fork, 0, NULL FROM r WHERE e='signup' AND i%2=0 AND fork<>1
  UNION ALL SELECT i, 0, 1663, db, rel, f, blk, NULL FROM r, (VALUES (0,1),(2,2)) t(f,bit) WHERE e='signup' AND i%2=1 AND i%8&bit<>0
  UNION ALL SELECT i, 0, 1663, db, rel, f, 0, NULL FROM r, (VALUES (0),(2),(3)) t(f) WHERE e='error' AND i%8 IN (0,2,3,4)
  UNION ALL SELECT i, 0, 1663, db, 0, 0, 0, NULL FROM r WHERE e='purchase' AND (i%3=0 OR i%3=1 AND version>=15)
  UNION ALL SELECT i, 0, s, db, 0, 0, 0, NULL FROM r, (VALUES (1663),(1700)) t(s) WHERE e='purchase' AND (i%3=2 AND version>=15 OR i%3=1 AND version<15))
  SELECT spc, db, rel, fork, lsn, phase, limit_block, blk FROM x""")(on(V.v_records, B.block_events))
query("a5_brt_packed", "SELECT DISTINCT spc, db, rel, fork, blk FROM (SELECT * FROM v_many UNION ALL SELECT spc, db, rel, fork, blk+blk%1000 FROM v_many)")(
    on(V.v_many, lambda b: B.brt_unpacked(B.brt_union(B.brt_packed(b), B.brt_packed(b.withColumn("blk", F.col("blk") + F.col("blk") % 1000))))))
query("a5_packed_sizes", "SELECT spc, db, rel, fork, blk//32768 AS bucket, count(DISTINCT blk) AS n, least(4096, 2*count(DISTINCT blk)) AS bytes FROM v_many GROUP BY ALL")(
    on(V.v_many, lambda b: B.brt_packed(b).select(*B.KEY, "bucket", "n", F.coalesce(F.octet_length("bits"), F.size("offsets") * 2).cast("long").alias("bytes"))))
query("a8_tree_usage", """RECURSIVE t AS (SELECT regexp_replace('/'||path, '/[^/]*$', '') AS folder, size FROM (SELECT path||'/'||(size%7)||'/f' AS path, size FROM m_all)
  UNION ALL SELECT regexp_replace(folder, '/[^/]*$', ''), size FROM t WHERE folder<>'') SELECT substr(folder,2) AS folder, sum(size)::BIGINT AS total, count(*) AS files, max(size) AS biggest FROM t GROUP BY 1""")(
    on(V.v_manifest, lambda m: C.tree_usage(m.select(F.concat_ws("/", "path", (F.col("size") % 7).cast("string"), F.lit("f")).alias("path"), "size"))))
query("a4_brt_blocks", f", {LIMITS} SELECT * FROM s WHERE blk>=100 AND blk<300")(on(V.v_blocks, lambda b: B.brt_range(B.summarize(b), 100, 300)))
CHUNKED = "SELECT spc,db,rel,fork,blk//65536 AS chunk,count(*) AS n,CASE WHEN count(*)>4095 THEN 'bitmap' ELSE 'array' END AS kind,string_agg((blk%65536)::VARCHAR,',' ORDER BY blk) AS offsets"
query("a5_brt_chunks", f", {LIMITS} {CHUNKED} FROM s GROUP BY spc,db,rel,fork,blk//65536")(on(V.v_blocks, lambda b: _chunked(B.summarize(b))))
query("a5_brt_bitmaps", f"SELECT * FROM ({CHUNKED} FROM v_many GROUP BY spc,db,rel,fork,blk//65536)")(on(V.v_many, lambda b: _chunked(b)))
query("a6_backup_counts", "SELECT server, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid FROM v_catalog GROUP BY 1")(on(V.v_catalog, C.backup_counts))
query("a7_oldest_newest", "SELECT server, min(label) AS oldest, arg_min(size,label) AS oldest_size, max(label) AS newest, arg_max(size,label) AS newest_size FROM v_catalog GROUP BY 1")(on(V.v_catalog, C.oldest_newest))
query("a8_space_usage", "SELECT split_part(path,'/',1) AS server, sum(size)::BIGINT AS total, count(*) AS files, max(size) AS biggest FROM m_all GROUP BY 1")(on(V.v_manifest, lambda m: C.space_usage(m.withColumn("server", F.substring_index("path", "/", 1)))))
query("a9_restore_size", """, t AS (SELECT file, depth, max(blk) AS top FROM ch_b GROUP BY ALL), z AS (SELECT depth::VARCHAR AS label, CASE WHEN kind='incremental' THEN greatest(truncation_len, top+1)*8192 ELSE file*100 END AS sz FROM ch_f JOIN t USING (file,depth))
  SELECT label, sum(sz)::BIGINT AS restore_size, max(sz) AS biggest_file FROM z GROUP BY 1""")(
    on(V.v_chain, lambda f, b: S.restore_size(f.join(b.groupBy("file", "depth").agg(F.max("blk").alias("top")), ["file", "depth"]).select(F.col("depth").cast("string").alias("label"), "kind", "truncation_len", "top", (F.col("file") * 100).alias("size")))))
query("a10_server_status", "SELECT server, count(*) AS n_backups, sum(size)::BIGINT AS total_size, count(*) FILTER (keep) AS n_kept, count(*) FILTER (NOT valid) AS n_invalid, count(*) FILTER (type='full') AS n_full FROM v_catalog GROUP BY 1")(on(V.v_catalog, C.server_status))
query("a11_operation_counters", "SELECT xid, count(*) AS operations, count(*) FILTER (rmgr='error') AS failed, max(ts) AS last_ts, max(ts) FILTER (rmgr='error') AS last_failed_ts FROM v_wal GROUP BY 1")(on(V.v_wal, lambda w: M.operation_counters(w, "xid", F.col("rmgr") == "error")))
query("a12_log_level_counts", "SELECT rmgr AS level, count(*) AS n FROM v_wal GROUP BY 1")(on(V.v_wal, lambda w: M.log_level_counts(w, "rmgr")))
query("a13_median", "SELECT user_id, coalesce(median(value),0.0) AS median FROM v_metrics GROUP BY 1")(on(V.v_metrics, lambda m: M.medians(m, "user_id", "value")))
query("a14_bench_compare", """, a AS (SELECT user_id%7 AS phase, median(value) AS b FROM v_metrics WHERE event_id%2=0 GROUP BY 1), c AS (SELECT user_id%7 AS phase, median(value) AS c FROM v_metrics WHERE event_id%2=1 GROUP BY 1)
  SELECT phase, b AS base, c AS candidate, CASE WHEN b<=0 OR c<=0 THEN 'n/a' WHEN abs(b-c)/b<0.1 THEN 'no change' WHEN c<b THEN printf('%.2fx faster', b/c) ELSE printf('%.2fx slower', c/b) END AS verdict FROM a JOIN c USING (phase)""")(
    on(V.v_metrics, lambda m: M.bench_compare(M.medians(m.filter("event_id % 2 = 0").withColumn("phase", F.col("user_id") % 7), "phase", "value"), M.medians(m.filter("event_id % 2 = 1").withColumn("phase", F.col("user_id") % 7), "phase", "value"))))
query("a16_perf_data", "SELECT 'OK | '||string_agg(rmgr||'='||n, ' ' ORDER BY rmgr||'='||n) AS line FROM (SELECT rmgr, count(*) AS n FROM v_wal GROUP BY 1)")(on(V.v_wal, lambda w: M.perf_data(wal.rmgr_counts(w).select(F.col("rmgr").alias("name"), F.col("n").alias("value")))))
query("a17_manifest_totals", "SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM m_all")(on(V.v_manifest, S.manifest_totals))
query("a18_catalog_gauges", """, g AS (SELECT server, label, size::DOUBLE AS backup_size, valid::INT::DOUBLE AS backup_valid, keep::INT::DOUBLE AS backup_retain, (size*2)::DOUBLE AS backup_restore_size, major_version::DOUBLE AS backup_major_version, start_lsn::DOUBLE AS backup_start_lsn,
  CASE WHEN size=0 THEN 0.0 ELSE size::DOUBLE/(size*2) END AS backup_ratio, (size%60)::DOUBLE AS backup_elapsed_total, round(CASE WHEN size%60=0 THEN 0.0 ELSE size/((size%60)*1e6) END, 4) AS backup_total_mbs FROM v_catalog),
  u AS (SELECT server, label, metric, value FROM g UNPIVOT (value FOR metric IN (backup_size, backup_valid, backup_retain, backup_restore_size, backup_major_version, backup_start_lsn, backup_ratio, backup_elapsed_total, backup_total_mbs)))
  SELECT * FROM u UNION ALL SELECT s, NULL, metric, 0.0 FROM range(25) t(s), (SELECT DISTINCT metric FROM u) WHERE s NOT IN (SELECT DISTINCT server FROM v_catalog)""")(
    lambda s, d: C.catalog_gauges(V.v_catalog(s, d).withColumns({"restore_size": F.col("size") * 2, "elapsed_total": F.col("size") % 60}), s.range(25).select(F.col("id").alias("server"))))
MARK = """, days AS (SELECT strftime(DATE '1998-01-12' - to_days((7*j)::INT),'%Y%m%d') AS day FROM range(4) t(j) UNION SELECT strftime(DATE '1998-01-01' - to_months(j::INT),'%Y%m%d') FROM range(12) t(j) UNION SELECT strftime(DATE '1998-01-01' - to_years(j::INT),'%Y%m%d') FROM range(5) t(j)),
  k AS (SELECT *, row_number() OVER (PARTITION BY server, substr(label,1,8) ORDER BY label DESC) AS rn FROM v_catalog), mk AS (SELECT *, label>='19980108000000' OR (rn=1 AND substr(label,1,8) IN (SELECT day FROM days)) AS marked FROM k)"""
POLICY = {"days": 7, "weeks": 4, "months": 12, "years": 5}
query("w1_retention_mark", f"{MARK} SELECT server, label, marked FROM mk")(on(V.v_catalog, lambda c: C.retention_mark(c, NOW, **POLICY).select("server", "label", "marked")))
query("w2_retention_plan", f"{MARK} SELECT server, min(label) AS label FROM mk WHERE NOT marked AND NOT keep AND (server,label) NOT IN (SELECT (server,parent_label) FROM v_catalog WHERE parent_label IS NOT NULL) GROUP BY 1")(on(V.v_catalog, lambda c: C.retention_plan(c, NOW, **POLICY)))
query("w3_last_n_values", "SELECT name, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_metrics) WHERE rn<=3")(on(V.v_metrics, lambda m: M.last_n_values(m, ["name", "user_id"], 3, "event_id").select("name", "user_id", "event_id")))
query("w4_size_increment", "SELECT server, label, size-coalesce(lag(size) OVER (PARTITION BY server ORDER BY label),0) AS increment FROM v_catalog")(on(V.v_catalog, lambda c: C.size_increment(c).select("server", "label", "increment")))
query("w5_valid_neighbours", "SELECT server, label, max(CASE WHEN valid THEN label END) OVER (PARTITION BY server ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_valid, min(CASE WHEN valid THEN label END) OVER (PARTITION BY server ORDER BY label ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_valid FROM v_catalog")(on(V.v_catalog, C.valid_neighbours))
query("w6_link_base", ", n AS (SELECT server, max(label) AS label, arg_max(major_version,label) AS mv FROM v_catalog GROUP BY 1) SELECT n.server, n.label, max(c.label) AS base FROM n LEFT JOIN v_catalog c ON c.server=n.server AND c.valid AND c.label<n.label AND c.major_version=n.mv GROUP BY 1,2")(on(V.v_catalog, C.link_base))
query("w7_wal_delta", "SELECT server, label, coalesce(start_lsn-lag(start_lsn) OVER (PARTITION BY server ORDER BY label),0) AS wal_delta FROM v_catalog")(on(V.v_catalog, lambda c: C.wal_delta(c).select("server", "label", "wal_delta")))
query("w8_next_lsn", "SELECT lsn, lead(lsn,1,0) OVER (PARTITION BY timeline ORDER BY lsn) AS next_lsn FROM v_wal")(on(V.v_wal, lambda w: wal.next_lsn(w).select("lsn", "next_lsn")))
RECON = ", en AS (SELECT file, min(CASE WHEN kind='full' THEN depth END) AS last, arg_min(truncation_len,depth) AS cut, min(depth) AS newest FROM ch_f GROUP BY 1), rb AS (SELECT file, blk, arg_min(payload,depth) AS payload FROM ch_b JOIN en USING (file) WHERE (last IS NULL OR depth<=last) AND (depth=newest OR blk<cut) GROUP BY 1,2)"
query("w9_reconstruct_blocks", f"{RECON} SELECT * FROM rb")(on(V.v_chain, S.reconstruct_blocks))
query("w9_zero_filled", f"{RECON}, tp AS (SELECT file, greatest(cut, coalesce(max(blk)+1,0)) AS n FROM en LEFT JOIN rb USING (file) GROUP BY file, cut), ev AS (SELECT file, unnest(range(n)) AS blk FROM tp) SELECT file, blk, coalesce(payload,0.0) AS payload FROM ev LEFT JOIN rb USING (file,blk)")(
    on(V.v_chain, lambda f, b: S.zero_filled(f, S.reconstruct_blocks(f, b), F.lit(0.0))))
query("f1_wal_filter_xids", "SELECT lsn, CASE WHEN xid IN (1,5,9) THEN 'XLOG' ELSE rmgr END AS rmgr, xid IN (1,5,9) AS changed FROM v_wal")(on(V.v_wal, lambda w: wal.wal_filter_xids(w, [1, 5, 9]).select("lsn", "rmgr", "changed")))
query("f2_wal_filter_delete", "SELECT lsn, (rmgr='error' AND lsn%1024=0) OR xid IN (SELECT rel FROM v_wal WHERE rmgr='error' AND lsn%1024=0) AS changed FROM v_wal")(on(V.v_wal, lambda w: wal.wal_filter_delete(w, (F.col("rmgr") == "error") & (F.col("lsn") % 1024 == 0), "rel").select("lsn", "changed")))
query("f3_snapshot_rollup", "SELECT path, coalesce(n.checksum,o.checksum) AS checksum FROM m_old o FULL JOIN m_new n USING (path)")(on(V.v_manifests, lambda o, n: S.rollup(o.select(F.lit(1).alias("depth"), "path", "checksum").union(n.select(F.lit(0).alias("depth"), "path", "checksum")))))
query("f4_standby_apply", "SELECT path, checksum FROM m_new")(on(V.v_manifests, lambda o, n: S.standby_apply(o.select("path", "checksum"), n.select("path", "checksum"), S.manifest_diff(o, n))))
query("f5_delete_backup", f", tg AS (SELECT * FROM v_catalog WHERE server=3 AND label='LABEL' AND NOT keep) SELECT c.server, c.label, CASE WHEN t.type='full' THEN 'full' ELSE c.type END AS type, CASE WHEN t.label IS NULL THEN c.parent_label WHEN t.type<>'full' THEN t.parent_label END AS parent_label FROM v_catalog c LEFT JOIN tg t ON t.server=c.server AND t.label=c.parent_label WHERE (c.server,c.label) NOT IN (SELECT (server,label) FROM tg)".replace("label='LABEL'", "label=(SELECT min(label) FROM v_catalog WHERE server=3 AND NOT keep)"))(
    on(V.v_catalog, lambda c: C.delete_backup(c, 3, c.filter("server = 3 AND NOT keep").agg(F.min("label")).first()[0]).select("server", "label", "type", "parent_label")))
query("f6_keep", """RECURSIVE t AS (SELECT max(label) AS l FROM v_catalog WHERE server=3), up AS (SELECT label, type, parent_label FROM v_catalog, t WHERE server=3 AND label=l UNION ALL SELECT c.label, c.type, c.parent_label FROM up u JOIN v_catalog c ON c.server=3 AND c.label=u.parent_label WHERE u.type<>'full')
  SELECT server, label, keep OR (server=3 AND label IN (SELECT label FROM up)) AS keep FROM v_catalog""")(on(V.v_catalog, lambda c: C.keep(c, 3, c.filter("server = 3").agg(F.max("label")).first()[0], True, True).select("server", "label", "keep")))
query("f7_prune_wal", "SELECT label AS name FROM v_catalog WHERE label<'1998'")(on(V.v_catalog, lambda c: C.prune_wal(c.select(F.col("label").alias("name")), "1998")))
query("f8_select_wal", "SELECT label||CASE WHEN size%2=0 THEN '.partial' ELSE '' END AS name, label AS out FROM v_catalog WHERE label>='1995'")(on(V.v_catalog, lambda c: C.select_wal(c.select(F.concat("label", F.when(F.col("size") % 2 == 0, ".partial").otherwise("")).alias("name")), "1995")))
query("f10_incremental_file_size", "SELECT blk, CASE WHEN blk>0 THEN ((((blk+3)*4)+8191)//8192)*8192+blk*8192 ELSE 12 END AS size FROM (SELECT DISTINCT blk FROM ch_b)")(on(V.v_chain, lambda f, b: b.select("blk").distinct().withColumn("size", B.incremental_file_size(F.col("blk")))))
query("f11_refresh_hash", "SELECT path, coalesce(n.checksum,o.checksum) AS checksum FROM m_old o FULL JOIN m_new n USING (path)")(on(V.v_manifests, lambda o, n: S.refresh_hash(o.select("path", "checksum"), n)))
query("f12_merge_lists", "SELECT server, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT server, min(label) AS x FROM v_catalog GROUP BY 1 UNION ALL SELECT server, max(label) FROM v_catalog GROUP BY 1) GROUP BY 1")(
    on(V.v_catalog, lambda c: S.merged_lists(c.groupBy("server").agg(F.min("label").alias("name")), c.groupBy("server").agg(F.max("label").alias("name")), by="server").select("server", F.array_join("names", ",").alias("names"))))
query("f13_build_manifest", "SELECT path, size, checksum FROM m_all")(on(V.v_manifest, lambda m: S.build_manifest(m, 256)))
query("f14_annotate", "SELECT label, CASE WHEN comments LIKE 'k1|%' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN comments LIKE 'k1|%' THEN comments ELSE comments||',k1|new' END AS comments FROM v_catalog")(on(V.v_catalog, lambda c: C.annotate(c, "add", "k1", "new").select("label", "status", "comments")))
query("x1_lsn_text", "SELECT lsn*4294967 AS lsn, upper(to_hex((lsn*4294967)>>32))||'/'||upper(to_hex((lsn*4294967)&4294967295)) AS text, lsn*4294967 AS back FROM v_wal")(
    on(V.v_wal, lambda w: w.select((F.col("lsn") * 4294967).alias("lsn")).withColumn("text", X.lsn_to_string(F.col("lsn"))).withColumn("back", X.string_to_lsn(F.col("text")))))
query("x2_wal_file_name", "SELECT lsn, printf('%08X%08X%08X', timeline, lsn//256, lsn%256) AS name, lsn AS segno FROM v_wal")(on(V.v_wal, lambda w: w.select("lsn", X.wal_file_name(F.col("timeline"), F.col("lsn")).alias("name")).withColumn("segno", X.wal_segno(F.col("name")))))
query("x15_version_number", "SELECT DISTINCT major_version, (13+major_version)*10000+200 AS n FROM v_catalog")(on(V.v_catalog, lambda c: c.select("major_version", X.version_number(F.concat((F.col("major_version") + 13).cast("string"), F.lit(".2"))).alias("n")).distinct()))
query("x18_throughput", "SELECT label, CASE WHEN start_lsn%7=0 THEN 0.0 ELSE size/((start_lsn%7)*1e6) END AS mbs FROM v_catalog")(on(V.v_catalog, lambda c: c.select("label", X.throughput(F.col("size"), F.col("start_lsn") % 7).alias("mbs"))))


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order, a phase for each line of it."""
    li = V.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("seq")).agg(F.sum("l_quantity").alias("elapsed"))
    return li.withColumn("phase", F.when(F.col("seq") == 1, "basebackup").otherwise(F.format_string("p%d", "seq")))


query("w10_phase_weights", """, p AS (SELECT l_orderkey AS job, l_linenumber AS seq, sum(l_quantity) AS elapsed FROM lineitem GROUP BY 1,2),
  r AS (SELECT *, CAST(greatest(1, floor(100*elapsed/sum(elapsed) OVER (PARTITION BY job))) AS BIGINT) AS w FROM p),
  o AS (SELECT *, sum(CASE WHEN seq=1 THEN greatest(w-85,0) ELSE 0 END) OVER (PARTITION BY job) AS over, sum(CASE WHEN seq<>1 THEN w END) OVER (PARTITION BY job) AS others FROM r),
  x AS (SELECT job, seq, CASE WHEN seq=1 THEN least(w,85) ELSE w+CAST(floor(over*w/others) AS BIGINT) END AS w FROM o)
  SELECT job, seq, CAST(CASE WHEN seq=max(seq) OVER (PARTITION BY job) THEN 100-sum(w) OVER (PARTITION BY job)+w ELSE w END AS BIGINT) AS weight FROM x""")(
    on(_phases, lambda p: M.phase_weights(p).select("job", "seq", "weight")))
query("w11_progress_report", """, p AS (SELECT l_orderkey, l_linenumber, l_linenumber*10 AS before, l_linenumber*10+30 AS upto, CAST(l_quantity AS BIGINT) AS done, l_suppkey%60 AS total, l_extendedprice AS elapsed FROM lineitem),
  q AS (SELECT *, least(100, before+CASE WHEN greatest(done,total)>0 THEN floor(done/greatest(done,total)*(upto-before)) ELSE 0 END)::BIGINT AS percent FROM p)
  SELECT l_orderkey, l_linenumber, percent, CASE WHEN percent>0 AND percent<100 THEN elapsed*(100-percent)/percent ELSE 0.0 END AS remaining FROM q""")(
    lambda s, d: M.progress_report(V.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).alias("before"), (F.col("l_linenumber") * 10 + 30).alias("upto"), F.col("l_quantity").cast("long").alias("done"), (F.col("l_suppkey") % 60).alias("total"), F.col("l_extendedprice").alias("elapsed")))
    .select("l_orderkey", "l_linenumber", "percent", "remaining"))
query("a15_metric_categories", """, n AS (SELECT DISTINCT name, string_split(name,'_') AS p FROM v_metrics), px AS (SELECT name, d, array_to_string(p[1:d],'_') AS prefix FROM n, unnest(range(1, least(len(p),4)+1)) t(d)),
  c AS (SELECT prefix, d, count(*)*(1+0.2*d) AS score FROM px GROUP BY 1,2 HAVING count(*)>=2),
  a1 AS (SELECT * FROM c WHERE d=1),
  a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM c WHERE d=2 AND NOT EXISTS (SELECT 1 FROM a1 u WHERE starts_with(c.prefix,u.prefix||'_') AND u.score>=c.score)),
  a3 AS (SELECT * FROM a2 UNION ALL SELECT * FROM c WHERE d=3 AND NOT EXISTS (SELECT 1 FROM a2 u WHERE starts_with(c.prefix,u.prefix||'_') AND u.score>=c.score)),
  a4 AS (SELECT * FROM a3 UNION ALL SELECT * FROM c WHERE d=4 AND NOT EXISTS (SELECT 1 FROM a3 u WHERE starts_with(c.prefix,u.prefix||'_') AND u.score>=c.score))
  SELECT n.name, coalesce(arg_max(a4.prefix,a4.d), any_value(p[1])) AS category FROM n LEFT JOIN px USING (name) LEFT JOIN a4 ON a4.prefix=px.prefix AND a4.d=px.d GROUP BY n.name""")(
    on(V.v_metrics, M.metric_categories))
PLAN = f""", {LIMITS}, lim AS (SELECT spc,db,rel,fork,min(limit_block) AS limit_block FROM v_blocks WHERE phase=0 GROUP BY ALL), ent AS (SELECT DISTINCT spc,db,rel,fork FROM s UNION SELECT spc,db,rel,fork FROM lim),
  f AS (SELECT v_files.*, limit_block, e.rel IS NOT NULL AS entry, segno*200 AS base FROM v_files LEFT JOIN lim USING (spc,db,rel,fork) LEFT JOIN ent e USING (spc,db,rel,fork)),
  g AS (SELECT *, special OR size%8192<>0 OR fork=1 OR (size=0 AND NOT entry) OR coalesce(limit_block<=base,false) AS full_ FROM f)
  SELECT path, CASE WHEN full_ THEN 'full' ELSE 'incremental' END AS kind, CASE WHEN NOT full_ THEN coalesce((SELECT string_agg((blk-base)::VARCHAR,',' ORDER BY blk) FROM s WHERE s.spc=g.spc AND s.db=g.db AND s.rel=g.rel AND s.fork=g.fork AND blk>=base AND blk<base+least(200,size//8192)),'') END AS blocks,
    CASE WHEN NOT full_ THEN greatest(size//8192, coalesce(limit_block-base,0)) END AS truncation_len FROM g"""
query("f9_incremental_plan", PLAN)(
    lambda s, d: B.incremental_plan(V.v_files(s, d).select("path", "size"), B.summarize(V.v_blocks(s, d)), B.brt_limits(V.v_blocks(s, d)), segment_blocks=200)
    .withColumn("blocks", F.when(F.col("blocks").isNotNull(), F.array_join(F.transform("blocks", lambda b: b.cast("string")), ","))))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as a chunk of its length; every fifth is sent twice."""
    c = V.v_wal(spark, sf_dir).select(F.col("timeline").alias("server"), "lsn", F.lit(128).cast("long").alias("len"))
    return c.unionByName(c.filter("lsn % 5 = 0"))


CHUNKS = """, pieces AS (SELECT timeline AS server, lsn//1000 AS segno, lsn%1000 AS start, least(128,1000-lsn%1000) AS len FROM v_wal UNION ALL
  SELECT timeline, lsn//1000+1, 0, lsn%1000+128-1000 FROM v_wal WHERE lsn%1000+128>1000),
segs AS (SELECT server, segno, CAST(sum(len) AS BIGINT) AS received, sum(len)<1000 AS partial FROM pieces GROUP BY 1,2)"""

query("t1_wal_ingest", f"{CHUNKS} SELECT * FROM segs")(on(_chunks, lambda c: T.wal_ingest(c, 1000)))
query("t2_wal_position", f"{CHUNKS} SELECT timeline AS server, max(lsn+128) AS lsn FROM v_wal GROUP BY 1")(on(_chunks, T.wal_position))
query("t3_resume_point", f"{CHUNKS} SELECT server, max(segno)+CASE WHEN arg_max(partial,segno) THEN 0 ELSE 1 END AS segno FROM segs GROUP BY 1")(
    on(_chunks, lambda c: T.resume_point(T.wal_ingest(c, 1000)))
)
query("t4_wal_stats_stream", "SELECT rmgr, count(*) AS count, CAST(sum(tot_len-fpi_len) AS BIGINT) AS record_size, CAST(sum(fpi_len) AS BIGINT) AS fpi_size, CAST(sum(tot_len) AS BIGINT) AS combined_size FROM v_wal GROUP BY 1")(
    on(V.v_wal, T.wal_stats_stream)
)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path with suffixes for each document."""
    d = V.read(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*map(F.lit, ["", ".gz", ".zstd.aes", ".partial", ".tar"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.format_string("%024X", "doc_id"), suffix).alias("path"))


query("s3_file_class", """, f AS (SELECT doc_id, source||'/'||printf('%024X',doc_id)||['','.gz','.zstd.aes','.partial','.tar'][doc_id%5+1] AS path FROM documents)
SELECT doc_id, printf('%024X',doc_id) AS name, 1+[0,2,40,128,64][doc_id%5+1] AS file_class FROM f WHERE path IS NOT NULL""")(
    on(_named, lambda d: d.filter("path IS NOT NULL").select("doc_id", R.base_name(F.col("path")).alias("name"), R.file_class(F.col("path"))))
)
def _texts(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(V.read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def _orders(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(V.read(spark, sf, "orders"))


def _tag() -> Column:
    return F.concat("source", F.lit(" \t"), F.col("doc_id").cast("string"), F.lit('"\n\\'), "lang")


TAG_SQL = "source||' '||chr(9)||doc_id||'\"'||chr(10)||'\\'||lang"

query("x3_is_wal_file", "SELECT doc_id, doc_id%3<>1 AS is_wal, doc_id%3=2 AS partial FROM documents")(
    _texts(lambda d: d.select("doc_id", F.concat(F.format_string("%024X", "doc_id"), F.when(F.col("doc_id") % 3 == 1, "x").when(F.col("doc_id") % 3 == 2, ".partial").otherwise("")).alias("n"))
           .select("doc_id", X.is_wal_file(R.base_name(F.col("n"))).alias("is_wal"), F.col("n").endswith(".partial").alias("partial"))))
query("x4_bytes_text", f"""SELECT o_orderkey, CASE WHEN size>=1048576 THEN CASE WHEN size%1048576=0 THEN (size//1048576)||'MB' ELSE printf('%.1fMB', size/1048576) END WHEN size>=1024 THEN CASE WHEN size%1024=0 THEN (size//1024)||'kB' ELSE printf('%.1fkB', size/1024) END WHEN size=0 THEN '0' ELSE size||'B' END AS one,
  CASE WHEN size>=1048576 THEN printf('%.2fMB', size/1048576) WHEN size>=1024 THEN printf('%.2fkB', size/1024) ELSE printf('%.2fB', size::DOUBLE) END AS two FROM (SELECT o_orderkey, o_orderkey*3+o_custkey*1024 AS size FROM orders)""")(
    lambda s, d: V.read(s, d, "orders").withColumn("size", F.col("o_orderkey") * 3 + F.col("o_custkey") * 1024).select("o_orderkey", X.bytes_to_text(F.col("size")).alias("one"), Y.bytes_to_short_text(F.col("size")).alias("two")))
query("x5_parts_of_text", "SELECT doc_id, coalesce(starts_with(text,'The'),false) AS s, coalesce(ends_with(text,'.'),false) AS e, coalesce(contains(text,'er '),false) AS c FROM documents")(
    _texts(lambda d: d.select("doc_id", Y.starts_with(F.col("text"), "The").alias("s"), Y.ends_with(F.col("text"), ".").alias("e"), Y.contains(F.col("text"), "er ").alias("c"))))
query("x6_removed", """SELECT doc_id, CASE WHEN starts_with(text,'The ') THEN substr(text,5) ELSE text END AS prefix, CASE WHEN ends_with(text,'.') THEN substr(text,1,length(text)-1) ELSE text END AS suffix, substr(text,2) AS first,
  substr(text,1,length(text)-1) AS last, translate(text,' '||chr(9)||chr(13)||chr(10),'') AS white, source||'/a.b' AS ext FROM documents""")(
    _texts(lambda d: d.select("doc_id", Y.remove_prefix(F.col("text"), "The ").alias("prefix"), Y.remove_suffix(F.col("text"), ".").alias("suffix"), Y.remove_first(F.col("text")).alias("first"),
                              Y.remove_last(F.col("text")).alias("last"), Y.remove_whitespace(F.col("text")).alias("white"), X.strip_extension(F.concat("source", F.lit("/a.b.gz"))).alias("ext"))))
query("x7_split_and_escape", f"""SELECT doc_id, array_to_string(list_filter(string_split(text,'e'), lambda x: x<>''),'|') AS parts, doc_id%2=0 AS ten, doc_id%3<>2 AS sixteen, CASE WHEN doc_id%2=0 THEN doc_id::INT ELSE 0 END AS n,
  replace(replace(replace(replace({TAG_SQL},'\\','\\\\'),'"','\\"'),chr(10),'\\n'),chr(9),'\\t') AS escaped, '  '||coalesce(lang,'') AS ind FROM documents""")(
    _texts(lambda d: d.select("doc_id", F.array_join(Y.split_parts(F.col("text"), "e"), "|").alias("parts"), Y.is_number(F.concat(F.lit("-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(".5"))).alias("ten"),
                              Y.is_number(F.concat(F.hex("doc_id"), F.when(F.col("doc_id") % 3 == 2, "g").otherwise("\r\n")), 16).alias("sixteen"), Y.to_int(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" +"), F.col("doc_id").cast("string"), F.lit("x"))).otherwise("99999999999")).alias("n"),
                              Y.escape(_tag()).alias("escaped"), Y.indent(F.col("lang"), 2).alias("ind"))))
query("x8_null_equals_null", "SELECT a.doc_id, a.lang IS NOT DISTINCT FROM CASE WHEN a.doc_id%2=0 THEN 'en' END AS same FROM documents a")(
    _texts(lambda d: d.select("doc_id", Y.same(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "en")).alias("same"))))
query("x9_text_codes", "SELECT doc_id, base64(encode(text)) AS b64, text AS back, length(text) AS chars, NOT regexp_matches(text,'[^\\x00-\\x7F]') AS ascii, true AS utf8, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")(
    _texts(lambda d: d.filter("text IS NOT NULL").select("doc_id", "text", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "").alias("b64"))
           .select("doc_id", "b64", Y.from_base64(F.col("b64")).cast("string").alias("back"), F.char_length("text").cast("long").alias("chars"), Y.is_ascii(F.col("text")).alias("ascii"), Y.is_utf8(Y.from_base64(F.col("b64"))).alias("utf8"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))))
query("x13_times", """SELECT o_orderkey, o_orderdate AS at, strftime(o_orderdate,'%Y%m%d%H%M%S') AS label, printf('%02d:%02d:%07.4f', floor(o_totalprice/3600)::BIGINT, floor(o_totalprice)::BIGINT%3600//60, o_totalprice-60*floor(floor(o_totalprice)/60)) AS elapsed FROM orders""")(
    _orders(lambda o: o.withColumn("label", F.date_format("o_orderdate", "yyyyMMddHHmmss")).select("o_orderkey", X.pg_timestamp(F.unix_micros(F.col("o_orderdate").cast("timestamp")) - F.lit(946684800000000)).cast("timestamp_ntz").alias("at"),
                                                                                                 F.date_format(X.label_time(F.col("label")), "yyyyMMddHHmmss").alias("label"), X.elapsed_text(F.col("o_totalprice")).alias("elapsed"))))
query("x14_time_units", """SELECT o_orderkey, t//60 AS minutes, t//3600 AS hours, t>0 AS valid, (t//86400)||'d' AS days, strftime(make_timestamp(t*1000000),'%Y-%m-%dT%H:%M:%SZ') AS moment FROM (SELECT o_orderkey, o_orderkey*977+o_custkey AS t FROM orders)""")(
    _orders(lambda o: o.withColumn("t", F.col("o_orderkey") * 977 + F.col("o_custkey")).select("o_orderkey", Y.time_convert(F.col("t"), "m").alias("minutes"), Y.time_convert(F.col("t"), "h").alias("hours"), Y.time_is_valid(F.col("t")).alias("valid"),
                                                                                              Y.time_text(F.col("t"), "d").alias("days"), Y.time_text(F.col("t"), "timestamp").alias("moment"))))
query("x16_json_edit", """SELECT event_id, '{"k":'||(props->>'k')||',"a":[1,'||event_id||']}' AS put, '{}' AS removed, true AS has, 2 AS length FROM events""")(
    lambda spark, sf: V.read(spark, sf, "events").withColumn("list", F.concat(F.lit("[1,"), F.col("event_id").cast("string"), F.lit("]")))
    .select("event_id", Y.json_put(F.col("props"), "a", F.col("list")).alias("put"),
            Y.json_remove(F.col("props"), "k").alias("removed"), Y.json_has(F.col("props"), "k").alias("has"), Y.json_length(F.col("list")).alias("length")))
query("x17_collections", """, m AS (SELECT user_id, count(*) FILTER (event_type='click') AS c, count(*) FILTER (event_type='view') AS v, count(*) FILTER (event_type='purchase') AS p, list_sort(list(event_id)) AS ids FROM events GROUP BY 1)
  SELECT user_id, v AS got, 3 AS n, len(ids) AS many, ids[1] AS least, list_contains(ids, user_id) AS own, 'purchase='||p AS found FROM m""")(
    lambda spark, sf: V.read(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view", "purchase")], F.array_sort(F.collect_list("event_id")).alias("ids"))
    .withColumn("m", F.create_map(*[x for k in ("click", "view", "purchase") for x in (F.lit(k), F.col(k))]))
    .select("user_id", F.try_element_at("m", F.lit("view")).alias("got"), F.size("m").alias("n"), F.size("ids").cast("long").alias("many"), F.element_at("ids", 1).alias("least"), F.array_contains("ids", F.col("user_id")).alias("own"),
            F.array_join(F.transform(Y.prefix_search(F.col("m"), "p"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("found")))
query("x19_is_incremental", "SELECT doc_id, doc_id%2=0 AS inc FROM documents")(
    _texts(lambda d: d.select("doc_id", X.is_incremental_path(F.concat(F.lit("INCREMENTAL.d/"), F.when(F.col("doc_id") % 2 == 0, "INCREMENTAL.").otherwise("x"), F.col("doc_id").cast("string"))).alias("inc"))))
query("x16_json_get", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, json_extract(props,'$.none') IS NOT NULL AS has_none FROM events")(
    lambda spark, sf: V.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").isNotNull().alias("has_none"))
)
