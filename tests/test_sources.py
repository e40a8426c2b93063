import bz2
import datetime as dt
import gzip
import io
import random
import tarfile

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tidemark.operators import metrics as M
from tidemark.sources import files as R
from tidemark.sources import sinks as K
from tidemark.streaming import log as T

NAME = "0000000100000000000000"


def tar_of(**members):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return raw.getvalue()


def test_inventory(spark, tmp_path):
    for n in (NAME + "0A", NAME + "0B.partial", NAME + "0C.gz.aes", "00000002.history", "x.tar", "plain"):
        (tmp_path / n).write_bytes(b"1")
    got = {r["name"]: r.file_class for r in R.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {NAME + "0A": 1, NAME + "0B.partial": 129, NAME + "0C.gz.aes": 35, "00000002.history": 0, "x.tar": 64, "plain": 0}
    assert [r["name"][-2:] for r in R.list_wal_segments(spark, str(tmp_path)).collect()] == ["0A", "al", "es"]
    assert R.file_inventory(spark, str(tmp_path), R.TAR).count() == 1


def test_unpacking(spark, tmp_path):
    data = b"some log " * 1000
    (tmp_path / "a.gz").write_bytes(gzip.compress(data) + gzip.compress(data))
    (tmp_path / "b.bz2").write_bytes(bz2.compress(data))
    (tmp_path / "c.zstd").write_bytes(zstandard.compress(data))
    with pa.CompressedOutputStream(str(tmp_path / "f.lz4"), "lz4") as f:
        f.write(data)
    (tmp_path / "d.tar").write_bytes(tar_of(x=data, y=b""))
    (tmp_path / "e.tgz").write_bytes(gzip.compress(tar_of(z=data)))
    got = {r["name"]: bytes(r.content) for r in R.read_compressed(spark, str(tmp_path)).collect()}
    assert got["a"] == data * 2 and got["b"] == got["c"] == got["f"] == data and "e.tar" in got
    assert {(r["name"], bytes(r.content)) for r in R.expand_archives(spark, str(tmp_path)).collect()} == {("x", data), ("y", b""), ("z", data)}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,1\nb,2,3\nc\nd,4\n")
    assert [tuple(r) for r in R.read_manifest_csv(spark, str(tmp_path / "m.csv")).collect()] == [("a", "1"), ("d", "4")]
    with pytest.raises(Exception, match="malformed manifest row"):
        R.read_manifest_csv(spark, str(tmp_path / "m.csv"), strict=True).collect()
    (tmp_path / "m.json").write_text('{"V": 1, "Files": [{"Path": "p", "Size": 3, "Last-Modified": "t", "Checksum-Algorithm": "SHA512", "Checksum": "c"}]}')
    assert R.read_manifest_json(spark, str(tmp_path / "m.json")).first().asDict() == {"Path": "p", "Size": 3, "Last-Modified": "t", "Checksum-Algorithm": "SHA512", "Checksum": "c"}


def test_catalog_timeline_names(spark, tmp_path):
    for label in ("20250102000000", "20250101000000"):
        (tmp_path / "cat" / label).mkdir(parents=True)
        (tmp_path / "cat" / label / "backup.info").write_text(f"LABEL={label}\nCOMMENTS=k|a=b\n\n# x\nKEEP=0\nKEEP=1\n")
    rows = R.read_catalog(spark, str(tmp_path / "cat")).collect()
    assert [r.label for r in rows] == ["20250101000000", "20250102000000"] and rows[0].fields == {"LABEL": "20250101000000", "COMMENTS": "k|a=b", "KEEP": "1"}
    info = "STATUS=1\nLABEL=20250103000000\nBACKUP=77\nELAPSED=1.5\nKEEP=1\nTYPE=1\nPARENT=20250102000000\nSTART_WALPOS=1/A\nEND_WALPOS=x\nMAJOR_VERSION=17\nWAL=\n"
    (tmp_path / "typed" / "20250103000000").mkdir(parents=True)
    (tmp_path / "typed" / "20250103000000" / "backup.info").write_text(info)
    t = R.typed_catalog(R.read_catalog(spark, str(tmp_path / "typed"))).first()
    assert (t.label, t.valid, t.keep, t.backup_size, t.elapsed, t.type, t.parent_label, t.start_lsn, t.end_lsn, t.major_version, t.wal) == ("20250103000000", True, True, 77, 1.5, "incremental", "20250102000000", (1 << 32) + 10, None, 17, None)
    (tmp_path / "00000003.history").write_text("# c\n\n1\t0/2000\tno reason\n2\t1/0000000A\tx\n")
    assert [(r.parent_tli, r.switch_lsn) for r in R.read_timeline_history(spark, str(tmp_path / "00000003.history")).collect()] == [(1, 0x2000), (2, (1 << 32) + 10)]
    (tmp_path / "o.json").write_text('{"databases": [{"one": 5}, {"two": "6"}], "relations": {"7": "seven"}}')
    assert {tuple(r) for r in R.read_oid_mappings(spark, str(tmp_path / "o.json")).collect()} == {("databases", 5, "one"), ("databases", 6, "two"), ("relations", 7, "seven")}


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, checksum string")
    K.write_manifest_csv(m, str(tmp_path / "m"))
    assert sorted(R.read_manifest_csv(spark, str(tmp_path / "m")).collect()) == sorted(m.collect())
    for codec in ("gzip", "zstd", "lz4", "none", "bzip2"):
        K.archive_write(m, str(tmp_path / codec), codec)
        back = spark.read.option("header", "true").csv(str(tmp_path / codec)) if codec == "bzip2" else spark.read.parquet(str(tmp_path / codec))
        assert back.count() == 2
    w = spark.createDataFrame([("heap", 100, 7, 1, 2, "d", 40)], "rmgr string, tot_len long, xid long, prev_lsn long, lsn long, description string, fpi_len long")
    K.write_wal_json(w, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w")).first().asDict() == {"ResourceManager": "heap", "TotalLength": 100, "Xid": 7, "StartLSN": 1, "EndLSN": 2, "Description": "d", "RecordLength": 60}
    more = "rmid int, info int, crc long, xact_ts timestamp, main_data binary, partial boolean"
    full = spark.createDataFrame([(*w.first(), 10, 16, 99, dt.datetime(2024, 1, 2, 3, 4, 5, 6), b"ab", False), (*w.first(), 10, 16, 99, None, None, True)], w.schema.simpleString()[7:-1].replace(":", " ") + ", " + more)
    K.write_wal_json(full, str(tmp_path / "f"))
    got = [{k: v for k, v in r.asDict().items() if v is not None} for r in spark.read.json(str(tmp_path / "f")).orderBy("Partial").collect()]
    assert got[0] == {"ResourceManager": "heap", "TotalLength": 100, "Xid": 7, "StartLSN": 1, "EndLSN": 2, "Description": "d", "RecordLength": 60, "ResourceManagerId": 10, "Info": 16, "Crc": 99, "Timestamp": "2024-01-02 03:04:05.000006", "Data": "YWI="}
    assert got[1] == {"Partial": True}
    K.write_wal_csv(full, str(tmp_path / "c"))
    assert spark.read.option("sep", "|").option("header", "true").csv(str(tmp_path / "c")).count() == 2
    files = spark.createDataFrame([("p", 3, "c", dt.datetime(2024, 1, 2))], "path string, size long, checksum string, modified timestamp")
    K.write_manifest_json(files, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"Path": "p", "Size": 3, "Last-Modified": "2024-01-02 00:00:00 GMT", "Checksum-Algorithm": "SHA256", "Checksum": "c"}
    b = spark.createDataFrame([(1, 2, 3, 0, 9), (1, 2, 3, 0, 4)], "spc long, db long, rel long, fork int, blk long")
    for lo, hi in ((0, 100), (100, 200), (100, 200)):
        K.write_brt(b, str(tmp_path / "brt"), lo, hi)
    assert K.read_brt(spark, str(tmp_path / "brt")).count() == 4 and K.read_brt(spark, str(tmp_path / "brt"), 100, 200).count() == 2
    f = lambda *rows: spark.createDataFrame([(p, s, s.encode()) for p, s in rows], "path string, sha256 string, content binary")
    uri = str(tmp_path / "pub")
    K.publish_snapshot(f(("a", "1"), ("b", "2")), uri, "s", "1")
    K.publish_snapshot(f(("a", "1"), ("b", "3")), uri, "s", "2", "1")
    K.publish_snapshot(f(("a", "1"), ("b", "3"), ("c", "4")), uri, "s", "3", "2")
    assert {(r.path, r.ref_label, r.content is None) for r in spark.read.parquet(f"{uri}/server=s/label=3").collect()} == {("a", "1", True), ("b", "2", True), ("c", None, False)}


def test_streams(spark, tmp_path):
    kind = "server string, lsn long, len long"
    rows = [("s", 90, 30), ("s", 0, 90), ("s", 90, 30), ("t", 250, 10), ("t", 5, 0)]
    spark.createDataFrame(rows, kind).write.json(str(tmp_path / "in"))
    batch = {tuple(r) for r in T.wal_ingest(spark.read.schema(kind).json(str(tmp_path / "in")), 100).collect()}
    assert batch == {("s", 0, 100, False), ("s", 1, 20, True), ("t", 2, 10, True)}
    stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    q = T.wal_ingest(stream, 100).writeStream.outputMode("complete").format("memory").queryName("segments").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("segments").collect()} == batch
    assert {tuple(r) for r in T.resume_point(spark.table("segments")).collect()} == {("s", 1), ("t", 2)}
    assert {tuple(r) for r in T.wal_position(spark.read.schema(kind).json(str(tmp_path / "in"))).collect()} == {("s", 120), ("t", 260)}
    seen = []
    T.on_each_batch(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [5]


def test_encryption(spark):
    df = spark.createDataFrame([(1, b"secret"), (2, b""), (3, None), (4, b"secret")], "id int, content binary")
    for size in (16, 24, 32):
        key = bytes(range(size))
        sealed = K.encrypt_payload(df, key).cache()
        raw = {r.id: r.content for r in sealed.collect()}
        assert raw[1] != raw[4] and b"secret" not in bytes(raw[1]) and raw[3] is None
        assert {r.id: r.content for r in K.decrypt_payload(sealed, key).collect()} == {1: b"secret", 2: b"", 3: None, 4: b"secret"}
        flipped = spark.createDataFrame([(r.id, bytes(r.content[:-1]) + bytes([r.content[-1] ^ 1])) for r in sealed.filter("id < 3").collect()], "id int, content binary")
        for bad, k in ((flipped, key), (sealed.filter("id < 3"), bytes(size))):
            assert [r.content for r in K.decrypt_payload(bad, k, strict=False).collect()] == [None, None]
            with pytest.raises(Exception, match="AES"):
                K.decrypt_payload(bad, k).collect()


def test_metrics_round_trip(spark, tmp_path):
    lines = '# HELP up Is it up\n# TYPE up gauge\nup{server="a \\"b\\" {c}"} 1 1700000000123\nup 0\nother_total 5\n'
    (tmp_path / "m.txt").write_text(lines)
    got = M.parse_metrics(spark.read.text(str(tmp_path / "m.txt")), "e").collect()
    rows = {(r["name"], tuple(sorted(r.labels.items())), r.value, r.type, r.help, r.ts is not None) for r in got}
    assert rows == {("up", (("endpoint", "e"), ("server", 'a "b" {c}')), "1", "gauge", "Is it up", True), ("up", (("endpoint", "e"),), "0", "gauge", "Is it up", False), ("other_total", (("endpoint", "e"),), "5", None, None, False)}
    s = spark.createDataFrame([("up", "gauge", "h", {"b": "2", "a": "1"}, "1"), ("up", "gauge", "h", {}, "0")], "name string, type string, help string, labels map<string,string>, value string")
    K.write_metrics(s, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["#HELP up h", "#TYPE up gauge", "up 0", 'up{a="1",b="2"} 1']


def test_names_over_jdbc(spark):
    url = "jdbc:derby:memory:names;create=true"
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = c.createStatement().executeUpdate
    for table, column in (("pg_tablespace", "spcname"), ("pg_database", "datname"), ("pg_class", "relname")):
        run(f"create table {table} (oid bigint, {column} varchar(20))")
        run(f"insert into {table} values ({len(table)}, '{column}')")
    got = {tuple(r) for r in R.read_oid_mappings_jdbc(spark, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).collect()}
    assert got == {("tablespaces", 13, "spcname"), ("databases", 11, "datname"), ("relations", 8, "relname")}


def test_series_stream(spark, tmp_path):
    kind = "name string, labels map<string,string>, ts timestamp, value string"
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)
    first = [("up", {"a": "1", "b": "2"}, at(k), str(k)) for k in range(8)] + [("down", {}, at(1), "x"), (None, {}, at(1), "x")]
    second = [("up", {"b": "2", "a": "1"}, at(k), str(k)) for k in (20, 3, 9)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, kind).coalesce(1).write.json(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    out = []
    q = T.metric_series_stream(stream, 5).writeStream.outputMode("update").foreachBatch(lambda df, k: out.append({(r["name"], r.labels): r.samples for r in df.collect()})).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    seen = {k: v for batch in out for k, v in batch.items()}
    assert seen == {("up", '{"a":"1","b":"2"}'): ["5", "6", "7", "9", "20"], ("down", "{}"): ["x"]}


def test_block_stream(spark, tmp_path):
    from tidemark.operators import changes

    kind = "spc long, db long, rel long, fork long, lsn long, phase int, limit_block long, blk long"
    r = random.Random(4)
    rows = [(1, 1, r.randrange(2), r.choice([0, 0, 1]), k, *((0, r.randrange(40), None) if r.random() < 0.2 else (1, None, r.randrange(40)))) for k in range(300)]
    r.shuffle(rows)  # batches come in any order
    for k in range(4):
        spark.createDataFrame(rows[k * 75 : k * 75 + 75], kind).coalesce(1).write.json(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    assert T.brt_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    want = {tuple(x) for x in changes.summarize(spark.createDataFrame(rows, kind)).collect()}
    assert {tuple(x) for x in T.brt_so_far(spark, str(tmp_path / "store")).collect()} == want


def test_retention_runs(spark, tmp_path):
    rows = [("s", f"2024010{k}000000", False, True, None) for k in range(1, 8)]
    catalog = spark.createDataFrame(rows, "server string, label string, keep boolean, valid boolean, parent_label string")
    gone = []
    run = T.retention_runs(lambda: catalog.filter(~F.col("label").isin(gone or [""])), lambda plan: gone.extend(r.label for r in plan.collect()), lambda: dt.date(2024, 1, 9), days=4)
    spark.range(3).write.parquet(str(tmp_path / "ticks"))
    for k in range(6):
        T.on_each_batch(spark.readStream.schema("id long").parquet(str(tmp_path / "ticks")), run, str(tmp_path / f"cp{k}")).awaitTermination(60)
    assert gone == [f"2024010{k}000000" for k in range(1, 5)]
    assert T.ticks(spark).isStreaming
