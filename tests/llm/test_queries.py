"""Contract queries against brute force or SQL on small tables."""

import hashlib
import re

import duckdb
import pytest
from tidemark.llm import decontaminate, mixing, pii, queries, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in "documents pages benchmark".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = c.execute(queries.ORACLE_SQL[name])
    at = [[x[0] for x in r.description].index(k) for k in cols]
    assert sorted(str(tuple(x[k] for k in cols)) for x in df.collect()) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m))
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_base_pii(spark):
    texts = ["a@b.c@d.e x_y@z", "a@b.c.x_y@d.e", "1.2.3.4.5 300.1.1.1 0255.1.1.001", "4111 1111 1111 1111-", "é 😀 +1 (555) 010-9999. a@b-c.de", "+12", None, "", "9" * 30_000, "a" * 30_000 + "@", "id: AB12345678"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS row")
    got = {r.doc_id: r.s.split(",") for r in pii.find_pii(df).select("doc_id", pii.listed("spans").alias("s")).collect()}
    for i, t in rows:
        assert [x for x in got.get(i, []) if x and not x.startswith("id:")] == base_spans(t)


def test_contexts_discover(spark):
    rows = [(i, f"please mail user{i}@example.com now") for i in range(30)] + [(100, "please mail agent-7745-x now")]
    got = {r.doc_id: r.s for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert got[100] == "id:12:24"


def test_shapes_seed_and_frequent_words_do_not(spark):
    key = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    rows = [(i, f'the token = "{key(i)}" of the 19{i:02d} house') for i in range(60)] + [(100, 'a token = "short-77x" here'), (101, "of the 1984b house"), (102, f"alone {key('a')}")]
    got = {r.doc_id: r.s for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert got[0] == "id:13:45" and got[100] == "id:11:20" and got[102] == "id:6:38" and 101 not in got and len(got) == 62


def test_warc_magic_inside(spark, tmp_path):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    rows = [(1, "u", inner), (2, None, "x" * 1200), (3, "a b\r\n", "x" * 1200), (4, "u", None), (3, "u", "é" * 600), (None, "u", "short")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = sorted(map(str, warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).select("page_id", "record_type", "refers_to", "payload_digest").collect()))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, "revisit" if p == 2 else "response", 3 if p == 2 else None, sha(h)) for p, _, h in rows]
    assert got == sorted(f"Row(page_id={a}, record_type={b!r}, refers_to={c}, payload_digest={d!r})" for a, b, c, d in want)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(5, None, "s1"), (5, None, "s1"), (7, "a b", "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    a, b = ([tuple(r) for r in mixing.mix_sources(df).drop("row").collect()] for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(rows)
    total = sum(r[3] for r in a)
    taken, target, size = {}, {}, {}
    for _, _, s, n, ss, t, k in a:
        assert k <= 2 * n
        taken[s], target[s], size[s] = taken.get(s, 0) + k, t, ss
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * size[s] for s in taken)


def test_toxicity(spark):
    rows = [(i, " ".join(["plain", f"w{i % 50}", "filth" if i % 4 == 0 else "fine"] * 3)) for i in range(400)] + [(1000, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 400)


def test_short_items_and_cuts(spark):
    b = spark.createDataFrame([("i1", "Alpha beta"), ("i2", " ".join(f"t{i}" for i in range(12))), (None, None), ("i3", "--")], "item_id string, text string")
    d = spark.createDataFrame([(1, "x ALPHA, beta y"), (2, None), (3, "pre " + " ".join(f"t{i}" for i in range(11)) + " post"), (4, "alpha"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.text) for r in decontaminate.find_contamination(d, b, cut=True, group_bytes=10).collect()}
    assert got[1] == (4, 2, ["i1"], "x y") and got[2] == (0, 0, [], None) and got[3] == (13, 11, ["i2"], "pre post") and got[4][1] == 0


def test_many_groups_find_what_one_finds(spark):
    b = spark.createDataFrame([(f"i{k % 7}", " ".join(f"t{(k * 3 + j) % 29}" for j in range(k % 15))) for k in range(40)] + [(None, "t1 t2 t3"), ("x", None), ("y", "")], "item_id string, text string")
    d = spark.createDataFrame([(k, " ".join(f"T{(k + j) % 29}" for j in range(k))) for k in range(40)], "doc_id long, text string")
    one, many = (sorted(map(str, decontaminate.find_contamination(d, b, cut=True, group_bytes=g).collect())) for g in (1 << 20, 40))
    assert one == many and "i3" in str(one)
    none = decontaminate.find_contamination(d, b.limit(0)).collect()
    assert len(none) == 40 and all(r.n_hit == 0 and r["items"] == [] for r in none)
