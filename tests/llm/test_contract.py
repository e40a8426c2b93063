"""The registered queries themselves, column by column, against brute force: on the smallest given tables and on odd ones."""

import hashlib
import re
from collections import Counter

import pytest
from tidemark.llm import queries as Q

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that no table has; operators use these names within.
CLASH = ["1 AS node", "2 AS text_key", "3 AS row", "4 AS spans", "5 AS kind", "6 AS size", "7 AS bucket", "8 AS score", "9 AS of", "'x' AS sound"]
LONG = "the quick brown fox jumps over the lazy dog " * 30_000
TEXTS = [
    None, "", " \n\t", "one", "One two", "a@b.c 10.0.0.1 4111 1111 1111 1111 +1 555 010 9999",
    "mail x@y.example or 192.168.1.1, 1.2.3.4.5 and 300.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112 x@y", "é 😀 ñandú " * 60, LONG, LONG + "end",
    "copy of this text " * 40, "copy of this text " * 40, "COPY of this text " * 40, "x" * 5000, "x" * 5000,
]


def odd_rows():
    rows = [(i, t, "en", ["a", None, "b", "c"][i % 4], len(t or "")) for i, t in enumerate(TEXTS)]
    return [*rows, (5, TEXTS[5], "en", "b", 1), (5, TEXTS[5], None, "b", 1), (6, "other text with this id", "en", "a", 2), (None, TEXTS[6], "en", "a", 0), (None, "no id", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session", params=["given", "odd", "empty"])
def tables(request, spark, tmp_path_factory):
    """A folder of tables, and the rows of documents."""
    if request.param == "given":
        return SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    at = str(tmp_path_factory.mktemp(request.param))
    rows = odd_rows() if request.param == "odd" else []
    spark.createDataFrame(rows, COLUMNS).selectExpr("*", *CLASH).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, i % 2, int(i == 7)) for i in range(12)] if rows else []
    spark.createDataFrame([*labels, *([(None, 1, 1), (99, 0, 1)] if rows else [])], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [("i1", "one two"), ("i2", "quick brown fox jumps over the lazy dog the quick"), ("i2", None), (None, "mail x")] if rows else []
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "u", "x" * 1200), (2, None, "x" * 1200), (2, "v", None), (None, "w", "x" * 1200), (3, "u", ""), (4, "u", "é" * 600)] if rows else []
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS d", "2 AS payload", "3 AS first").write.parquet(f"{at}/pages.parquet")
    return at, rows


def run(spark, name, tables, *columns):
    return Counter(tuple(r[c] for c in columns) for r in Q.QUERIES[name](spark, tables[0]).collect())


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_op4(spark, tables):
    want, rows = Counter(), {}
    for i, t, *_ in tables[1]:
        s = base_spans(t)
        n = Counter(k for k, _, _ in s)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
        rows.setdefault(i, set()).add(",".join(f"{k}:{a}:{b}" for k, a, b in s))
    assert run(spark, "op4_pii", tables, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    for (i, spans), _ in run(spark, "op4_pii", tables, "doc_id", "spans").items():
        parts = spans.split(",") if spans else []
        assert ",".join(x for x in parts if not x.startswith("id:")) in rows[i]


def words(t, pattern=SPACE):
    return re.findall(pattern, t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def covered(sequences, k):
    """Of each sequence the places inside windows of k that start anywhere else too."""
    seen = Counter(s[i : i + k] for s in sequences for i in range(len(s) - k + 1))
    out = []
    for s in sequences:
        hit, upto = bytearray(len(s)), 0
        for i in range(len(s) - k + 1):
            if seen[s[i : i + k]] > 1:
                hit[max(i, upto) : i + k] = b"\1" * (i + k - max(i, upto))
                upto = i + k
        out.append(hit)
    return out


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op1(spark, tables):
    rows = [(i, tuple(words(t))) for i, t, *_ in tables[1]]
    want = Counter()
    for (i, w), hit in zip(rows, covered([w for _, w in rows], 35), strict=True):
        want[(i, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit, strict=True) if not h).encode()))] += 1
    assert run(spark, "op1_substring_dedup", tables, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op2(spark, tables):
    pages = [tuple(r) for r in spark.read.parquet(f"{tables[0]}/pages.parquet").select("page_id", "html").collect()]
    first = {}
    for p, h in pages:
        first[h or ""] = max(first.get(h or "", -1), -1 if p is None else p)
    want = Counter()
    for p, h in pages:
        raw = (h or "").encode()
        to = first[h or ""] if len(raw) >= 1000 and first[h or ""] != p else None
        want[(p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert run(spark, "op2_warc", tables, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def shingles(t, k):
    w = words(lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(1, len(w)))))


def test_op3(spark, tables):
    rows = [(i, shingles(t, 3)) for i, t, *_ in tables[1]]
    distinct = sorted({s for _, s in rows if s}, key=lambda s: (len(s), hash(s)))
    label = {s: s for s in distinct}

    def root(s):
        while label[s] is not s:
            s = label[s]
        return s

    for a in range(len(distinct)):
        for b in range(a + 1, len(distinct)):
            if len(distinct[b]) * 9 > len(distinct[a]) * 10:
                break
            n = len(distinct[a] & distinct[b])
            if 100 * n >= 90 * (len(distinct[a]) + len(distinct[b]) - n):
                label[root(distinct[a])] = root(distinct[b])
    least = {}
    for i, s in rows:
        if s and i is not None:
            least[root(s)] = min(least.get(root(s), i), i)
    want = Counter((i, len(s), least.get(root(s), i) if s else i) for i, s in rows)
    assert run(spark, "op3_ngram_jaccard", tables, "doc_id", "n_shingles", "component_id") == want


def test_op5(spark, tables):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER)), 0, Counter()
    for i, text in sorted(((r[0], r[1]) for r in tables[1]), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert run(spark, "op5_token_ids", tables, "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op6(spark, tables):
    """One row each, in range, agreeing with itself; equal texts score alike, so no id or label plays a part."""
    import zlib

    got = Q.QUERIES["op6_toxicity"](spark, tables[0]).collect()
    texts = {}
    for i, t, *_ in tables[1]:
        texts.setdefault(i, []).append(t)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in tables[1])
    scores = {}
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if len(texts[r.doc_id]) == 1:
            assert abs(scores.setdefault(texts[r.doc_id][0] or "", r.score) - r.score) < 1e-6  # sums of floats, in blocks of any texts
    again = Counter((r.doc_id, r.score) for r in Q.QUERIES["op6_toxicity"](spark, tables[0]).collect())
    assert Counter((i, round(s, 4)) for i, s in again.elements()) == Counter((r.doc_id, round(r.score, 4)) for r in got)


def water_levels(sizes):
    """Targets of sources in their order: 150% of all words by weight, none above twice its source."""
    from fractions import Fraction

    weight = [Fraction((5, 2, 1)[k % 3]) for k in range(len(sizes))]
    target, left, free = [None] * len(sizes), Fraction(3 * sum(sizes), 2), set(range(len(sizes)))
    while free:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if level * weight[k] >= 2 * sizes[k]}
        for k in over or free:
            target[k] = Fraction(2 * sizes[k]) if over else level * weight[k]
        left -= sum(target[k] for k in over)
        free = free - over if over else set()
    return target


def test_op7(spark, tables):
    size = {}
    for _, t, _, s, _ in tables[1]:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, water_levels([size[s] for s in order]), strict=True))
    got = Q.QUERIES["op7_mixing"](spark, tables[0]).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, len(words(t)), size[s]) for i, t, _, s, _ in tables[1])
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        near = [s for s in order if size[s] == r.source_size and abs(float(target[s]) - r.target) < 1e-6 * max(1, r.target)]
        assert near
        taken[near[0]] = taken.get(near[0], 0) + r.taken
    assert all(abs(taken[s] - float(target[s])) <= 1 for s in taken)
    again = Q.QUERIES["op7_mixing"](spark, tables[0]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_op8(spark, tables):
    kind = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [tuple(r) for r in spark.read.parquet(f"{tables[0]}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for item, t in items:
        w = words(lower(t), kind)
        for i in range(max(len(w) - 9, min(1, len(w)))):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(None if item is None else str(item))
    lengths, want = {len(w) for w in windows}, Counter()
    for i, t, *_ in tables[1]:
        w, hit, found = tuple(words(lower(t), kind)), set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if w[a : a + k] in windows:
                    hit.update(range(a, a + k))
                    found |= windows[w[a : a + k]]
        found.discard(None)
        want[(i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))] += 1
    assert run(spark, "op8_decontaminate", tables, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op9(spark, tables):
    import zlib

    want = Counter()
    for i, t, *_ in tables[1]:
        raw = (t or "").encode()
        pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[(i, len(raw), len(pay), sha(pay), zlib.crc32(pay[-16:]))] += 1
    assert run(spark, "op9_audio", tables, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    by_text = {}
    for r in run(spark, "op9_audio", tables, "payload_sha256", "media_bytes", "media_sha256", "feature"):
        by_text.setdefault(r[0], set()).add(r)
    assert all(len(x) == 1 for x in by_text.values())


def test_op10(spark, tables):
    rows = [(i, (t or "").encode()) for i, t, *_ in tables[1]]
    want = Counter()
    for (i, raw), hit in zip(rows, covered([r for _, r in rows], 400), strict=True):
        runs = len(re.findall(b"\1+", bytes(hit)))
        want[(i, len(raw), sum(hit), runs, sha(bytes(x for x, h in zip(raw, hit, strict=True) if not h)))] += 1
    assert run(spark, "op10_suffix_dedup", tables, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
