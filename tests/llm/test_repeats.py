import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tidemark.llm import repeats as R

ODD = [(None, "a b"), (1, None), (2, ""), (3, " \t\n"), (4, "x" * 5000), (5, "one two three"), (5, "one two three"), (6, "é é é é é é é é")]


def brute_words(rows, k):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1))
    out = []
    for (doc_id, _), d in zip(rows, docs, strict=True):
        hit = set()
        for i in range(len(d) - k + 1):
            if seen[tuple(d[i : i + k])] > 1:
                hit.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(d) if i not in hit)
        out.append((doc_id, len(d), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def brute_bytes(rows, k):
    docs = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + k] for d in docs for i in range(len(d) - k + 1))
    out = []
    for (doc_id, _), d in zip(rows, docs, strict=True):
        hit = bytearray(len(d))
        for i in range(len(d) - k + 1):
            if seen[d[i : i + k]] > 1:
                hit[i : i + k] = b"\1" * k
        runs = len(re.findall(b"\1+", bytes(hit)))
        out.append((doc_id, len(d), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(d, hit, strict=True) if not h)).hexdigest()))
    return Counter(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["alpha", "beta", "ñandú", "d", "Éa", "zz."]
    word = lambda: r.choice(vocab) if r.random() < 0.3 else f"w{r.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = list(ODD)
    for i in range(n):
        t = [word() for _ in range(r.randrange(0, 90))]
        if r.random() < 0.4:
            a = r.randrange(40)
            at = r.randrange(len(t) + 1)
            t[at:at] = passage[a : a + r.randrange(5, 50)]
        rows.append((10 + i, r.choice([" ", "\n", "  "]).join(t)))
        if r.random() < 0.1:
            rows.append((1000 + i, rows[-1][1]))
    rows.append((3000, "por " * 30 + "osos " * 40 + "a b c a b c a b c a b c a b c a b c a b c a b c"))
    rows.append((3001, "xyz " * 9))
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"bucket_bytes": 2000, "chunk_bytes": 700}), (3, {"bucket_bytes": 1 << 30, "chunk_bytes": 500})])
def test_words(spark, seed, sizes):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS bucket").repartition(5)
    got = R.substring_dedup(df, 12, 3, **sizes).select("doc_id", "n_tokens", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 12)


@pytest.mark.parametrize(("seed", "length", "sizes"), [(4, 40, {}), (5, 37, {"bucket_bytes": 2000, "chunk_bytes": 900}), (6, 5, {})])
def test_bytes(spark, seed, length, sizes):
    rows = corpus(seed, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = R.suffix_dedup(df, length, 8, **sizes).select("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, length)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.substring_dedup(df).collect() == [] == R.suffix_dedup(df).collect()


@pytest.mark.parametrize("length", [160, 400])
def test_coded_digits_group_as_bytes_do(length, monkeypatch):
    rng = np.random.default_rng(length)
    base = rng.integers(97, 99, 2500).astype(np.uint8)
    data = np.concatenate([base[a : a + 900] for a in rng.integers(0, 1600, 12)] + [np.full(1000, 97, np.uint8)])
    at, pos = np.arange(len(data)), np.arange(len(data) - length + 1)
    w = R.Windows(length, 48, False)
    windows = [data[i : i + length].tobytes() for i in pos]
    times = Counter(windows)

    def sets_of(group):
        out = defaultdict(set)
        for i, g in enumerate(group.tolist()):
            if g >= 0:
                out[g].add(windows[i])
        assert all(len(s) == 1 for s in out.values())
        assert len(out) == len({w for s in out.values() for w in s})
        return {i for i, g in enumerate(group.tolist()) if g >= 0}

    want = {i for i, x in enumerate(windows) if times[x] > 1}
    assert sets_of(R._by_radix(w, data, at, at + 1, pos)) == want
    # codes that tell nothing apart are found out, and the bytes decide
    monkeypatch.setattr(R, "_codes", lambda data: np.zeros(len(data), np.uint64))
    assert sets_of(R._by_radix(w, data, at, at + 1, pos)) == want


def hot_corpus(seed, n=90):
    """A line that all texts hold, a passage that a third of them hold, and copies."""
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    line, passage = text(180), text(900)
    rows = [(None, None), (1, ""), (1, "short")]
    for i in range(n):
        rows.append((10 + i, text(r.randrange(700)) + line + text(r.randrange(700)) + (passage[r.randrange(300) :] if i % 3 == 0 else "")))
        if i % 10 == 0:
            rows.append((r.choice([None, 10 + i, 5000 + i]), rows[-1][1]))
    return rows


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_overgrown_buckets(spark, levels):
    """One bucket for all, read in many chunks: windows go on through every level, and what is left by digest."""
    rows = hot_corpus(levels)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = {"bucket_bytes": 1 << 30, "chunk_bytes": 3000, "levels": levels}
    got = R.suffix_dedup(df, 400, 48, **sizes).select("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 400)
    words = [(i, t and " ".join(t[j : j + 3] for j in range(0, len(t), 3))) for i, t in rows]
    got = R.substring_dedup(spark.createDataFrame(words, "doc_id long, text string").repartition(6), 35, 6, **sizes)
    assert Counter(map(tuple, got.select("doc_id", "n_tokens", "n_removed", "kept_sha256").collect())) == brute_words(words, 35)


@pytest.mark.parametrize("label", [R._by_hash, R._by_radix])
def test_a_lone_window_is_alone(label):
    data = np.frombuffer(b"abcdefghij " * 50, np.uint8)
    at = np.arange(len(data))
    for length in (5, 200):
        assert label(R.Windows(length, 4, False), data, at, at + 1, np.array([3])).tolist() == [-1]
        assert label(R.Windows(length, 4, False), data, at, at + 1, np.empty(0, np.int64)).tolist() == []


def test_clashing_hashes_of_words(monkeypatch):
    """With hashes that tell nothing apart the words decide."""
    monkeypatch.setattr(R.X, "spans", lambda pre, start, end: np.zeros(len(start), np.uint64))
    words = "a b c a b c d e f a b c x y".split()
    data = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
    starts, ends, _ = R.X.words(data, np.array([0, len(data)]))
    got = R._by_hash(R.Windows(3, 2, True), data, starts, ends, np.arange(12)).tolist()
    windows = [tuple(words[i : i + 3]) for i in range(12)]
    assert [g >= 0 for g in got] == [windows.count(x) > 1 for x in windows]
    assert all((got[i] == got[j]) == (windows[i] == windows[j]) for i in range(12) for j in range(12) if got[i] >= 0 and got[j] >= 0)


def test_a_shared_passage_of_over_50_words_goes_from_400_bytes_on(spark):
    """The contract counts bytes, neither words nor characters: 60 words of 399 bytes stay, 400 go."""
    fills = {"short": "x" * 40, "long": "x" * 41, "wide": "x" * 39 + "é"}
    passages = {name: " ".join(f"{name[0]}{i:04d}" for i in range(60)) + fill for name, fill in fills.items()}
    assert {name: (len(p.split()), len(p), len(p.encode())) for name, p in passages.items()} == {"short": (60, 399, 399), "long": (60, 400, 400), "wide": (60, 399, 400)}
    rows = [(10 * i + j, f"{a}{p}{b}") for i, p in enumerate(passages.values()) for j, (a, b) in enumerate(("[]", "()", "<>"))]
    got = R.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_tokens", "n_removed", "n_spans").collect()
    want = {0: (401, 0, 0), 1: (402, 400, 1), 2: (402, 400, 1)}
    assert {r[0]: tuple(r[1:]) for r in got} == {10 * i + j: want[i] for i in want for j in range(3)}
