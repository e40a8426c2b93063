"""The Merkle manifest, the phrase collocations and the lattice scores against brute force: as registered queries, and with other parameters."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_contract import lower, run, sha, tables, words  # noqa: F401
from tidemark.llm import lattice, merkle, phrases
from tidemark.llm import queries as Q


def leaf_of(row, add=0):
    i, t, lang, source, n = row
    values = (i, source, lang, None if n is None else n + add, t)
    return sha(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values))


def climbed(leaves, k):
    """All levels of a tree, and of each leaf (left, right) siblings on the way up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([sha("".join(nodes[i : i + k]).encode()) for i in range(0, len(nodes), k)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for nodes in levels[:-1]:
            start = i // k * k
            way.append((nodes[start:i], nodes[i + 1 : start + k]))
            i //= k
        ways.append(way)
    return levels[-1][0], ways


def manifest(rows, k):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    below = {x: climbed([leaf_of(r) for r in trees[x]], k) for x in order}
    root, above = climbed([below[x][0] for x in order], k) if order else (None, [])
    for x, top in zip(order, above, strict=True):
        for r, way in zip(trees[x], below[x][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf_of(r, int(tampered))
            for left, right in way + top:
                digest = sha("".join([*left, digest, *right]).encode())
            siblings = [s for left, right in way + top for s in left + right]
            yield r[0], leaf_of(r), below[x][0], root, sha("".join(siblings).encode()), digest, digest == root


def test_op11(spark, tables):  # noqa: F811
    assert run(spark, "op11_merkle", tables, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == Counter(manifest(tables[1], 2))


@pytest.mark.parametrize(("fanout", "levels"), [(3, 1), (5, 2)])
def test_manifest_of_several_rounds(spark, tables, fanout, levels):  # noqa: F811
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    values = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.leaf_digest(values))
    got = merkle.merkle_manifest(docs, changed, fanout=fanout, levels=levels).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, sha("".join(r.siblings).encode()), r.folded_root, r.verified) for r in got) == Counter(manifest(tables[1], fanout))


def test_states_are_resumed():
    leaves = [sha(bytes([i])).encode() for i in range(11)]
    tree = merkle.Parents(leaves, 3, 3)
    for i in range(11):
        assert tree.fold(i, leaves[i]) == tree.top
        other = [*leaves[:i], b"0" * 64, *leaves[i + 1 :]]
        assert tree.fold(i, b"0" * 64) == merkle.Parents(other, 3, 3).top != tree.top


def best_phrases(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        out = []
        for p, a in candidates.items():
            if 100 * most[p] < 80 * a:
                score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                out.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, p.decode(), -a, x, y, n[lang], -score


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_op12(spark, tables):  # noqa: F811
    assert run(spark, "op12_phrases", tables, *PHRASE) == Counter(best_phrases(tables[1], 2000, 30))


@pytest.mark.parametrize(("top", "least", "step"), [(3, 2, 1), (25, 3, 2)])
def test_frontier_settles(spark, tables, top, least, step):  # noqa: F811
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    got = phrases.collocations(docs, top=top, least=least, step=step).collect()
    assert Counter(tuple(r[c] for c in PHRASE) for r in got) == Counter(best_phrases(tables[1], top, least))


def test_scores_beyond_64_bits(spark):
    a, s = 9_000_000_000_000_000_000, 18_000_000_000_000_000_001
    df = spark.createDataFrame([(a,)], "a long").select(phrases._ratio(F.col("a"), F.lit(str(s)).cast("decimal(20,0)")).alias("x"))
    assert df.first().x == 2_000_000 * a // s


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return lattice.vocabulary(public_tokenizers.path(Q.PIECES))


def strings():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(Q.PIECES))
    known = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    known = list(dict.fromkeys(s for s in known if lattice.MARK not in s[1:]))
    return known + [bytes([b]) for b in range(256) if bytes([b]) not in set(known)]


def segmentations(word, weight):
    if not word:
        yield 1.0, []
    for n in range(1, len(word) + 1):
        if word[:n] in weight:
            for p, rest in segmentations(word[n:], weight):
                yield weight[word[:n]] * p, [word[:n], *rest]


def test_all_segmentations(pieces):
    known, first = pieces
    names = strings()
    weight = dict(zip(names, first.tolist(), strict=False))
    some = [lattice.MARK + w.encode() for w in ("the", "a", "ing", "é", "under", "zq")]
    made = lattice.Lattice(some, known)
    logs = np.log(first[:-1])
    got, counts = made.forward(logs)[made.ends()], made.expected(logs, np.arange(1.0, 7.0))
    want = Counter()
    for k, w in enumerate(some):
        ways = list(segmentations(w, weight))
        total = math.fsum(p for p, _ in ways)
        assert abs(got[k] - math.log(total)) < 1e-9
        for p, cut in ways:
            for s in cut:
                want[s] += (k + 1) * p / total
    assert all(abs(counts[i] - want[s]) < 1e-9 for i, s in enumerate(names))


def test_words_longer_than_a_part(pieces):
    known, first = pieces
    logs = np.log(first[:-1])
    some = [lattice.MARK + w for w in (b"counterrevolutionary", "ñandú".encode() * 20, b"x" * 300)]
    made = lattice.Lattice(some, known)
    long = [lattice.Long(w, known, logs, part=17) for w in some]
    assert np.allclose(made.forward(logs)[made.ends()], [x.logp() for x in long], rtol=1e-12)
    assert np.allclose(made.expected(logs, np.ones(3)), sum(x.expected(1.0) for x in long), atol=1e-9)


def test_op13(spark, tables, pieces):  # noqa: F811
    """Counts and base scores by their formula; the model by its own lattice with weights learned from word counts in one place."""
    known, first = pieces
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5 == 1
    c, ended = Counter(), 0
    for i, t, *_ in tables[1]:
        if held(i) is False:
            c.update(words(lower(t)))
            ended += 1
    total, distinct = sum(c.values()) + ended, len(c) + (ended > 0)
    some = [lattice.MARK + w.encode() for w in c]
    made, weights = lattice.Lattice(some, known), first
    for _ in range(lattice.ROUNDS):
        n = np.append(made.expected(np.log(weights[:-1]), np.array(list(c.values()), float)), ended) if c else np.append(np.zeros(known.count), ended)
        weights = n + lattice.PRIOR * first
        weights = weights / weights.sum()
    assert abs(np.exp(np.log(weights)).sum() - 1) < 1e-9
    every = sorted({w for _, t, *_ in tables[1] for w in words(lower(t))})
    all_words = lattice.Lattice([lattice.MARK + w.encode() for w in every], known)
    logp = dict(zip(every, all_words.forward(np.log(weights[:-1]))[all_words.ends()], strict=True))
    one = lambda k: math.log10((k + 0.5) / (total + 0.5 * (distinct + 1)))
    want = defaultdict(list)
    for i, t, *_ in tables[1]:
        w = words(lower(t))
        base, score = math.fsum(one(c[x]) for x in w) + one(ended), (math.fsum(logp[x] for x in w) + math.log(weights[-1])) / math.log(10)
        want[i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + (ended > 0), total].append((base, score))
    got = defaultdict(list)
    for r in Q.QUERIES["op13_lattice"](spark, tables[0]).collect():
        assert r.score < 0
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens].append((r.base_score, r.score))
    assert got.keys() == want.keys()
    for k, scores in want.items():
        assert np.allclose(sorted(got[k]), sorted(scores), rtol=1e-7), k
