"""Document probabilities from the lattice of all segmentations into the pieces of an existing subword vocabulary.

A text is its words, each led by the vocabulary's word mark, and an end. Every piece, and every single byte, has a probability; a
text's probability is the sum, over all segmentations of its words, of the products of their pieces' probabilities. No piece
crosses a word mark, so the lattice of a text is cut at each word and the forward recursion, in logarithms, runs once for each
distinct word of the corpus. The scores of the vocabulary (ranks: the lower, the rarer) give each piece a first weight; rounds of
expected counts over the training words (forward and backward) then move the weights to the corpus, with the first weights as
a prior of PRIOR pieces.

The texts are read once, in blocks: a block keeps its words as numbers, and gives one row for each distinct word. So a word's counts, and
then its probability, meet each block once, however often the word occurs in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textops as X

#: Fixed values of the vocabulary's format: what leads a word.
MARK = "▁".encode()
ROUNDS, PRIOR = 3, 2_000.0
#: Bytes of words that are looked up at once; a longer word is walked through in such parts.
PART = 1 << 17
#: Bytes of texts whose distinct words are listed together.
BLOCK_BYTES = 8 << 20
ZIPF = 8.0

_ROWS = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("trained", pa.int64()), ("blob", pa.binary())])
_ROWS_SQL = "block long, code int, word binary, n long, trained long, blob binary"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


class Pieces:
    """The byte strings that words are made of, by length: sorted hashes, and where their weights stand. All 256 bytes are among them."""

    def __init__(self, strings: list[bytes]):
        self.count = len(strings)
        data = np.frombuffer(b"".join(strings), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)
        h = X.spans(X.prefix(X.TABLES[0][data]), off[:-1], off[1:])
        self.by_length = {}
        for n in sorted({len(s) for s in strings}):
            i = np.flatnonzero(np.diff(off) == n)
            i = i[np.argsort(h[i])]
            self.by_length[n] = (h[i], i)
        self.longest = max(self.by_length)
        self.maybe = np.zeros(1 << 20, bool)  # most byte strings are no piece, and this tells so for nearly all of them
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True

    def at(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each place and length from 1 on the piece of that length that ends there, -1: none; start is where the place's word starts."""
        pre, ends = X.prefix(X.TABLES[0][data]), np.arange(1, len(data) + 1)
        inside = ends - start
        out = np.full((len(data), min(self.longest, int(inside.max(initial=0)))), -1, np.int32)
        for n, (known, which) in self.by_length.items():
            if n > out.shape[1]:
                break
            e = ends[inside >= n]
            h = X.spans(pre, e - n, e)
            some = self.maybe[(h >> np.uint64(44)).astype(np.int64)]
            e, h = e[some], h[some]
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            out[e[hit] - 1, n - 1] = which[i[hit]]
        return out


def vocabulary(path: str) -> tuple[Pieces, np.ndarray]:
    """Pieces of a sentencepiece model file, and their first weights (the last is the end's): from rank r about 1 / (r + ZIPF). Bytes
    without a piece of their own are as rare as the last rank. Control pieces and runs of word marks are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    size = model.get_piece_size()
    for i in range(size):
        s = model.id_to_piece(i).encode()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and MARK not in s[1:]:
            weight[s] = 1 / (ZIPF - model.get_score(i))
    for b in range(256):
        weight.setdefault(bytes([b]), 1 / (ZIPF + size))
    w = np.array([*weight.values(), 0.0])
    w[-1] = w[:-1].sum() / 500
    return Pieces(list(weight)), w / w.sum()


def _sum(x: np.ndarray) -> np.ndarray:
    """log(sum(exp(x))) of each row."""
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[:, None]).sum(axis=1)) + safe


class Lattice:
    """Words (as bytes, marked) side by side; weights are natural logarithms, one for each piece."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pieces = pieces
        self.edges = pieces.at(np.frombuffer(b"".join(words), np.uint8), np.repeat(self.first, self.size))
        self.order = np.argsort(-self.size, kind="stable")
        self.ended = np.sort(-self.size)

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Step t, the words of t bytes at least, and the edges that end at their byte t."""
        for t in range(1, int(self.size.max(initial=0)) + 1):
            w = self.order[: np.searchsorted(self.ended, -t, side="right")]
            yield t, w, self.edges[self.first[w] + t - 1, : min(t, self.edges.shape[1])]

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """alpha[first + word + t]: log of the sum over segmentations of the word's first t bytes; one place more than bytes in each word."""
        alpha, at = np.full(int((self.size + 1).sum()), -np.inf), self.first + np.arange(len(self.size))
        alpha[at] = 0
        own = np.append(weights, -np.inf)
        for t, w, e in self.steps():
            before = at[w][:, None] + t - np.arange(1, e.shape[1] + 1)
            alpha[at[w] + t] = _sum(alpha[before] + own[e])
        return alpha

    def ends(self) -> np.ndarray:
        return self.first + np.arange(len(self.size)) + self.size

    def expected(self, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the words, over all segmentations by their probability, counts times each word."""
        alpha, own = self.forward(weights), np.append(weights, -np.inf)
        at, out = self.first + np.arange(len(self.size)), np.zeros(self.pieces.count)
        share = np.zeros(len(alpha))  # probability that a segmentation has a border at the place
        share[self.ends()] = counts
        for t, w, e in reversed(list(self.steps())):
            before = at[w][:, None] + t - np.arange(1, e.shape[1] + 1)
            p = np.exp(alpha[before] + own[e] - alpha[at[w] + t][:, None]) * share[at[w] + t][:, None]
            hit = e >= 0
            np.add.at(share, before[hit], p[hit])
            np.add.at(out, e[hit], p[hit])
        return out


class Long:
    """One word of any length, walked through part after part: what grows with it is one number a byte."""

    def __init__(self, word: bytes, pieces: Pieces, weights: np.ndarray, part: int = PART):
        self.word, self.pieces, self.part, self.own = word, pieces, part, np.append(weights, -np.inf)
        self.alpha = np.full(pieces.longest + len(word), -np.inf)  # led by places that nothing reaches
        self.alpha[pieces.longest - 1] = 0
        for i in range(0, len(word), part):
            for k, e in enumerate(self.edges(i), i):
                self.alpha[pieces.longest + k] = _sum((self.alpha[k : k + pieces.longest][::-1] + self.own[e])[None])[0]

    def edges(self, i: int) -> np.ndarray:
        lead = min(i, self.pieces.longest - 1)
        raw = np.frombuffer(self.word[i - lead : i + self.part], np.uint8)
        out = np.full((len(raw) - lead, self.pieces.longest), -1, np.int32)
        found = self.pieces.at(raw, np.zeros(len(raw), np.int64))[lead:]
        out[:, : found.shape[1]] = found
        return out

    def logp(self) -> float:
        return float(self.alpha[-1])

    def expected(self, count: float) -> np.ndarray:
        share, out, most = np.zeros(len(self.alpha)), np.zeros(self.pieces.count), self.pieces.longest
        share[-1] = count
        for i in range((len(self.word) - 1) // self.part * self.part, -1, -self.part):
            edges = self.edges(i)
            for k in range(len(edges) - 1, -1, -1):
                at, e = i + k, edges[k]
                p = np.exp(self.alpha[at : at + most][::-1] + self.own[e] - self.alpha[most + at]) * share[most + at]
                share[at : at + most] += p[::-1]
                out[e[e >= 0]] += p[e >= 0]  # pieces of one place differ in length, so each stands once
        return out


def _parts(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of words that hold about PART bytes, and where each starts; a longer word is a run of its own."""
    i, held = 0, 0
    for j, w in enumerate(words):
        if held and held + len(w) > PART:
            yield i, words[i:j]
            i, held = j, 0
        held += len(w)
    if i < len(words):
        yield i, words[i:]


def _marked(column: pa.Array) -> list[bytes]:
    return [MARK + w for w in column.to_pylist()]


def _expected(pieces: Pieces, weights: np.ndarray):
    """(piece, n): expected counts of the pieces in a task's words (word, trained)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pieces.count)
        for b in batches:
            words, counts = _marked(b["word"]), b["trained"].to_numpy()
            for i, some in _parts(words):
                if len(some[0]) <= PART:
                    total += Lattice(some, pieces).expected(weights, counts[i : i + len(some)].astype(np.float64))
                else:
                    total += Long(some[0], pieces, weights).expected(float(counts[i]))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["piece", "n"])

    return run


def _likely(pieces: Pieces, weights: np.ndarray):
    """(word, trained, logp): the log of each word's probability, over all segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, out = _marked(b["word"]), []
            for _, some in _parts(words):
                if len(some[0]) > PART:
                    out.append(np.array([Long(some[0], pieces, weights).logp()]))
                else:
                    one = Lattice(some, pieces)
                    out.append(one.forward(weights)[one.ends()])
            yield pa.RecordBatch.from_arrays([b["word"], b["trained"], pa.array(np.concatenate(out) if out else np.empty(0))], names=["word", "trained", "logp"])

    return run


def _packed(doc_ids: pa.Array, held: list[bool | None], first: np.ndarray, codes: np.ndarray) -> bytes:
    """A block's documents: ids and whether each is held out (2: unknown), then where each starts, then the codes of all words."""
    ids = doc_ids.fill_null(0).to_numpy().astype("<i8")
    flags = np.array([2 if h is None else int(h) for h in held], np.uint8) | (np.asarray(doc_ids.is_null()).astype(np.uint8) << 2)
    return b"".join((np.array([len(ids)], "<i8").tobytes(), ids.tobytes(), first.astype("<i8").tobytes(), flags.tobytes(), codes.astype("<u4").tobytes()))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    ids, first = np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i8", n + 1, 8 + 8 * n)
    at = 16 + 16 * n
    return ids, first, np.frombuffer(blob, np.uint8, n, at), np.frombuffer(blob, "<u4", -1, at + n)


def _read(folds: int, fold: int):
    """One row for each distinct word of a block (code from 0 on; n and trained: how often all and the training documents have it) and one
    with the documents (code -1; n and trained: how many documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, table in enumerate(X.blocks(batches, "text", BLOCK_BYTES)):
            data, off = X.texts(table["text"])
            data = X.LOWER[data]
            starts, ends, first = X.words(data, off)
            raw = X.gather(data, starts, ends)
            own = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts)))), pa.py_buffer(raw)]).dictionary_encode()
            codes, words = own.indices.to_numpy(), own.dictionary.cast(pa.binary())
            doc_ids = table["doc_id"].combine_chunks()
            held = [None if i is None else zlib.crc32(str(i).encode()) % folds == fold for i in doc_ids.to_pylist()]
            train = np.array([h is False for h in held], bool)
            trained = np.bincount(codes[np.repeat(train, np.diff(first))], minlength=len(words))
            block, n = (task << 32) + k, len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), words, pa.array(np.bincount(codes, minlength=n)), pa.array(trained), pa.nulls(n, pa.binary())], schema=_ROWS
            )
            yield pa.RecordBatch.from_pylist([{"block": block, "code": -1, "n": len(held), "trained": int(train.sum()), "blob": _packed(doc_ids, held, first, codes)}], schema=_ROWS)

    return run


def _score(total: int, distinct: int, ended: int, end: float):
    """Scores of the documents of each block, whose rows come together and in order of their code: (block, code, trained, logp, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(total + 0.5 * (distinct + 1))
        blob, block, trained, logp = None, None, [], []

        def scored() -> pa.RecordBatch:
            ids, first, flags, codes = _unpacked(blob)
            c, p = np.concatenate([np.empty(0), *trained]), np.concatenate([np.empty(0), *logp])
            add = lambda x: np.add.reduceat(np.append(x[codes], 0.0), first[:-1]) * (np.diff(first) > 0)
            n = np.diff(first)
            score = (add(p) + end) / np.log(10)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=flags & 4 > 0), pa.array(flags & 1 > 0, mask=flags & 2 > 0), pa.array(n + 1), pa.array(add((c > 0).astype(np.float64)).astype(np.int64) + (ended > 0)),
                    pa.array(add(np.log10(c + 0.5) - base) + np.log10(ended + 0.5) - base), pa.array(score),
                ], schema=_SCORED,
            )

        for b in batches:
            blocks = b["block"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
            for i, j in zip(cut, cut[1:], strict=False):
                if i == j:
                    continue
                if blocks[i] != block:
                    if blob is not None:
                        yield scored()
                    block, trained, logp = int(blocks[i]), [], []
                    blob = b["blob"][i].as_py()
                    i += 1
                trained.append(b["trained"][i:j].to_numpy().astype(np.float64))
                logp.append(b["logp"][i:j].to_numpy(zero_copy_only=False))
        if blob is not None:
            yield scored()

    return run


def learned(words: DataFrame, pieces: Pieces, first: np.ndarray, ended: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Natural logarithms of the weights, the end's last, after rounds of expected counts over words (word, trained). What comes to the
    driver is one number a piece."""
    weights = first.copy()
    for _ in range(rounds):
        got = words.mapInArrow(X.task(_expected(pieces, np.log(weights[:-1]))), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.append(np.zeros(pieces.count), float(ended))
        for r in got:
            n[r.piece] += r.n
        weights = n + prior * first
        weights /= weights.sum()
    return np.log(weights)


def lattice_scores(documents: DataFrame, model: str, folds: int = 5, fold: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; model is the file of the vocabulary.

    Texts (null: empty) are lower-cased (A-Z); their tokens are words and an end. Documents whose crc32 of doc_id modulo folds is fold are
    held out; a null doc_id is neither held out (null) nor learned from. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, with c, N
    and V from the training tokens; n_known are tokens with c > 0. score is log10 of the text's probability over all segmentations.
    Rows that repeat an id are scored each; an empty table gives no rows; further columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    rows = X.written(documents.select("doc_id", "text").mapInArrow(X.task(_read(folds, fold)), _ROWS_SQL))
    words = X.written(rows.filter("code >= 0").groupBy("word").agg(F.sum("trained").alias("trained")))
    seen: Column = F.col("trained") > 0
    r = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count_if(seen).alias("v")).first()
    ended = rows.filter("code < 0").agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    total, distinct = r.n + ended, r.v + (ended > 0)
    pieces, first = vocabulary(model)
    weights = learned(words.filter(seen), pieces, first, ended, rounds)
    likely = words.mapInArrow(X.task(_likely(pieces, weights[:-1])), "word binary, trained long, logp double")
    got = rows.filter("code >= 0").select("block", "code", "word").join(likely, "word").select("block", "code", "trained", "logp", F.lit(None).cast("binary").alias("blob"))
    docs = rows.filter("code < 0").select("block", "code", "trained", F.lit(0.0).alias("logp"), "blob")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = got.unionByName(docs).repartition(parts, "block").sortWithinPartitions("block", "code")
    out = both.mapInArrow(X.task(_score(total, distinct, ended, float(weights[-1]))), _SCORED_SQL)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
