"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a block of texts in one map task; nothing is shuffled. A word that no benchmark phrase holds can't be part of a
match, so a shard's sequence is its maximal runs of benchmark words, each run that is long enough for a phrase followed
by a separator. The sequence is sorted into a suffix array, its Burrows-Wheeler transform goes into a wavelet matrix, and
all phrases are searched backward at once through its ranks. Places come from suffix positions sampled every SAMPLE tokens.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X

WINDOW = 10
SAMPLE = 8
#: Benchmark items are searched in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Groups whose phrases a task keeps unfolded.
UNFOLDED = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane for each bit of a symbol, with running counts."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before place at; arrays of both."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes of seq, whose last symbol is the only 0, by doubling."""
    rank, width = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(seq), np.int64)
        after[: len(seq) - width] = rank[width:] + 1
        key = rank * (len(seq) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(len(seq), np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == len(seq) - 1:
            return order


class FMIndex:
    """Backward search and locating over a sequence of symbols of at least 1 (a 0 is added at its end)."""

    def __init__(self, seq: np.ndarray, top: int):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        self.wavelet = WaveletMatrix(bwt, max(1, int(top).bit_length()))
        self.bwt = bwt
        self.sampled = order % SAMPLE == 0
        self.sampled_before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) whose suffixes start with each phrase; phrases are aligned to the right of a matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1]):
            on = (k < length) & (lo < hi)
            if not on.any():
                break
            c = phrases[on, phrases.shape[1] - 1 - k]
            lo[on] = self.before[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.before[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of rows of the suffix order."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.sampled[r]
            out[open_[done]] = self.samples[self.sampled_before[r[done]]] + steps
            open_, r = open_[~done], r[~done]
            c = self.bwt[r]
            rows[open_] = self.before[c] + self.wavelet.rank(c, r)
            steps += 1
        return out


def packed_items(items: list[tuple[str | None, str | None]]) -> bytes:
    """A group of items (name, text): vocabulary (sorted hashes of words) and the words of the shortest item, and by itself what phrases are
    unfolded from, the items' words as symbols, where each item's start, and names."""
    names, texts = [n for n, _ in items], pa.array([t for _, t in items], pa.string())
    data, off = X.texts(texts)
    starts, ends, first = X.words(data, off, X.ALNUM)
    vocab, symbols = np.unique(X.word_hash(X.LOWER[data], starts, ends), return_inverse=True)
    n = np.diff(first)
    return pickle.dumps((vocab, int(n[n > 0].min(initial=1 << 31)), pickle.dumps((symbols.reshape(-1).astype(np.uint32), first, names))))


def phrases_of(packed: bytes, window: int = WINDOW):
    """Distinct phrases of a packed group, of its second part, as a right-aligned matrix of symbols, their lengths, and the items of each."""
    symbols, first, names = pickle.loads(packed)
    n = np.diff(first)
    many = np.where(n >= window, n - window + 1, np.minimum(n, 1))  # windows of an item; all of it if it is shorter
    item = np.repeat(np.arange(len(n)), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[item]
    length = np.minimum(n, window)[item]
    k = np.arange(window)[None, :] - (window - length)[:, None]
    matrix = np.where(k >= 0, symbols[np.minimum(at[:, None] + np.maximum(k, 0), max(0, len(symbols) - 1))].astype(np.int64) + 1, 0) if len(at) else np.zeros((0, window), np.int64)
    matrix, back = np.unique(matrix, axis=0, return_inverse=True)
    of: list[set[str]] = [set() for _ in matrix]
    for p, i in sorted(set(zip(back.reshape(-1).tolist(), item.tolist(), strict=True))):
        if names[i] is not None:
            of[p].add(names[i])
    return matrix, (matrix > 0).sum(1), [sorted(x) for x in of]


def _searched(data: np.ndarray, off: np.ndarray, vocab: np.ndarray, shortest: int, unfold: Callable[[], tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Words of a block, which are hit, and where a phrase occurs the text and the phrase's items. A group of which no run of words is long enough
    isn't unfolded, and phrases of which the block lacks a word aren't searched."""
    starts, ends, first = X.words(data, off, X.ALNUM)
    hit = np.zeros(len(starts), bool)
    none = np.empty(0, np.int64)
    if not len(starts) or not len(vocab):
        return starts, ends, first, hit, none, []
    h = X.word_hash(X.LOWER[data], starts, ends)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    known = vocab[at] == h
    run = np.zeros(len(h) + 1, bool)
    run[first[first < len(h)]] = True  # runs end with their text
    new = known & (run[:-1] | ~np.concatenate(([False], known[:-1])))
    number = np.cumsum(new) - 1
    size = np.bincount(number[known], minlength=1)
    keep = np.flatnonzero(known)
    keep = keep[size[number[keep]] >= shortest]
    if not len(keep):
        return starts, ends, first, hit, none, []
    matrix, length, of = unfold()
    there = np.zeros(len(vocab) + 1, bool)
    there[0] = True
    there[at[keep] + 1] = True
    some = np.flatnonzero(there[matrix].all(1))
    if not len(some):
        return starts, ends, first, hit, none, []
    matrix, length = matrix[some], length[some]
    split = np.flatnonzero(np.diff(number[keep])) + 1  # a separator after each run
    seq = np.insert(at[keep] + 1, split, len(vocab) + 1)
    back = np.insert(keep, split, -1)
    index = FMIndex(seq, len(vocab) + 1)
    lo, hi = index.search(matrix, length)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    word = back[index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))]
    hit = X.merged(word, word + length[phrase], len(starts))
    text = np.searchsorted(first, word, side="right") - 1
    return starts, ends, first, hit, text, [of[p] for p in some[phrase].tolist()]


def _find(groups: list, window: int, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unfolded = lru_cache(maxsize=UNFOLDED)(lambda k: phrases_of(pickle.loads(groups[k].value)[2], window))
        for t in X.blocks(batches, "text"):
            data, off = X.texts(t["text"])
            found: list[set[str]] = [set() for _ in range(t.num_rows)]
            hit = False
            for k, group in enumerate(groups):
                vocab, shortest, _ = pickle.loads(group.value)
                starts, ends, first, here, text, items = _searched(data, off, vocab, min(shortest, window), lambda k=k: unfolded(k))
                hit = hit | here
                for d, named in zip(text.tolist(), items, strict=True):
                    found[d].update(named)
            n_hit = np.add.reduceat(np.append(hit, False), np.minimum(first[:-1], len(hit))) if len(first) > 1 else []
            n_words = np.diff(first)
            n_hit = np.where(n_words > 0, n_hit, 0)
            cols = {
                **{c: t[c].combine_chunks() for c in t.column_names if c != "text" or cut},
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
            }
            if cut:
                out = cols["text"].to_pylist()
                for d in np.flatnonzero(n_hit):
                    a, b = first[d], first[d + 1]
                    gone = hit[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    raw, kept, at = data[off[d] : off[d + 1] - 1].tobytes(), [], 0
                    for i, j in zip(edge[::2], edge[1::2], strict=True):  # a span goes with the white space after it
                        kept.append(raw[at : starts[a + i] - off[d]])
                        at = int(starts[a + j] - off[d]) if a + j < b else len(raw)
                    out[d] = b"".join([*kept, raw[at:]]).decode()
                cols["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each document: its words, the words inside a benchmark window, and the sorted item_ids with windows in it.

    Words are ASCII letters and digits and all characters above ASCII, A-Z lower-cased. A window is window consecutive
    words of an item, or all words of a shorter item; an item without words has none. Every column of documents is kept but
    text, which is dropped unless cut: then the hit words are cut out of it, and hit spans take along what follows
    them up to the next word. Null texts have no words and stay null. Repeated rows are judged one by one; empty tables
    give empty results, and an empty benchmark hits nothing. An item without item_id hits, but is not among items. Columns n_words, n_hit and items replace ones so named.

    The benchmark is packed by tasks in groups of about group_bytes of text, each broadcast by itself; a task searches its block for
    one group after another and joins the hits. The driver holds one packed group at a time; a worker holds all of them, some four
    bytes a word, and the phrases of UNFOLDED ones, so what a worker can hold bounds the benchmark's size, not the results.
    """
    docs = documents.drop("n_words", "n_hit", "items")
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text IS NOT NULL")
    sized = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-sized // group_bytes))
    items = items.withColumn("g", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text" or cut)

    def pack(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["item"].to_pylist(), t["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r))
        return pa.table({"packed": pa.array([packed_items(rows)], pa.binary())})

    packed = items.groupBy("g").applyInArrow(pack, "packed binary")
    sent = [spark.sparkContext.broadcast(r.packed) for r in packed.toLocalIterator()]
    sent = sent or [spark.sparkContext.broadcast(packed_items([]))]
    return docs.mapInArrow(X.task(_find(sent, window, cut)), plain + "n_words long, n_hit long, items array<string>")


def items_digest(items: str):
    """Lower-case hex SHA-256 of the items, joined by commas."""
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)
