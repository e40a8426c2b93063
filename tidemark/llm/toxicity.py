"""Toxicity scores from a convolutional text classifier, trained on all labelled documents that aren't held out.

Words are hashed; those of the training documents that stand in several and tell most of their labels have an embedding each, all
others share hashed rows. Spark counts the words of all training documents. In each epoch learners, one task each, start from the same model
and take steps over their share of the documents; the mean of what they changed moves the model. More documents make more learners, up to
LEARNERS, and then larger shares. Filters of several widths run over a text's embeddings, each keeps its largest response, and a logistic layer
scores those. The logit is then moved by an offset for the language that the words of the text show, so that 0.5 is each
language's own threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X

#: Half the documents, and half the words, that make one more learner; never a limit of what is learnt from.
SAMPLE, SAMPLE_WORDS = 4000, 1_500_000
LEARNERS = 32
#: Words with an embedding of their own at most, and rows of embeddings that learners send as one.
VOCABULARY, CHUNK = 1 << 16, 1024
#: Logits are counted in steps of 1 / STEPS where thresholds are set.
STEPS = 4096
RUNS = 16
RARE = 1024
SIZE, WIDTHS, FILTERS = 8, (1, 2, 3), 8
#: Epochs of one learner and of several; documents and words of a step.
EPOCHS, EPOCHS_SHARED, BATCH, BATCH_WORDS, RATE = 6, 3, 64, 200_000, 0.01
#: Thresholds are set on logits that models of the other folds give.
FOLDS = 3
#: Fixed words that tell the languages apart.
LANGUAGES = {
    "en": ("the", "of", "and", "to", "that", "is"),
    "fr": ("les", "et", "des", "une", "dans", "pour", "le"),
    "de": ("und", "der", "die", "das", "mit", "ist"),
    "es": ("el", "los", "las", "y", "con", "por"),
}


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    data, off = X.texts(pa.array([" ".join(words)]))
    return X.word_hash(X.LOWER[data], *X.words(data, off, X.ALNUM)[:2])


def hashed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts (A-Z lower-cased), and the first word of each text and of the end."""
    data, off = X.texts(column)
    starts, ends, first = X.words(data, off, X.ALNUM)
    return X.word_hash(X.LOWER[data], starts, ends), first


def language(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the language with most of its words in each text; len(LANGUAGES) where there is none."""
    lists = [_hashes(w) for w in LANGUAGES.values()]
    order = np.argsort(np.concatenate(lists))
    known, of = np.concatenate(lists)[order], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[i] == h
    text = np.searchsorted(first, np.flatnonzero(hit), side="right") - 1
    counts = np.zeros((len(first) - 1, len(lists)), np.int64)
    np.add.at(counts, (text, of[i[hit]]), 1)
    return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(lists)) if len(counts) else np.empty(0, np.int64)


def rows_of(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Table rows of words; known are those with a row of their own, ascending."""
    row = 1 + (h % np.uint64(RARE)).astype(np.int64)
    if len(known):
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        row = np.where(known[i] == h, 1 + RARE + i, row)
    return row


def padded(row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of texts, each text followed by padding, and where each text starts."""
    pad = max(WIDTHS)
    n = np.diff(first)
    at = np.cumsum(n + pad) - n - pad
    out = np.zeros(int((n + pad).sum()), np.int64)
    out[np.arange(len(row)) + np.repeat(at - first[:-1], n)] = row
    return out, at


@dataclass
class Model:
    known: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    offsets: np.ndarray

    def rows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the words, each text followed by padding as wide as the widest filter, and where each text starts."""
        return padded(rows_of(self.known, h), first)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Each width's filters at each word of the embedded texts; windows that leave a text see its padding or the next text's words, and are masked."""
        out = []
        for k, w in enumerate(WIDTHS):
            r = np.zeros((len(x), FILTERS), np.float32)
            for j in range(w):
                r[: len(x) - j] += x[j:] @ self.filters[k][j]
            out.append(np.maximum(r + self.bias[k], 0))
        return out

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.logits_of(*self.rows(h, first))

    def logits_of(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.float32)
        pooled = np.concatenate([np.maximum.reduceat(_masked(r, at, w), at, axis=0) for r, w in zip(self.responses(self.table[row]), WIDTHS, strict=True)], axis=1)
        return pooled @ self.out + self.shift

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.logits(h, first) - self.offsets[language(h, first)]
        return 1 / (1 + np.exp(-z.astype(np.float64).clip(-30, 30)))


def _masked(r: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Responses with those of windows that reach the next text set to 0, the least that a response can be."""
    for j in range(1, width):
        r[np.append(at[1:], len(r)) - j] = 0
    return r


def _start(known: np.ndarray, df: np.ndarray, pos: np.ndarray, n: int, n1: int, seed: int = 1) -> Model:
    """A model before its first step, from how many of n training documents, n1 of label 1, hold each known word (df, and pos of label 1)."""
    rng = np.random.default_rng(seed)
    odds = np.log((pos + 0.5) / (max(1, n1) + 1)) - np.log((df - pos + 0.5) / (max(1, n - n1) + 1))
    odds *= df / (df + 5.0)
    table = rng.normal(0, 0.05, (1 + RARE + len(known), SIZE)).astype(np.float32)
    table[0] = 0
    table[1 + RARE :, 0] = odds / 4  # embeddings start from the classes' odds, and training moves all of them
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :2] = 1.0
    m = Model(known, table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros(len(LANGUAGES) + 1))
    m.out[[0, 1, FILTERS, FILTERS + 1]] = 1.0
    if n1 in (0, n):
        m.shift = float(np.log((n1 + 1) / (n - n1 + 1)))
        m.out[:] = 0
    return m


class Learner:
    """Takes steps (Adam) from a model; weights are those of the labels 0 and 1."""

    def __init__(self, m: Model, weights: tuple[float, float]):
        self.old, self.weights = m, np.array(weights, np.float32)
        self.m = m = Model(m.known, m.table.copy(), [f.copy() for f in m.filters], [b.copy() for b in m.bias], m.out.copy(), m.shift, m.offsets)
        self.params = [m.table, *m.filters, *m.bias, m.out]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.s_moments, self.steps, self.seen = [0.0, 0.0], 0, np.zeros(len(m.table), bool)

    def step(self, row: np.ndarray, at: np.ndarray, label: np.ndarray) -> None:
        m = self.m
        self.steps += 1
        x = m.table[row]
        pooled, where = [], []
        for r, w in zip(m.responses(x), WIDTHS, strict=True):
            r = _masked(r, at, w)
            top = np.stack([a + r[a:z].argmax(0) for a, z in zip(at, np.append(at[1:], len(r)), strict=True)])
            where.append(top)
            pooled.append(np.take_along_axis(r, top, 0))
        features = np.concatenate(pooled, 1)
        p = 1 / (1 + np.exp(-np.clip(features @ m.out + m.shift, -30, 30)))
        g = ((p - label) * self.weights[label] / len(label)).astype(np.float32)
        gf = g[:, None] * m.out * (features > 0)
        grads = [None, *[np.zeros_like(f) for f in m.filters], *[np.zeros_like(v) for v in m.bias], features.T @ g]
        g_rows, g_vals = [], []
        for k, w in enumerate(WIDTHS):
            part = gf[:, k * FILTERS : (k + 1) * FILTERS]
            grads[1 + len(WIDTHS) + k] = part.sum(0)
            for j in range(w):
                place = np.minimum(where[k] + j, len(x) - 1)
                grads[1 + k][j] = np.einsum("dfs,df->sf", x[place], part)
                g_rows.append(row[place].ravel())
                g_vals.append((part[:, :, None] * m.filters[k][j].T[None]).reshape(-1, SIZE))
        touched, back = np.unique(np.concatenate(g_rows), return_inverse=True)
        g_table = np.zeros((len(touched), SIZE), np.float32)
        np.add.at(g_table, back.reshape(-1), np.concatenate(g_vals))
        g_table[touched == 0] = 0
        self.seen[touched] = True
        c1, c2 = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for k, (p_, (a, v)) in enumerate(zip(self.params, self.moments, strict=True)):
            s = touched if k == 0 else slice(None)
            grad = g_table if k == 0 else grads[k]
            a[s] = 0.9 * a[s] + 0.1 * grad
            v[s] = 0.999 * v[s] + 0.001 * grad * grad
            p_[s] -= RATE * (a[s] / c1) / (np.sqrt(v[s] / c2) + 1e-7)
        gs = float(g.sum())
        self.s_moments = [0.9 * self.s_moments[0] + 0.1 * gs, 0.999 * self.s_moments[1] + 0.001 * gs * gs]
        m.shift -= RATE * (self.s_moments[0] / c1) / (np.sqrt(self.s_moments[1] / c2) + 1e-7)

    def changes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(chunk, change, seen): CHUNK rows of the table each, if a step moved any of them; all other parameters as chunk -1."""
        rest = np.concatenate([(new - old).ravel() for new, old in zip(self.params[1:], [*self.old.filters, *self.old.bias, self.old.out], strict=True)] + [np.array([self.m.shift - self.old.shift])])
        if self.steps:
            yield -1, rest.astype(np.float32), np.ones(len(rest), bool)
        for k in range(0, len(self.seen), CHUNK):
            if self.seen[k : k + CHUNK].any():
                yield k // CHUNK, self.m.table[k : k + CHUNK] - self.old.table[k : k + CHUNK], self.seen[k : k + CHUNK]


def _changed(m: Model, chunk: int, change: np.ndarray) -> None:
    """Adds a change, as changes() gives it, to the model."""
    if chunk >= 0:
        part = m.table[chunk * CHUNK : (chunk + 1) * CHUNK]
        part += change.reshape(-1, SIZE)
        return
    at = 0
    for p in (*m.filters, *m.bias, m.out):
        p += change[at : at + p.size].reshape(p.shape)
        at += p.size
    m.shift += float(change[at])


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labelled documents that aren't held out; of several labels the largest counts."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, d0 .., p0 ..): how many documents of each fold hold a word, and how many of those have label 1; partial counts."""
    for t in X.blocks(batches, "text", 4 << 20):
        h, first = hashed(t["text"])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        words, back = np.unique(h[new], return_inverse=True)
        fold, toxic = t["fold"].to_numpy()[doc[new]], t["toxic"].to_numpy()[doc[new]]
        counts = [np.bincount(back[(fold == f) & (toxic >= k)], minlength=len(words)) for k in (0, 1) for f in range(FOLDS)]
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *map(pa.array, counts)], names=["h", *COUNTS])


COUNTS = [f"{c}{f}" for c in "dp" for f in range(FOLDS)]
INDEXED = "key long, fold int, toxic int, lang int, words array<int>"


def _indexed(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in X.blocks(batches, "text", 1 << 20):
            h, first = hashed(t["text"])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(rows_of(known.value, h), pa.int32()))
            keep = [t[c].combine_chunks() for c in ("key", "fold", "toxic")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(language(h, first), pa.int32()), lists], names=["key", "fold", "toxic", "lang", "words"])

    return run


def _steps(batches: Iterator[pa.RecordBatch], by: str | None = None) -> Iterator[tuple]:
    """(value of by, fold, toxic, lang, words, first) of consecutive documents with one value of by, as many as make a step."""
    for batch in batches:
        lists = batch["words"]
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words, ends = lists.flatten().to_numpy(), np.cumsum(n)
        key = batch[by].to_numpy() if by else np.zeros(len(n), np.int64)
        fold, toxic, lang = (batch[c].to_numpy() for c in ("fold", "toxic", "lang"))
        i = 0
        while i < len(n):
            base = ends[i] - n[i]
            j = min(i + BATCH, int(np.searchsorted(key[i:] != key[i], True)) + i if (key[i:] != key[i]).any() else len(n))
            j = max(i + 1, min(j, int(np.searchsorted(ends, base + BATCH_WORDS, side="right"))))
            yield key[i], fold[i:j], toxic[i:j], lang[i:j], words[base : ends[j - 1]], np.concatenate(([0], ends[i:j] - base))
            i = j


def _picked(words: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    return words[np.repeat(pick, n)], np.concatenate(([0], np.cumsum(n[pick])))


def _learn(state) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(model, chunk, learner, change, seen) of all models, each learnt from the documents outside its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, maps, weights = state.value
        now, learners = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for k, x in enumerate(learners):
                for chunk, change, seen in x.changes():
                    row = {"model": [k], "chunk": [chunk], "learner": [int(now)], "change": [change.tobytes()], "seen": [seen.tobytes()]}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(row.items(), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})

        for learner, fold, toxic, _, words, first in _steps(batches, "learner"):
            if learner != now:
                yield from out()
                now, learners = learner, [Learner(m, w) for m, w in zip(models, weights, strict=True)]
            for k, x in enumerate(learners):
                pick = fold != k
                if pick.any() and x.m.out.any():
                    w, f = _picked(words, first, pick)
                    x.step(*padded(maps[k][w], f), toxic[pick])
        yield from out()

    return run


def _mean(t: pa.Table) -> pa.Table:
    """The mean change of each row of a chunk among the learners that moved it."""
    t = t.sort_by("learner")  # sums of floats depend on their order
    change = [np.frombuffer(x, np.float32) for x in t["change"].to_pylist()]
    seen = [np.frombuffer(x, bool) for x in t["seen"].to_pylist()]
    total = sum(c.reshape(len(s), -1).astype(np.float64) * s[:, None] for c, s in zip(change, seen, strict=True))
    mean = total / np.maximum(1, sum(s.astype(np.int64) for s in seen))[:, None]
    return pa.table({"model": t["model"][:1], "chunk": t["chunk"][:1], "change": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _cuts(state) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, step, n, pos): logits in steps of 1 / STEPS, each of a model that was learnt without the document's fold; partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, maps, folded = state.value
        for _, fold, toxic, lang, words, first in _steps(batches):
            z = np.zeros(len(fold), np.float32)
            for k in range(FOLDS) if folded else (FOLDS,):
                pick = (fold == k) | (not folded)
                if pick.any():
                    w, f = _picked(words, first, pick)
                    z[pick] = models[k].logits_of(*padded(maps[k][w], f))
            step = np.floor(np.clip(z, -30, 30).astype(np.float64) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(step), pa.array(np.ones(len(z), np.int64)), pa.array(toxic.astype(np.int64))], names=["lang", "step", "n", "pos"])

    return run


def _threshold(step: np.ndarray, n: np.ndarray, pos: np.ndarray) -> float:
    """The cut between logits, counted by steps, with the best F1 of label 1; 0 where a label is missing."""
    if pos.sum() in (0, n.sum()):
        return 0.0
    step, back = np.unique(-step, return_inverse=True)
    step = -step
    hit, many = np.cumsum(np.bincount(back, weights=pos)), np.cumsum(np.bincount(back, weights=n))
    k = int((2 * hit / (many + hit[-1])).argmax())
    return float((step[k] + (step[k + 1] if k + 1 < len(step) else step[k] - STEPS) + 1) / 2 / STEPS)


def share(n: np.ndarray, total: int) -> int:
    """How many words a text may have at most, so that all texts, of n words each, have total together; 1 at least."""
    n = np.sort(n)
    fair = (total - np.cumsum(n) + n) // (len(n) - np.arange(len(n)))
    over = np.flatnonzero(n > fair)
    return max(1, int(fair[over[0]] if len(over) else n.max(initial=1)))


def _spread(words: Column, n: Column, most: int) -> Column:
    """words where there are at most most; of more, RUNS runs from the first to the last word, most words in all. Training takes whole texts."""
    runs = min(RUNS, most)
    cuts = [i * most // runs for i in range(runs + 1)]
    at = [F.floor((n - most) * i / max(1, runs - 1)) + 1 + cuts[i] for i in range(runs)]
    return F.when(n <= most, words).otherwise(F.concat(*[F.slice(words, at[i].cast("int"), F.lit(cuts[i + 1] - cuts[i])) for i in range(runs)]))


def _vocabulary(rows: DataFrame, n: int, n1: int) -> pa.Table:
    """(h, d0 .., p0 ..) of the words of three training documents or more; of more than VOCABULARY those whose labels tell most."""
    counts = rows.select("text", "fold", "toxic").mapInArrow(X.task(_counted), "h long, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = counts.groupBy("h").agg(*[F.sum(c).alias(c) for c in COUNTS])
    df, pos = (sum(F.col(f"{c}{f}") for f in range(FOLDS)) for c in "dp")
    odds = F.log((pos + 0.5) / (n1 + 1)) - F.log((df - pos + 0.5) / (n - n1 + 1))
    counts = X.written(counts.filter(df >= 3).withColumn("tell", F.floor(F.abs(odds) * F.sqrt(df) * 64).cast("long")))
    room, least = VOCABULARY, None
    for r in sorted(counts.groupBy("tell").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["tell"]
    return counts.filter(F.lit(False) if least is None else F.col("tell") >= least).drop("tell").toArrow()


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Model:
    """A model learnt from all labelled documents that aren't held out, their words, counts and thresholds included.

    2 * sample documents or 2 * sample_words words make one more learner, up to LEARNERS; no document, and none of its words, is left out.
    The driver receives a vocabulary of bounded size, mean changes of the models and counts of logits. The offset of a language is the best
    cut between logits of its texts, each from a model that was learnt without the text's fold. Rows that repeat a doc_id and a text count once.
    """
    rows = X.keyed(documents).join(training_rows(labels), "doc_id").select("doc_id", "text_key", F.col("toxic").cast("int").alias("toxic"), "text")
    hash_of = lambda k: F.xxhash64("doc_id", "text_key", F.lit(k))
    rows = rows.dropDuplicates(["doc_id", "text_key"]).withColumn("fold", F.pmod(hash_of(1), F.lit(FOLDS)).cast("int"))
    rows = X.written(rows.select(hash_of(2).alias("key"), "fold", "toxic", "text"))
    sizes = rows.groupBy("fold", "toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    count = lambda out, toxic: sum(r.n for r in sizes if r.fold != out and r.toxic in toxic)
    n, n1 = ([count(k, t) for k in range(FOLDS + 1)] for t in ((0, 1), (1,)))
    if n1[FOLDS] in (0, n[FOLDS]):
        return _start(np.empty(0, np.uint64), np.empty(0), np.empty(0), n[FOLDS], n1[FOLDS])

    v = _vocabulary(rows, n[FOLDS], n1[FOLDS])
    known = v["h"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, counts = known[order], np.stack([v[c].to_numpy()[order] for c in COUNTS]).reshape(2, FOLDS, -1)
    models, maps = [], []
    for k in range(FOLDS + 1):  # the last model leaves no fold out
        df, pos = counts.sum(1) - (counts[:, k] if k < FOLDS else 0)
        models.append(_start(known, df, pos, n[k], n1[k]))
        own = np.arange(1 + RARE + len(known))
        own[1 + RARE :][df < 3] = 1 + (known[df < 3] % np.uint64(RARE)).astype(np.int64)
        maps.append(own)
    weights = [(0.5 * a / max(1, a - b), 0.5 * a / max(1, b)) for a, b in zip(n, n1, strict=True)]
    sc = documents.sparkSession.sparkContext
    words = X.written(rows.mapInArrow(X.task(_indexed(sc.broadcast(known))), INDEXED))
    total = sum(r.bytes or 0 for r in sizes) / 6  # words are some six bytes
    learners = int(min(LEARNERS, max(1, -(-n[FOLDS] // (2 * sample)), -(-total // (2 * sample_words)))))
    for epoch in range(EPOCHS if learners == 1 else EPOCHS_SHARED):
        state = sc.broadcast((models, maps, weights))
        dealt = words.withColumn("learner", F.pmod("key", F.lit(learners)).cast("int")).withColumn("at", F.xxhash64("key", F.lit(epoch)))
        dealt = dealt.repartition(4 * learners if learners > 1 else 1, "learner").sortWithinPartitions("learner", "at", "key").select("learner", "fold", "toxic", "lang", "words")
        changes = dealt.mapInArrow(X.task(_learn(state)), "model int, chunk int, learner int, change binary, seen binary")
        for r in changes.groupBy("model", "chunk").applyInArrow(_mean, "model int, chunk int, change binary").collect():
            _changed(models[r["model"]], r["chunk"], np.frombuffer(r["change"], np.float32))
        state.unpersist()
    folded = all(0 < b < a for a, b in zip(n, n1, strict=True))  # else too few texts for folds
    cuts = words.mapInArrow(X.task(_cuts(sc.broadcast((models, maps, folded)))), "lang int, step long, n long, pos long")
    cuts = cuts.groupBy("lang", "step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()
    lang, cut = cuts["lang"].to_numpy(), [cuts[c].to_numpy() for c in ("step", "n", "pos")]
    m = models[FOLDS]
    for k in range(len(m.offsets)):
        own = lang == k
        m.offsets[k] = _threshold(*[c[own] for c in cut]) if cut[1][own].sum() >= 40 else _threshold(*cut)
    return m


def _score(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in X.blocks(batches, "text", 1 << 20):
            score = model.value.scores(*hashed(t["text"]))
            held = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in t["doc_id"].to_pylist()]
            keep = {c: t[c].combine_chunks() for c in t.column_names}
            keep |= {"held_out": pa.array(held, pa.bool_()), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32), pa.int32())}
            yield pa.RecordBatch.from_arrays(list(keep.values()), names=list(keep))

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """documents with held_out, score and predicted; columns of those names are replaced, all others are kept.

    Null and empty texts are scored as texts without words. Rows with one doc_id are scored one by one, by their texts alone. A null doc_id
    is not held out (null); sample and sample_words only set how many learn at a time (see train). Labels without a document, null labels and further columns of labels are ignored; without labels of
    both kinds all texts score alike. An empty table gives an empty result.
    """
    docs = documents.drop("held_out", "score", "predicted")
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, sample_words))
    X.let_go()  # the driver too goes on to other work
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(X.task(_score(model)), schema + ", held_out boolean, score double, predicted int")
