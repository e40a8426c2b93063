"""Token ids as directly addressable codes: a file format with random access to every id.

An id is split into chunks of eight bits. Level 0 holds the low chunk of each id, level 1 the next chunk of the ids that
have one, and so on; a bitmap a level tells which ids go on, and a rank directory (counts before every 512th bit) finds the
place of an id on the next level. Reading id i needs one chunk and one rank on each of its levels, and no decoding of others.

Ids come from the tokenizers library. The tokenizer drops white space and never joins across it, so a text's ids are those
of its words one after another; each task encodes a distinct word once and looks the others up.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textops as X

MAGIC = b"TDAC1\0\0\0"
STEP = 512
SHARD_TOKENS = 1 << 19
KNOWN_WORDS = 5 << 18
BLOCK_BYTES = 1 << 20
END = 2
#: Characters of a text that part rows with equal doc_ids between tasks; their order is that of whole texts.
HEAD = 64


def dac_encode(ids: np.ndarray) -> bytes:
    """ids (below 2**32) in the format: magic, number of levels, then for each level its size, chunks, bitmap and directory."""
    left, levels = ids.astype(np.uint32), []
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % 8, np.uint8)))
        before = np.concatenate(([0], np.cumsum(more)))[::STEP].astype(np.uint32)
        levels.append(struct.pack("<q", len(left)) + (left & 255).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<q", len(levels)) + b"".join(levels)
        left = left[more] >> np.uint32(8)


class DacReader:
    """Random access to the ids of one encoded sequence."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("no token file")
        (n,), at, self.levels = struct.unpack_from("<q", raw, 8), 16, []
        for _ in range(n):
            (size,) = struct.unpack_from("<q", raw, at)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, size, at)
            at += size
            words = -(-size // 64)
            bits = np.frombuffer(raw, np.uint8, 8 * words, at)
            at += 8 * words
            before = np.frombuffer(raw, np.uint32, (size + STEP) // STEP, at)
            at += 4 * len(before)
            self.levels.append((chunks, bits, before))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, before) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            a, b = i // STEP * STEP // 8, i >> 3
            i = int(before[i // STEP]) + int(np.bitwise_count(bits[a:b]).sum()) + int(bits[b] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, level by level."""
        out, at, lo, hi = np.zeros(stop - start, np.uint32), np.arange(stop - start), start, stop
        for level, (chunks, bits, before) in enumerate(self.levels):
            if hi <= lo:
                break
            out[at] |= chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            a = lo // STEP * STEP
            more = np.unpackbits(bits[a // 8 : -(-hi // 8)], bitorder="little")[: hi - a]
            skip = int(more[: lo - a].sum())
            more = more[lo - a :]
            lo = int(before[a // STEP]) + skip
            hi = lo + int(more.sum())
            at = at[more == 1]
        return out


#: 0 for a to z, 1 for A to Z and bytes above 127, else 2.
_KIND = np.full(256, 2, np.uint8)
_KIND[97:123], _KIND[65:91] = 0, 1
_KIND[128:] = 1


#: The characters that stand for bytes in the tokenizer's pieces: printable bytes are themselves, the others follow from U+0100 on.
_SHOWN = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
_OTHERS = sorted(set(range(256)) - _SHOWN)
_BYTE = {b: 256 + k for k, b in enumerate(_OTHERS)}


def _is_letters(word: str) -> bool:
    return word.lower().isalpha() and unicodedata.is_normalized("NFC", word)


def _is_one_piece(word: str) -> bool:
    """Do the tokenizer's first steps leave this word as it is, in one piece? Lower-case letters that old tables and new ones call so."""
    old = unicodedata.ucd_3_2_0
    letters = word.isalpha() and all(c.lower() == c and old.category(c)[0] == "L" for c in word)
    return letters and old.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", word)


class Vocabulary:
    """Ids of words, each distinct word encoded by the library once; forgets all after KNOWN_WORDS words."""

    def __init__(self, file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.clear()

    def clear(self) -> None:
        self.h1 = self.h2 = np.empty(0, np.uint64)
        self.at, self.size, self.pool = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint32)

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return np.full(len(h1), -1)
        i = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[i] == h1) & (self.h2[i] == h2), i, -1)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words hold no white space."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        starts = ends - np.array([len(x) for x in raw], np.int64)
        pool, at, size = self.encode_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
        return [pool[a : a + n].tolist() for a, n in zip(at.tolist(), size.tolist(), strict=True)]

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in any order, and where each word's begin and how many they are."""
        raw = X.gather(data, starts, ends, 1)
        edge = np.concatenate(([0], np.cumsum(ends - starts + 1)))
        kind = _KIND[raw]
        kind[edge[1:] - 1] = 0
        worst = np.maximum.reduceat(kind, edge[:-1]) if len(starts) else kind
        high = np.flatnonzero(worst == 1)
        spelt = [raw[a:b].tobytes().decode() for a, b in zip(edge[high].tolist(), (edge[high + 1] - 1).tolist(), strict=True)]
        whole = np.array([_is_one_piece(w) for w in spelt], bool)
        near = np.concatenate((np.flatnonzero(worst == 0), high[whole]))
        # NFC, the tokenizer's first step, makes a letter and a mark of some letters, which are pieces of their own
        far = np.array([k for k, w, done in zip(high.tolist(), spelt, whole.tolist(), strict=True) if not done and _is_letters(w)], np.int64)
        rest = [np.setdiff1d(np.flatnonzero(worst > 0), np.concatenate((far, high[whole])), assume_unique=True)]
        size, at, pool, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [np.empty(0, np.uint32)], 0

        def keep(words: np.ndarray, n: np.ndarray, ids: list[int]) -> None:
            nonlocal total
            size[words], at[words] = n, total + np.cumsum(n) - n
            pool.append(np.array(ids, np.uint32))
            total += len(ids)

        def words_at(part: np.ndarray) -> str:
            return X.gather(raw, edge[part], edge[part + 1])[:-1].tobytes().decode()

        tokenize = self.tokenizer.model.tokenize
        for i in range(0, len(near), 2000):  # what the tokenizer's first steps leave as it is: its model can start at once, on bytes shown as characters
            part = near[i : i + 2000]
            shown = X.gather(raw, edge[part], edge[part + 1])[:-1].tobytes().decode("latin-1").split(" ")
            got = [[t.id for t in tokenize(w if w.isascii() else w.translate(_BYTE))] for w in shown]
            keep(part, np.array([len(x) for x in got], np.int64), list(chain.from_iterable(got)))
        for i in range(0, len(far), 200):  # letters alone are one piece each, so many can share a call
            part = far[i : i + 200]
            e = self.tokenizer.encode(words_at(part), add_special_tokens=False)
            n = np.bincount(np.array(e.word_ids, np.int64))
            if len(n) != len(part):  # a word has one piece at least, so some word here has more
                rest.append(part)
            else:
                keep(part, n, e.ids)
        left = np.concatenate(rest)
        for i in range(0, len(left), 2000):
            part = left[i : i + 2000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words_at(part).split(" "), add_special_tokens=False)]
            keep(part, np.array([len(x) for x in got], np.int64), list(chain.from_iterable(got)))
        return np.concatenate(pool), at, size

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        h1, h2 = X.word_hash(data, starts, ends, 0), X.word_hash(data, starts, ends, 1)
        _, one, back = np.unique(h1, return_index=True, return_inverse=True)
        if (h2 != h2[one][back]).any():  # two words share a hash: tell them apart by both
            _, one, back = np.unique(np.stack((h1, h2), 1), axis=0, return_index=True, return_inverse=True)
            back = back.reshape(-1)
        k1, k2 = h1[one], h2[one]
        if len(self.h1) > KNOWN_WORDS:
            self.clear()
        new = np.flatnonzero(self._find(k1, k2) < 0)
        if len(new):
            pool, at, size = self.encode_spans(data, starts[one[new]], ends[one[new]])
            at += len(self.pool)
            self.pool = np.concatenate((self.pool, pool))
            where = np.searchsorted(self.h1, k1[new])  # k1 is ascending, so the words stay in order
            self.h1, self.h2 = np.insert(self.h1, where, k1[new]), np.insert(self.h2, where, k2[new])
            self.at, self.size = np.insert(self.at, where, at.astype(np.uint32)), np.insert(self.size, where, size.astype(np.uint32))
        i = self._find(k1, k2)
        if (i < 0).any():  # only where hashes clash; encode those words directly
            pool, at, size = self.encode_spans(data, starts[one], ends[one])
        else:
            pool, at, size = self.pool, self.at[i].astype(np.int64), self.size[i].astype(np.int64)
        size, at = size[back], at[back]
        before = np.cumsum(size) - size
        return pool[np.arange(int(size.sum())) + np.repeat(at - before, size)], size


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True


def cut_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a stop after an ASCII letter or digit as two: the tokenizer always parts them, and fewer words are distinct."""
    if not len(starts):
        return starts, ends, first
    cut = (ends - starts > 1) & _STOP[data[ends - 1]] & _ALNUM[data[np.maximum(ends - 2, 0)]]
    before = np.concatenate(([0], np.cumsum(cut)))
    at = np.flatnonzero(cut)
    new_starts = np.insert(starts, at + 1, ends[at] - 1)
    new_ends = np.insert(ends, at, ends[at] - 1)
    return new_starts, new_ends, first + before[first]


@cache
def _vocabulary(file: str) -> Vocabulary:
    """One for all tasks of a worker, which looks this function up by its name: the library keeps some memory of each tokenizer that was used and dropped."""
    return Vocabulary(file)


def encode_block(vocabulary: Vocabulary, column: pa.ChunkedArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, each followed by end, and how many each text has."""
    data, off = X.texts(column)
    if b"<|" not in data.tobytes():  # lower case is the tokenizer's first step for all but its special tokens
        data = X.LOWER[data]
    starts, ends, first = cut_stops(data, *X.words(data, off))
    ids, size = vocabulary.ids(data, starts, ends)
    edge = np.concatenate(([0], np.cumsum(size)))[first]
    return np.insert(ids, edge[1:], end), np.diff(edge) + 1


def _pack(file: str, end: int, shard_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file)
        part, seq, start, docs, sizes, ids = TaskContext.get().partitionId(), 0, 0, [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal seq, start, docs, sizes, ids
            all_ids = np.concatenate(ids)
            row = [[part], [seq], [start], [pa.chunked_array(docs).to_pylist()], [np.concatenate(sizes).tolist()], [dac_encode(all_ids)]]
            seq, start, docs, sizes, ids = seq + 1, start + len(all_ids), [], [], []
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "seq", "start", "doc_ids", "sizes", "codes"])

        try:
            for t in X.blocks(batches, "text", BLOCK_BYTES):
                i, n = encode_block(vocabulary, t["text"], end)
                docs.append(t["doc_id"].combine_chunks())
                sizes.append(n)
                ids.append(i)
                if sum(map(len, ids)) >= shard_tokens:
                    yield shard()
            if ids:
                yield shard()
        finally:
            vocabulary.clear()  # words go with the task

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write token shards to path in ascending doc_id order.

    A shard is one row: part and seq give its place, start the ids of its part before it, doc_ids and sizes its documents in
    order, codes the ids as directly addressable codes. Null texts are empty and still get their end id. Null doc_ids come
    first, rows with equal doc_ids in the order of their texts: tasks part them by the texts' first HEAD characters. Further columns are ignored; an empty table gives no shards.
    """
    docs = documents.select("doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.repartitionByRange(parts, "doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    shards = docs.mapInArrow(X.task(_pack(tokenizer, end, shard_tokens)), "part int, seq int, start long, doc_ids array<bigint>, sizes array<bigint>, codes binary")
    shards.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            read, sizes = DacReader(row["codes"]), np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            ids = read.slice(0, len(read)).astype("<u4")
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards at path."""
    shards = spark.read.parquet(path)
    # one row a part: as many rows as the writing job had partitions
    ends = shards.groupBy("part").agg(F.max(F.col("start") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    rows = sorted((r.part, r.n) for r in ends.collect())
    before, base = 0, []
    for part, n in rows:
        base.append((part, before))
        before += n
    bases = spark.createDataFrame(base, "part int, base long")
    docs = shards.select("part", "start", "doc_ids", "sizes", "codes").mapInArrow(X.task(_unpack), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, places: list[tuple[int, int, int]]) -> DataFrame:
    """Single ids by (part, seq, place in the shard), each read without decoding the rest of its shard."""
    want = spark.createDataFrame(places, "part int, seq int, place long")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(r["part"], r["seq"], p, DacReader(r["codes"])[p]) for r in batch.to_pylist() for p in r["places"]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * 4, names=["part", "seq", "place", "id"])

    asked = want.groupBy("part", "seq").agg(F.collect_list("place").alias("places"))
    return spark.read.parquet(path).join(asked, ["part", "seq"]).select("part", "seq", "places", "codes").mapInArrow(X.task(pick), "part long, seq long, place long, id long")
