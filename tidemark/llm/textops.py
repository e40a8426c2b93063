"""Vectorised text helpers shared by the operators: blocks of texts, words, polynomial hashes.

A block is one byte buffer that holds many texts, each followed by one space.
Hashes are polynomials over random 64-bit byte values modulo 2**64, so that the hash of any
span comes from two prefix sums; two independent tables give 128 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.shared import kept, new_path, shared_folder, written  # noqa: F401

BLOCK_BYTES = 2 << 20
#: Powers are computed so many at a time: small tasks hold few, and blocks that differ little don't compute them anew.
POWERS_STEP = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240607)
TABLES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes: words of op1/op3/op5/op7 are runs of anything but white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words of op8: ASCII letters and digits and every byte above 127.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents 0 .. n - 1 at least."""
    if len(_POWERS[0]) < n:
        n = -(-n // POWERS_STEP) * POWERS_STEP
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.empty(0, np.uint64)
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, out=p)
    return _POWERS[0], _POWERS[1]


def let_go() -> None:
    """Give back the memory that a finished task leaves in its worker process, which goes on to serve other stages."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    trim_memory()


def trim_memory() -> None:
    """What was freed goes back to the system instead of staying with the process."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, such that a worker holds no more memory after a task than before."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return lean


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value[i] * BASE**i; values is overwritten."""
    pw, _ = powers(len(values) + 1)
    values *= pw[: len(values)]
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of value[start:end], equal for equal spans wherever they stand."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start])


def window_hash(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width tokens, one for each start."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    pre = prefix(tokens.copy())
    return mix((pre[width:] - pre[:n]) * powers(len(pre))[1][:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[width - size : width - size + n])


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer with a space after each text (null: empty), and the offset of each text and of the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    off = off - off[0]
    out = np.full(len(data) + len(column), 32, np.uint8)
    at = np.ones(len(out), bool)
    at[off[1:] + np.arange(len(column))] = False
    out[at] = data
    return out, off + np.arange(len(off))


def blocks(batches: Iterable[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of batches again, as tables whose texts hold about size bytes (one longer text: one table)."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        trim_memory()
        length = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(length)
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + size - held, side="right")))
            j = min(j, batch.num_rows)
            kept.append(batch.slice(i, j - i))
            held += int(ends[j - 1] - base)
            i = j
            if held >= size or i < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept, held = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and the first word of each text (and of the end)."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = kind[data]
    step = np.diff(mask)
    starts = np.flatnonzero(step == 1)
    ends = np.flatnonzero(step == -1)
    return starts, ends, np.searchsorted(starts, off)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    return spans(prefix(TABLES[table][data]), starts, ends)


def inside(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each start of a window over total tokens: does the window stay within one text?"""
    ok = np.zeros(max(total - width + 1, 0) + 1, np.int32)
    a, b = first[:-1], first[1:] - width + 1
    good = b > a
    np.add.at(ok, a[good], 1)
    np.add.at(ok, b[good], -1)
    return np.cumsum(ok[:-1]) > 0


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int = 0) -> np.ndarray:
    """The spans of data one after another, each followed by gap spaces."""
    length = ends - starts + gap
    total = int(length.sum())
    out = np.empty(total, data.dtype)
    at = np.cumsum(length) - length
    i = 0
    while i < len(starts):  # in pieces, so that the index stays small
        j = max(i + 1, int(np.searchsorted(at, at[i] + (2 << 20))))
        n = length[i:j]
        idx = np.arange(int(n.sum())) + np.repeat(starts[i:j] - (at[i:j] - at[i]), n)
        np.minimum(idx, len(data) - 1, out=idx)
        out[at[i] : at[i] + len(idx)] = data[idx]
        i = j
    for g in range(gap):
        out[at + length - 1 - g] = 32
    return out


def merged(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in any of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.clip(start, 0, n), 1)
    np.add.at(d, np.clip(end, 0, n), -1)
    return np.cumsum(d[:n]) > 0


def keyed(documents, *more: str):
    """documents as (doc_id, text_key, text): text_key tells rows with one doc_id apart, and any other columns go."""
    from pyspark.sql import functions as F

    return documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text", *more)


def same_row(a, b):
    """Join condition of two keyed() frames; a null doc_id equals a null doc_id."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
