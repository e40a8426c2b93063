"""Shingle sets of texts, their group signatures and count vectors, in numpy.

Shingles are dealt to groups by hash. Two sets with few differences agree in some group wholly if there are more groups than
differences, so sets of similar size that are similar enough share the signature (hash of all shingles) of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidemark.llm import textops as X

#: Ratio of the sizes that one band spans; a set near the top of its band joins the next band too.
BAND = 1.4
GROUPS = 128
#: Groups that most sets fill beyond those that they must, so that as many signatures that very many sets share can be left out.
SPARE = 2


@dataclass(frozen=True)
class Similarity:
    """Sets of words-long shingles link when den * |a & b| >= num * |a | b|."""

    words: int
    num: int
    den: int

    def most_apart(self, larger: np.ndarray) -> np.ndarray:
        """The most elements that only one of two linked sets holds, if neither has more than larger elements."""
        return 2 * larger * (self.den - self.num) // (self.den + self.num)

    def parts(self, band: int) -> int:
        """Groups of a band: so many that also its smallest sets mostly fill more of them than can differ."""
        apart = int(self.most_apart(tops(np.array(band))))
        if not apart:
            return 1
        least = max(1.0, BAND**band * self.num / self.den)
        p = apart + 2
        while p < 4 * least and p * (1 - np.exp(-least / p)) - 2 * np.sqrt(p * np.exp(-least / p)) < apart + SPARE + 1:
            p += 1 + p // 50
        return p

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap with which sets of a and b elements link."""
        return -(-(a + b) * self.num // (self.den + self.num))


def shingles(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin. A text of fewer words is one shingle."""
    data, off = X.texts(column)
    starts, ends, first = X.words(data, off)
    h = X.word_hash(X.LOWER[data], starts, ends)
    n = np.diff(first)
    doc, values = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    if len(h) >= width:
        at = np.flatnonzero(X.inside(first, width, len(h)))
        values.append(X.window_hash(h, width)[at])
        doc.append(np.searchsorted(first, at, side="right") - 1)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        pre = X.prefix(h.copy())
        values.append(X.mix(X.spans(pre, first[short], first[short + 1]) + n[short].astype(np.uint64)))
        doc.append(short)
    d, v = np.concatenate(doc), np.concatenate(values)
    order = np.lexsort((v, d))
    d, v = d[order], v[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return v[new], np.searchsorted(d[new], np.arange(len(n) + 1))


def set_keys(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of 128 bits for each set, as two columns: sums of two unlike hashes of its shingles."""
    out = []
    for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(v ^ np.uint64(c)))))
        out.append(X.mix(s[first[1:]] - s[first[:-1]]))
    return np.stack(out, 1)


def as_binary(keys: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """Keys (n, 2) as a binary column of 16 bytes each, null where none."""
    off = pa.py_buffer((np.arange(len(keys) + 1) * 16).astype(np.int32).tobytes())
    valid = None if none is None else pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(keys), [valid, off, pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


def from_binary(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The keys of a binary column without nulls."""
    raw = b"".join(x.as_py() for x in column)
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def count_vectors(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall into each of GROUPS groups."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    group = (v >> np.uint64(57)).astype(np.int64)
    return np.bincount(doc * GROUPS + group, minlength=n * GROUPS).reshape(n, GROUPS)


def parities(v: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set the parities of how many of its shingles fall into each of w groups, w a power of two of four times its size or more."""
    size = np.diff(first)
    width = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(4 * size, 1))).astype(np.int64))
    base = np.cumsum(width) - width
    slot = np.repeat(base, size) + (v & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(slot, minlength=int(width.sum())) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[a : a + n] for a, n in zip((base // 8).tolist(), (width // 8).tolist(), strict=True)]


def least_apart(vectors: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound, by their parities, of how many shingles only one of each pair of sets holds: each odd group holds one at least."""
    width = np.array([len(x) for x in vectors], np.int64)
    both, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(both).tolist():
        pairs = np.flatnonzero(both == w)
        used, back = np.unique(np.concatenate((i[pairs], j[pairs])), return_inverse=True)
        # a wider vector folds: its groups are parts of the narrower one's
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(vectors[x], np.uint64).reshape(-1, w // 8), axis=0) for x in used.tolist()])
        a, b = back.reshape(2, -1)
        for k in range(0, len(pairs), 8192):
            out[pairs[k : k + 8192]] = np.bitwise_count(table[a[k : k + 8192]] ^ table[b[k : k + 8192]]).sum(1)
    return out


def tops(band: np.ndarray) -> np.ndarray:
    """A size that no set of the band exceeds."""
    return np.floor(BAND ** (band + 1.0) + 1).astype(np.int64)


def bands(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


def signatures(sim: Similarity, v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, deal, spare) for each group of each set, in its band and, if a linked set can be in the next, in that one.

    With more groups than differences some group has none, but only one that isn't empty tells so. A set that has more filled groups than differences shares one
    with every linked set that is dealt likewise; one that has not is dealt again by another hash, and so on until it has. As a set gives the signatures of all its
    deals up to that one, any linked pair meets in the deal that serves the one that needed fewer.

    A linked pair differs in so many filled groups of a deal at most, whichever they are. So of all signatures of the deal in any fixed order, it shares one that is
    not among the last spare of either set: spare is the number of filled groups beyond the differences and one.
    """
    size = np.diff(first)
    own = bands(size)
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 4]
    for up in (0, 1):
        band = own + up
        use = (size > 0) & (bands(size * sim.den // sim.num) > own) if up else size > 0
        apart = sim.most_apart(tops(band))
        parts = np.array([sim.parts(b) for b in np.unique(band)], np.int64)[np.unique(band, return_inverse=True)[1]]
        deal = 0
        while use.any():
            docs = np.flatnonzero(use)
            n, k = size[docs], parts[docs]
            base = np.cumsum(k) - k
            values = v[np.arange(int(n.sum())) + np.repeat(first[docs] - (np.cumsum(n) - n), n)]
            slot = np.repeat(base, n) + (X.mix(values + np.uint64(deal + 1)) % np.repeat(k, n).astype(np.uint64)).astype(np.int64)
            order = np.argsort(slot)
            slot = slot[order]
            cut = np.flatnonzero(np.diff(slot, prepend=-1))
            total = np.add.reduceat(X.mix(values[order] ^ np.uint64(0x5851F42D4C957F2D)), cut)
            slot = slot[cut]  # the filled groups
            doc = np.searchsorted(base, slot, side="right") - 1
            place = ((band[docs] * 64 + deal) << 32)[doc] + slot - base[doc]
            filled = np.bincount(doc, minlength=len(docs))
            spare = np.maximum(0, filled - apart[docs] - 1)[doc]
            out.append([docs[doc], X.mix(total + X.mix(place.astype(np.uint64))).view(np.int64), place >> 32, spare])
            use[docs[filled > apart[docs]]] = False
            deal += 1
    doc, sig, unit, spare = (np.concatenate(x) for x in zip(*out, strict=True))
    return doc, sig, unit, spare
