"""Windows of a fixed number of tokens that occur more than once anywhere: substring dedup (words) and suffix dedup (bytes).

Both operators deal windows to buckets by minimiser: the least hash of the short grams in the window. Windows that are
equal have equal minimisers, so equal windows meet in one bucket, and consecutive windows that share their minimiser
travel as one packed string, about three times the text in all. Each map task first compares the windows of a block
among themselves and sends one of each, marked when it was repeated, so that a passage that a third of the documents
share reaches its bucket once a block. A bucket that still outgrows CHUNK_BYTES is read in chunks; the windows that a chunk
can't decide alone, one of each, are dealt again in the same form, by minimisers of another order of the grams and to many
more buckets. What outgrows its bucket LEVELS times goes on as rows of (digest of the window, place), which Spark groups.

The two operators differ in how they find equal windows: `substring` sorts the windows of a bucket by hash, `suffix` orders
suffixes by most-significant-digit radix passes and drops a suffix once it is alone. Both then hold the groups against the
tokens themselves.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as X

BUCKET_BYTES = 12 << 20
CHUNK_BYTES = 36 << 20
#: Text of a block where tokens are words, and where they are bytes: a token takes some hundred bytes of working memory.
BLOCK_WORDS, BLOCK_BYTES = 3 << 20, 1 << 20
SHUFFLED = "bucket long, kind int, doc_id long, text_key long, h1 long, h2 long, start int, stop int, dup boolean, blob binary"
SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("dup", pa.bool_()), ("blob", pa.binary())])
BLOB, SPAN, LOOSE = 0, 1, 2
#: How often a bucket that outgrew its chunk is dealt again, and to how many times as many buckets.
LEVELS, SPREAD = 3, 16
#: Bytes of a radix digit where windows are long.
CODED = 80


@dataclass(frozen=True)
class Windows:
    """length tokens a window, minimisers of gram tokens; tokens are bytes or words."""

    length: int
    gram: int
    by_words: bool

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The data to compare, starts and ends of its tokens, and the first token of each text."""
        if not self.by_words:
            at = np.arange(len(data))
            return data, at, at + 1, off
        starts, ends, first = X.words(data, off)
        data = X.gather(data, starts, ends, gap=1)  # words, each followed by one space
        ends = np.cumsum(ends - starts + 1)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return data, starts, ends - 1, first

    def last(self, first: np.ndarray) -> np.ndarray:
        """The end of each text's tokens; the space after a text is no token."""
        return first[1:] if self.by_words else first[1:] - 1


def _valid(first: np.ndarray, last: np.ndarray, length: int, total: int) -> np.ndarray:
    d = np.zeros(max(total, 0) + 1, np.int32)
    good = last - first[:-1] >= length
    np.add.at(d, first[:-1][good], 1)
    np.add.at(d, (last - length + 1)[good], -1)
    return np.cumsum(d)[:total] > 0


def _values(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int) -> np.ndarray:
    return X.word_hash(data, starts, ends, table) if w.by_words else X.TABLES[table][data]


def _by_hash(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A label for each window position: equal for equal windows, -1 for a window that is alone. Sorts by two hashes of 64
    bits; the groups are then held against the words, and where hashes clash, the words decide."""
    h = [X.spans(X.prefix(_values(w, data, starts, ends, t)), pos, pos + w.length) for t in (0, 1)]
    order = np.lexsort((h[1], h[0]))
    new = np.ones(len(pos), bool)
    new[1:] = (h[0][order[1:]] != h[0][order[:-1]]) | (h[1][order[1:]] != h[1][order[:-1]])
    group = np.cumsum(new) - 1
    group[np.bincount(group)[group] < 2] = -1
    out = np.empty(len(pos), np.int64)
    out[order] = group
    if _agree(data, starts, ends, pos, out, w.length):
        return out
    texts: dict[bytes, int] = {}
    some = np.flatnonzero(out >= 0)
    out[some] = [texts.setdefault(data[a:b].tobytes(), len(texts)) for a, b in zip(starts[pos[some]].tolist(), ends[pos[some] + w.length - 1].tolist(), strict=True)]
    out[some[np.bincount(out[some])[out[some]] < 2]] = -1
    return out


def _codes(data: np.ndarray, step: int = 2 << 20) -> np.ndarray:
    """The code of the CODED bytes from each byte on, made in pieces so that the working memory stays small."""
    out = np.zeros(max(0, len(data) - CODED + 1), np.uint64)
    for i in range(0, len(out), step):
        out[i : i + step] = X.window_hash(X.TABLES[0][data[i : i + step + CODED - 1]], CODED)
    return out


def _radix_passes(digit: Callable[[np.ndarray], np.ndarray], depths: list[int], pos: np.ndarray) -> np.ndarray:
    """Most-significant-digit passes: groups of suffixes that agree in all digits, -1 for a suffix that is alone in its group.

    A group whose suffixes agree in a digit needs no sorting in that pass; a suffix that is alone leaves.
    """
    if len(pos) < 2:
        return np.full(len(pos), -1, np.int64)
    at, group = np.arange(len(pos), dtype=np.int32), np.zeros(len(pos), np.int32)
    for depth in depths:
        if not len(at):
            break
        d = digit(pos[at] + depth)
        unlike = np.flatnonzero(d[1:] != d[:-1])
        unlike = unlike[group[unlike + 1] == group[unlike]]
        if not len(unlike):  # every group agrees in this digit
            continue
        if not group[-1]:  # one group
            order = np.argsort(d)
            at, d = at[order], d[order]
        else:
            odd = np.zeros(int(group[-1]) + 1, bool)
            odd[group[unlike]] = True
            sub = np.flatnonzero(odd[group])
            order = sub[np.lexsort((d[sub], group[sub]))]
            at[sub], d[sub] = at[order], d[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1])
        more = ~(new & np.append(new[1:], True))  # not alone
        at, group = at[more], np.cumsum(new[more], dtype=np.int32) - np.int32(1)
    out = np.full(len(pos), -1, np.int64)
    out[at] = group
    return out


def _agree(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pos: np.ndarray, group: np.ndarray, length: int) -> bool:
    """Does every window of a group equal the group's first byte by byte? Neighbours with one distance to it are read together."""
    i = np.flatnonzero(group >= 0)
    order = i[np.lexsort((pos[i], group[i]))]
    lead = np.flatnonzero(np.diff(group[order], prepend=-1))
    p, back = pos[order], np.repeat(pos[order[lead]], np.diff(np.append(lead, len(order))))
    far = p != back
    p, back = p[far], back[far]
    if not len(p):
        return True
    order = np.argsort(p, kind="stable")
    p, back = p[order], back[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (back[1:] != back[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(p)) - 1
    one, two = starts[p[a]], starts[back[a]]
    n = ends[p[z] + length - 1] - one
    if (n != ends[back[z] + length - 1] - two).any():
        return False
    for lo, hi in _pieces(n, 1 << 21):
        i, j = _explode(one[lo:hi], n[lo:hi]), _explode(two[lo:hi], n[lo:hi])
        if (data[i] != data[j]).any():
            return False
    return True


def _pieces(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _by_radix(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """As _by_hash, but by depth-limited radix sort: one pass for each digit, down to the window's length.

    A digit is the code (a hash) of CODED bytes, so a window of 400 takes five passes; the groups are then held against the
    bytes themselves. Should two unlike digits share a code, the passes are run again with the bytes as digits, eight each.
    """
    if w.length >= 2 * CODED:
        codes = _codes(data)
        out = _radix_passes(lambda at: codes[at], [*range(0, w.length - CODED, CODED), w.length - CODED], pos)
        del codes
        if _agree(data, starts, ends, pos, out, w.length):
            return out
    digits = np.zeros(len(data), np.uint64)
    for k in range(8):
        digits[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * max(0, 8 - w.length))
    return _radix_passes(lambda at: digits[at] & keep, [*range(0, w.length - 8, 8), max(0, w.length - 8)], pos)


def _explode(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers, for each i."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


def _table(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)


def _spans_of(hit: np.ndarray, run: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that are hit: (index of the first, first token, last window's token)."""
    i = np.flatnonzero(hit)
    if not len(i):
        return i, i, i
    new = np.ones(len(i), bool)
    new[1:] = (run[i[1:]] != run[i[:-1]]) | (start[i[1:]] != start[i[:-1]] + 1)
    a = np.flatnonzero(new)
    b = np.concatenate((a[1:], [len(i)])) - 1
    return i[a], start[i[a]], start[i[b]]


@dataclass
class Placed:
    """Windows by the token of data that they start at, the text (or run) that each is of, its first token's number there, and what
    is known of it (mark): 0 nothing, 1 repeated, 2 not to be sent. ids, nulls and keys name the texts."""

    win: np.ndarray
    of: np.ndarray
    place: np.ndarray
    mark: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray
    keys: np.ndarray


def _orders(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, win: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each window's minimiser, in the order of grams of the level."""
    grams = X.window_hash(_values(w, data, starts, ends, 0), w.gram)
    if level:
        grams = X.mix(grams + np.uint64(level))
    # low bits of the sort key hold the place, so that a text that repeats itself makes a run for each occurrence
    low = np.uint64((1 << len(grams).bit_length()) - 1)
    place = X.sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), w.length - w.gram + 1)[win] & low
    return place, grams[place.astype(np.int64)]


def _cut(p: Placed, place: np.ndarray) -> np.ndarray:
    """Where runs start: consecutive windows of a text with one minimiser and one mark."""
    new = np.ones(len(p.win), bool)
    new[1:] = (place[1:] != place[:-1]) | (p.mark[1:] != p.mark[:-1]) | (p.win[1:] != p.win[:-1] + 1) | (p.of[1:] != p.of[:-1])
    return np.flatnonzero(new)


def _blobs(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: Placed, place: np.ndarray, least: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The runs of windows to be sent, packed by bucket."""
    pack = zstandard.ZstdCompressor(level=5)
    a = _cut(p, place)
    n = np.diff(np.append(a, len(p.win)))
    send = p.mark[a] < 2
    a, n = a[send], n[send]
    bucket = (least[a] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    a, n, bucket = a[order], n[order], bucket[order]
    begin, stop = starts[p.win[a]], ends[p.win[a] + n - 1 + w.length - 1]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows: list[tuple[int, bytes]] = []
    for i, j in zip(cuts, [*cuts[1:], len(a)], strict=True):
        r, d = a[i:j], p.of[a[i:j]]
        head = [p.ids[d].astype(np.int64), p.nulls[d].astype(np.int8), p.keys[d].astype(np.int64), (least[r] >> np.uint64(32)).astype(np.uint32), p.place[r].astype(np.int32), n[i:j].astype(np.int32), (stop - begin)[i:j].astype(np.int32), p.mark[r].astype(np.int8)]
        body = b"".join(x.tobytes() for x in head) + X.gather(data, begin[i:j], stop[i:j], gap=1).tobytes()
        rows.append((int(bucket[i]), struct.pack("<qq", j - i, len(body)) + pack.compress(body)))
    if rows:
        yield _table(len(rows), bucket=[b for b, _ in rows], kind=np.full(len(rows), BLOB), blob=[x for _, x in rows])


def _deal(w: Windows, label: Callable, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in X.blocks(batches, "text", BLOCK_WORDS if w.by_words else BLOCK_BYTES):
            data, off = X.texts(t["text"])
            data, starts, ends, first = w.tokens(data, off)
            last, total = w.last(first), len(starts) - w.length + 1
            if total <= 0:
                continue
            win = np.flatnonzero(_valid(first, last, w.length, total))
            if not len(win):
                continue
            of = np.searchsorted(first, win, side="right") - 1
            p = Placed(win, of, win - first[of], np.zeros(len(win), np.int8), t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_null().to_numpy(), t["text_key"].to_numpy())
            place, least = _orders(w, data, starts, ends, win, 0)
            a = _cut(p, place)
            n = np.diff(np.append(a, len(win)))
            _, inverse, times = np.unique(least[a], return_inverse=True, return_counts=True)
            shared = times[inverse] > 1
            if shared.any():
                some = _explode(a[shared], n[shared])
                group = label(w, data, starts, ends, win[some])
                again = np.flatnonzero(group >= 0)
                if len(again):
                    _, lead = np.unique(group[again], return_index=True)
                    p.mark[some[again]] = 2
                    p.mark[some[again[lead]]] = 1
                    i, s, e = _spans_of(p.mark > 0, of, win)
                    d = of[i]
                    yield _table(len(i), bucket=(np.arange(len(i)) * 7919 + int(least[0] % np.uint64(1 << 20))) % n_buckets, kind=np.full(len(i), SPAN), doc_id=pa.array(p.ids[d], mask=p.nulls[d]), text_key=p.keys[d], start=s - first[d], stop=e - first[d] + w.length)
            yield from _blobs(w, data, starts, ends, p, place, least, n_buckets)

    return run


def _runs(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    heads: list[list[np.ndarray]] = []
    bodies: list[np.ndarray] = []
    unpack = zstandard.ZstdDecompressor()
    for b in blobs:
        n, size = struct.unpack_from("<qq", b)
        raw = np.frombuffer(unpack.decompress(b[16:], max_output_size=size), np.uint8)
        at, head = 0, []
        for kind in (np.int64, np.int8, np.int64, np.uint32, np.int32, np.int32, np.int32, np.int8):
            width = np.dtype(kind).itemsize * n
            head.append(np.frombuffer(raw[at : at + width].tobytes(), kind))
            at += width
        heads.append(head)
        bodies.append(raw[at:])
    return [np.concatenate(x) for x in zip(*heads, strict=True)], np.concatenate(bodies)


def _settle(w: Windows, label: Callable, blobs: list[bytes], whole: bool, level: int, levels: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The spans that the windows of these blobs decide; if they aren't the whole bucket, also what others may decide."""
    (ids, nulls, keys, least, start, n, size, dup), data = _runs(blobs)
    begin = np.cumsum(size.astype(np.int64) + 1) - size - 1
    if whole:
        _, inverse, times = np.unique(least, return_inverse=True, return_counts=True)
        pick = np.flatnonzero(times[inverse] > 1)
        if not len(pick):
            return
        data = X.gather(data, begin[pick], begin[pick] + size[pick], gap=1)
        ids, nulls, keys, start, n, size, dup = (x[pick] for x in (ids, nulls, keys, start, n, size, dup))
        begin = np.cumsum(size.astype(np.int64) + 1) - size - 1
    if w.by_words:
        starts, ends, first = X.words(data, begin)
    else:
        starts = np.arange(len(data))
        ends, first = starts + 1, begin
    n = n.astype(np.int64)
    run, pos = np.repeat(np.arange(len(n)), n), _explode(first.astype(np.int64), n)
    place = _explode(start.astype(np.int64), n)
    group = label(w, data, starts, ends, pos)
    hit = (group >= 0) & (dup[run] == 0)
    i, s, e = _spans_of(hit, run, place)
    r = run[i]
    if len(i):
        yield _table(len(i), kind=np.full(len(i), SPAN), doc_id=pa.array(ids[r], mask=nulls[r] > 0), text_key=keys[r], start=s, stop=e + w.length)
    if whole:
        return
    # one of each window goes on, marked when it is known to be repeated
    mark = np.where(group >= 0, 2, dup[run]).astype(np.int8)
    again = np.flatnonzero(group >= 0)
    mark[again[np.unique(group[again], return_index=True)[1]]] = 1
    if level < levels:
        p = Placed(pos, run, place, mark, ids, nulls > 0, keys)
        yield from _blobs(w, data, starts, ends, p, *_orders(w, data, starts, ends, pos, level + 1), n_buckets * SPREAD)
        return
    some = np.flatnonzero(mark < 2)
    for i in range(0, len(some), 50_000):
        c = some[i : i + 50_000]
        digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts[pos[c]].tolist(), ends[pos[c] + w.length - 1].tolist(), strict=True))
        h, r = np.frombuffer(digests, np.int64).reshape(-1, 2), run[c]
        yield _table(len(c), kind=np.full(len(c), LOOSE), doc_id=pa.array(ids[r], mask=nulls[r] > 0), text_key=keys[r], h1=h[:, 0], h2=h[:, 1], start=place[c], stop=place[c] + w.length, dup=mark[c] > 0)


def _meet(w: Windows, label: Callable, chunk: int, level: int, levels: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, whole = None, [], 0, True
        for batch in batches:
            kind = batch["kind"].to_numpy()
            if (kind == SPAN).any():
                yield batch.filter(pa.array(kind == SPAN))
            for i in np.flatnonzero(kind == BLOB):
                bucket, blob = batch["bucket"][int(i)].as_py(), batch["blob"][int(i)].as_py()
                if held and (bucket != now or size >= chunk):
                    whole = whole and bucket != now
                    yield from _settle(w, label, held, whole, level, levels, n_buckets)
                    held, size, whole = [], 0, bucket != now
                now = bucket
                held.append(blob)
                size += struct.unpack_from("<qq", blob)[1]
        if held:
            yield from _settle(w, label, held, whole, level, levels, n_buckets)

    return run


def repeated_spans(documents: DataFrame, w: Windows, label: Callable, bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES, levels: int = LEVELS) -> DataFrame:
    """(doc_id, text_key, spans): tokens [start, stop) of each text that lie in windows that start anywhere else too."""
    docs = X.keyed(documents)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, round(3.2 * total / bucket_bytes))
    parts = min(n_buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_buckets // 16))
    left, spans = docs.mapInArrow(X.task(_deal(w, label, n_buckets)), SHUFFLED), []
    for level in range(levels + 1):
        dealt = left.repartition(parts, "bucket").sortWithinPartitions("bucket")
        met = X.written(dealt.mapInArrow(X.task(_meet(w, label, chunk_bytes, level, levels, n_buckets * SPREAD**level)), SHUFFLED))
        spans.append(met.filter(F.col("kind") == SPAN).select("doc_id", "text_key", "start", "stop"))
        left = met.filter(F.col("kind") == BLOB)
        if level < levels and left.isEmpty():
            break
    # each chunk gives a window once, so a list holds a place for each chunk of one bucket at most
    loose = met.filter(F.col("kind") == LOOSE).groupBy("h1", "h2")
    loose = loose.agg((F.count("*") > 1).alias("more"), F.collect_list(F.when(~F.col("dup"), F.struct("doc_id", "text_key", "start", "stop"))).alias("at"))
    loose = loose.filter("more").select(F.explode("at").alias("x")).select("x.*")
    found = reduce(DataFrame.unionByName, [*spans, loose])
    return found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _cleaned(w: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch["doc_id"], []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = (text.as_py() or "").encode()
                tokens = raw.split() if w.by_words else raw  # on bytes, split() knows just the six white space bytes
                n, gone, runs, kept = len(tokens), 0, 0, raw
                if w.by_words:
                    kept = b" ".join(tokens)
                if spans.is_valid and len(spans):
                    v = spans.values.flatten()
                    hit = X.merged(v[0].to_numpy(), v[1].to_numpy(), n)
                    gone = int(hit.sum())
                    runs = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()) if n else 0
                    kept = b" ".join(np.array(tokens, object)[~hit].tolist()) if w.by_words else np.frombuffer(raw, np.uint8)[~hit].tobytes()
                out.append((n, gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(),) * 3 + (pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def without_repeats(documents: DataFrame, w: Windows, label: Callable, keep_text: bool = True, **sizes: int) -> DataFrame:
    docs, found = X.keyed(documents), repeated_spans(documents, w, label, **sizes)
    joined = docs.join(found, X.same_row(docs, found), "left").select(docs["doc_id"], docs["text"], found["spans"])
    out = joined.mapInArrow(X.task(_cleaned(w)), "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def substring_dedup(documents: DataFrame, length: int = 35, gram: int = 6, **more) -> DataFrame:
    """Remove each word that lies in a window of length words that also starts anywhere else.

    Takes doc_id and text; other columns are ignored. Rows in: (doc_id, n_tokens, n_removed, n_spans, kept_sha256, kept),
    one for each row. Null and empty texts have no words. Rows that repeat a text, with one doc_id or several, repeat all
    its windows, so they lose every word of a text of length words or more. An empty table gives an empty result.
    A row with a null doc_id is a document like any other. Equality is by the words themselves (in buckets that outgrew their chunk
    LEVELS times, by a cryptographic digest of 128 bits). A text is held whole in a task with about 40 bytes of working memory a byte.
    """
    return without_repeats(documents, Windows(length, min(gram, length), True), _by_hash, **more)


def suffix_dedup(documents: DataFrame, length: int = 400, gram: int = 48, **more) -> DataFrame:
    """Remove each byte that lies in a string of length bytes that also starts anywhere else (UTF-8; null: empty).

    Rows, nulls, ties and repeated rows are as in substring_dedup, with bytes for words; matches never cross texts.
    kept may end within a character, so it is binary. Equality is by the bytes, as there.
    """
    return without_repeats(documents, Windows(length, min(gram, length), False), _by_radix, **more)
