"""N-gram Jaccard join of all documents with count-vector R-trees.

Every text becomes a set of shingle hashes, and equal sets (keys of 128 bits) are one node. Sets that can link meet by group
signatures (see sets.signatures). Signatures that very many sets share are left out where a set can spare them: each linked pair
shares another one. Each meeting then is an index of count vectors: shingles fall into GROUPS groups, the counts are a point, and
the overlap of two sets is at most the sum of the coordinates' minima. Points are packed by size and by the coordinate that varies
most into an R-tree; bounds by the upper corners of two tree nodes discard all pairs below them, and the bound of points discards
most pairs. What is left is verified on the sets themselves.

To find components without all pairs of a dense group, a first pass verifies one pair for each point that isn't the first
of its neighbourhood; a second pass takes every surviving pair that the links so far don't already connect. There pairs must also
pass a bound by parities of finer groups, which hardly any pass that do not link: near copies just below the similarity are as many
as the square of their group. Together no link between different components is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import sets as S
from tidemark.llm import textops as X
from tidemark.llm.graph import components

LEAF = 16
#: Rows of one signature that are compared in one task; larger meetings go block by block.
MEETING = 2000
BUCKET_ROWS = 300_000
HELD_ROWS = 4_000_000


#: A text's own row has all but sig, unit, spare, n and blob; packed signatures have bucket and blob; signatures that met sig to n.
FIELDS = {"doc_id": pa.int64(), "text_key": pa.int64(), "n_shingles": pa.int64(), "node": pa.binary(), "bucket": pa.int64(), "blob": pa.binary(), "sig": pa.int64(), "unit": pa.int32(), "spare": pa.int32(), "n": pa.int32()}
ROWS = "doc_id long, text_key long, n_shingles long, node binary, bucket long, blob binary, sig long, unit int, spare int, n int"
_KEYED = np.dtype([("n1", np.uint64), ("n2", np.uint64), ("unit", np.uint16), ("spare", np.uint8)])


def _batch(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(size, kind)) for name, kind in FIELDS.items()], names=list(FIELDS))


def _shingled(sim: S.Similarity, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text, its set's key as node; and the signatures of a block's sets, one packed row a bucket. A set signs once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for t in X.blocks(batches, "text"):
            v, first = S.shingles(t["text"], sim.words)
            size, node = np.diff(first), S.set_keys(v, first)
            spread = (node[:, 0] % np.uint64(n_buckets)).astype(np.int64)
            yield _batch(len(size), doc_id=t["doc_id"].combine_chunks(), text_key=t["text_key"].combine_chunks(), n_shingles=pa.array(size, pa.int64()), node=S.as_binary(node, size == 0), bucket=pa.array(spread))
            _, one = np.unique(node, axis=0, return_index=True)
            one = one[size[one] > 0]
            n = size[one]
            values = v[np.arange(int(n.sum())) + np.repeat(first[one] - (np.cumsum(n) - n), n)]
            doc, sig, unit, spare = S.signatures(sim, values, np.concatenate(([0], np.cumsum(n))))
            bucket = (sig.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((sig, bucket))
            doc, sig, unit, spare, bucket = (x[order] for x in (doc, sig, unit, spare, bucket))
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            out_b, out = [], []
            for i, j in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                _, at, back = np.unique(doc[i:j] << 16 | unit[i:j], return_index=True, return_inverse=True)
                head = np.empty(len(at), _KEYED)
                head["n1"], head["n2"] = node[one[doc[i:j][at]]].T
                head["unit"], head["spare"] = unit[i:j][at], np.minimum(spare[i:j][at], 255)
                raw = head.tobytes() + back.astype(np.uint32).tobytes() + sig[i:j].tobytes()
                out_b.append(int(bucket[i]))
                out.append(struct.pack("<qq", len(at), j - i) + pack.compress(raw))
            if out:
                yield _batch(len(out), bucket=pa.array(out_b, pa.int64()), blob=pa.array(out, pa.binary()))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of texts as they are, and (sig, node, unit, spare, n) of the signatures that n nodes share, two at least; of a bucket
    that outgrows HELD_ROWS all rows, n null, for Spark to group."""
    unpack = zstandard.ZstdDecompressor()
    kind = np.dtype([("sig", np.int64), *_KEYED.descr])
    now, rows, held, whole = None, [], 0, True

    def compact(only_shared: bool) -> np.ndarray:
        r = np.concatenate(rows)
        r = r[np.lexsort((r["n2"], r["n1"], r["sig"]))]
        new = np.ones(len(r), bool)
        new[1:] = (r["sig"][1:] != r["sig"][:-1]) | (r["n1"][1:] != r["n1"][:-1]) | (r["n2"][1:] != r["n2"][:-1])
        r = r[new]
        if only_shared:
            same = np.concatenate(([False], r["sig"][1:] == r["sig"][:-1], [False]))
            r = r[same[1:] | same[:-1]]
        return r

    def out(r: np.ndarray, all_there: bool) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate(([True], r["sig"][1:] != r["sig"][:-1], [True])))
        n = np.repeat(np.diff(cuts), np.diff(cuts)).astype(np.int32) if len(r) else np.empty(0, np.int32)
        for i in range(0, len(r), 100_000):
            x = r[i : i + 100_000]
            many = pa.array(n[i : i + 100_000]) if all_there else pa.nulls(len(x), pa.int32())
            yield _batch(len(x), sig=pa.array(x["sig"].copy()), node=S.as_binary(np.stack((x["n1"], x["n2"]), 1)), unit=pa.array(x["unit"].astype(np.int32)), spare=pa.array(x["spare"].astype(np.int32)), n=many)

    for batch in batches:
        own = batch["blob"].is_null()
        if own.true_count:
            yield batch.filter(own)
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"], strict=True):
            if not blob.is_valid:
                continue
            if bucket != now:
                if held:
                    yield from out(compact(whole), whole)
                now, rows, held, whole = bucket, [], 0, True
            b = blob.as_buffer().to_pybytes()
            k, n = struct.unpack_from("<qq", b)
            raw = unpack.decompress(b[16:], max_output_size=_KEYED.itemsize * k + 12 * n)
            head, back = np.frombuffer(raw, _KEYED, k), np.frombuffer(raw, np.uint32, n, _KEYED.itemsize * k)
            r = np.empty(n, kind)
            for name in _KEYED.names:
                r[name] = head[name][back]
            r["sig"] = np.frombuffer(raw, np.int64, n, _KEYED.itemsize * k + 4 * n)
            rows.append(r)
            held += n
            if held > HELD_ROWS:
                rows = [compact(False)]
                held = len(rows[0])
                if held > HELD_ROWS // 2:
                    yield from out(rows[0], False)
                    rows, held, whole = [], 0, False
    if held:
        yield from out(compact(whole), whole)


def _met(met: DataFrame, meeting: int) -> DataFrame:
    """(sig, node, blocks) of the meetings of two nodes or more, without those that their sets can spare; met is what _meet gives."""
    left = met.filter("n IS NULL").drop("n")
    if not left.isEmpty():
        left = X.written(left.distinct())
        met = met.filter("n IS NOT NULL").unionByName(left.join(left.groupBy("sig").agg(F.count("*").cast("int").alias("n")).filter("n > 1"), "sig"))
    # of each deal a set leaves out the largest of its meetings, as many as it can spare; large meetings hold most pairs
    rank = F.row_number().over(W.partitionBy("node", "unit").orderBy(F.desc("n"), "sig"))
    met = X.written(met.withColumn("rank", rank).filter("rank > spare").select("sig", "node"))
    count = met.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    return X.written(met.join(count, "sig").select("sig", "node", F.ceil(F.col("n") / meeting).cast("long").alias("blocks")))


def _pairs_below(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs a <= b of children of the tree nodes i and j; a node has LEAF children, the last of n perhaps fewer."""
    a = (i[:, None, None] * LEAF + np.arange(LEAF)[None, :, None]) + np.zeros((1, 1, LEAF), np.int64)
    b = (j[:, None, None] * LEAF + np.arange(LEAF)[None, None, :]) + np.zeros((1, LEAF, 1), np.int64)
    a, b = a.ravel(), b.ravel()
    keep = (a < n) & (b < n) & (a <= b)
    return a[keep], b[keep]


def surviving(sim: S.Similarity, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) whose bound on the overlap is enough for a link, by descending pairs of an R-tree's nodes from its root."""
    n = len(size)
    order = np.argsort(size, kind="stable")
    slices = max(1, int(np.sqrt(n / LEAF)))  # sort, tile: slices by size, ordered within by the coordinate that varies most
    if slices > 1:
        by = c[:, int(c.var(0).argmax())]
        order = order[np.lexsort((by[order], np.arange(n) * slices // n))]
    # levels from the points up: upper corner, least and largest size
    levels = [(c[order], size[order], size[order])]
    while len(levels[-1][1]) > LEAF:
        high, least, most = levels[-1]
        at = np.arange(0, len(least), LEAF)
        levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def enough(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        high, least, most = levels[level]
        fits = (most[a] * sim.den >= least[b] * sim.num) & (most[b] * sim.den >= least[a] * sim.num)
        a, b = a[fits], b[fits]
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 8192):
            x, y = a[k : k + 8192], b[k : k + 8192]
            keep[k : k + 8192] = np.minimum(high[x], high[y]).sum(1) >= sim.need(least[x], least[y])
        fits[fits] = keep
        return fits

    top = np.arange(len(levels[-1][1]))
    work = [(len(levels) - 1, np.repeat(top, len(top)), np.tile(top, len(top)))]
    point = order.astype(np.int32)  # pairs may be as many as the square of n: four bytes an end, and no second copy
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int32), np.empty(0, np.int32))]
    while work:  # depth first, in pieces, so that few pairs are open at a time
        level, a, b = work.pop()
        keep = a < b if not level else a <= b
        a, b = a[keep], b[keep]
        keep = enough(level, a, b)
        a, b = a[keep], b[keep]
        if not level:
            a, b = point[a], point[b]
            out.append((np.minimum(a, b), np.maximum(a, b)))
            continue
        for k in range(0, len(a), 256):
            work.append((level - 1, *_pairs_below(a[k : k + 256], b[k : k + 256], len(levels[level - 1][1]))))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return i, j


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in by, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in by], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[i].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _points(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vec = [x.as_buffer() for x in t["vec"]]
    return t["size"].to_numpy(), np.stack([np.frombuffer(x, np.uint8 if len(x) == S.GROUPS else "<u4") for x in vec]).astype(np.int32)


def _first_pass(sim: S.Similarity) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b): for each point with a surviving pair, the pair with the first of its neighbourhood; (a, null): a has one, but is in no
    such pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[bytes, bytes]] = set()
        others: set[bytes] = set()

        def out() -> Iterator[pa.RecordBatch]:
            others.difference_update({x for pair in pairs for x in pair})
            rows = [*pairs, *((a, None) for a in others)]
            for k in range(0, len(rows), 50_000):
                a, b = zip(*rows[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            pairs.clear()
            others.clear()

        for t in _groups(batches, ["sig", "block"]):
            if t.num_rows < 2:
                continue
            i, j = surviving(sim, *_points(t))
            if not len(i):
                continue
            node = t["node"].to_pylist()
            others.update(node[x] for x in np.unique(np.concatenate((i, j))).tolist())
            led = np.zeros(t.num_rows, bool)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cuts = np.flatnonzero(np.diff(i, prepend=-1))
            for s, e in zip(cuts, [*cuts[1:], len(i)], strict=True):
                if led[i[s]]:
                    continue
                free = j[s:e][~led[j[s:e]]]
                led[free] = True
                a = node[i[s]]
                pairs.update((min(a, node[x]), max(a, node[x])) for x in free.tolist())
            if len(pairs) > 100_000:
                yield from out()
        yield from out()

    return run


def _second_pass(sim: S.Similarity) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b): every pair of nodes that are not yet in one component and survive, by their parities too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["sig", "block"]):
            label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            if t.num_rows < 2 or (label == label[0]).all():
                continue
            size, c = _points(t)
            i, j = surviving(sim, size, c)
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            both = size[i] + size[j]
            near = S.least_apart([x.as_buffer() for x in t["parity"]], i, j) <= both - 2 * sim.need(size[i], size[j])
            node = t["node"].to_pylist()
            pairs = sorted({(min(node[x], node[y]), max(node[x], node[y])) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True)})
            for k in range(0, len(pairs), 200_000):
                a, b = zip(*pairs[k : k + 200_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _points_and_sets(sim: S.Similarity) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in X.blocks(batches, "text"):
            v, first = S.shingles(t["text"], sim.words)
            c = S.count_vectors(v, first)
            wide = c.max(1, initial=0) > 255
            vec = [c[i].astype("<u4" if wide[i] else np.uint8).tobytes() for i in range(len(c))]
            values = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v.view(np.int64)))
            columns = [t["node"].combine_chunks(), pa.array(np.diff(first), pa.int64()), pa.array(vec, pa.binary()), pa.array(S.parities(v, first), pa.binary()), values]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "vec", "parity", "shingles"])

    return run


def _verified(sim: S.Similarity, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.filter(F.col("common") * sim.den >= union * sim.num).select("a", "b")


def link_documents(documents: DataFrame, sim: S.Similarity, meeting: int = MEETING, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component) for each row of documents (doc_id, text).

    A-Z is lower-cased, words are runs of anything but ASCII white space. component_id is the least doc_id that links reach; where
    doc_ids are null or repeat, several components can share one. component tells all components apart, by the hash of a set; it is
    null for documents without words.
    Documents without words (null or empty texts) link with nothing and are their own component; a text of fewer words than a
    shingle is one shingle. Equal sets always link. A null doc_id never becomes a component_id while its component holds another.
    Further columns are ignored; an empty table gives an empty result. Shingles are compared by hashes of 64 bits, whole sets by 128.
    """
    docs = X.keyed(documents)
    spark = docs.sparkSession
    # words are some six bytes, and a word starts a shingle at most
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    n_buckets = max(1, round(total * 2.2 * (sim.den - sim.num) / (sim.den + sim.num) / bucket_rows))
    parts = min(n_buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_buckets // 16))
    dealt = docs.mapInArrow(X.task(_shingled(sim, n_buckets)), ROWS).repartition(parts, "bucket").sortWithinPartitions("bucket")
    rows = X.written(dealt.mapInArrow(X.task(_meet), ROWS))
    nodes = rows.filter("sig IS NULL").select("doc_id", "text_key", "n_shingles", "node")
    met = _met(rows.filter("sig IS NOT NULL").select("sig", "node", "unit", "spare", "n"), meeting)
    # one document stands for each node that meets another
    stands = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("d")).select("node", "d.doc_id", "d.text_key")
    stands = stands.join(met.select("node").distinct(), "node", "left_semi")
    texts = docs.join(stands, X.same_row(docs, stands)).select(stands["node"], docs["text"]).dropDuplicates(["node"])
    points = X.written(texts.mapInArrow(X.task(_points_and_sets(sim)), "node binary, size long, vec binary, parity binary, shingles array<bigint>"))
    vectors = points.select("node", "size", "vec")

    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = met.withColumn("block", own).join(vectors, "node").select("sig", "node", "block", "size", "vec")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = dealt.repartition(n_parts, "sig", "block").sortWithinPartitions("sig", "block", "node").mapInArrow(X.task(_first_pass(sim)), "a binary, b binary").distinct()
    first = X.written(first)
    pairs = first.filter("b IS NOT NULL")
    links = X.written(_verified(sim, pairs, points.select("node", "shingles")))
    labels = components(links)

    # nodes with a surviving pair, and all nodes of meetings that were only compared within their blocks
    open_ = first.select(F.col("a").alias("node")).union(pairs.select("b")).union(met.filter("blocks > 1").select("node")).distinct()
    rows = met.join(open_, "node", "left_semi")
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = rows.groupBy("sig").agg((F.min("label") != F.max("label")).alias("apart")).filter("apart").select("sig")
    rows = rows.join(apart, "sig", "left_semi")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("k", k).withColumn("block", F.least("own", "k") * F.col("blocks") + F.greatest("own", "k"))
    rows = rows.join(points.select("node", "size", "vec", "parity"), "node").select("sig", "node", "block", "label", "size", "vec", "parity")
    second = rows.repartition(n_parts, "sig", "block").sortWithinPartitions("sig", "block", "node").mapInArrow(X.task(_second_pass(sim)), "a binary, b binary").distinct()
    second = X.written(second.join(pairs, ["a", "b"], "left_anti"))
    more = X.written(_verified(sim, second, points.select("node", "shingles")))
    if not more.isEmpty():
        labels = components(links.union(more))

    least = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    root = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(root, "label").select(F.col("node").alias("of"), "component_id", F.col("label").alias("component"))
    out = nodes.join(named, nodes["node"] == named["of"], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")
