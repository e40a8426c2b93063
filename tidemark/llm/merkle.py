"""Merkle manifest of a dataset: a tree of SHA-256 digests over its rows, proofs, and roots folded from changed rows.

A parent is the digest of its children's digests. It keeps a copy of the hash state before each child slot, so that a changed child
is folded in by resuming that slot's state with the replacement and the siblings on its right; what is on its left is never hashed again.

Leaves are ordered by a range sort and cut into blocks of FANOUT ** LEVELS. A block is a subtree that one task builds; the blocks' digests
are the leaves of the next round, so that a tree of n leaves takes log n rounds of ever smaller tables. On the way down each block
gets the path above it (the siblings of its ancestors, one row a block), and its task folds all its leaves through its own
levels and through that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textops as X

FANOUT, LEVELS = 2, 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_ABOVE = [("subroot", pa.string()), ("root", pa.string()), ("path", pa.list_(_STEP))]
_PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), *_ABOVE])
_NODES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string())])
_FOLDED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("siblings", pa.list_(pa.string())), ("folded_root", pa.string()), ("verified", pa.bool_())])
_PATHS_SQL = "tree string, pos long, subroot string, root string, path array<struct<left:string,right:string>>"
_FOLDED_SQL = "doc_id long, leaf string, subroot string, root string, siblings array<string>, folded_root string, verified boolean"


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values one after another: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]).cast("binary"), 256)


class Parents:
    """The levels of a subtree over leaves (digests as bytes): of every node its slot's state and the siblings on either side."""

    def __init__(self, leaves: list[bytes], fanout: int, height: int):
        self.fanout, self.levels, nodes = fanout, [], leaves
        for _ in range(height):
            states, lefts, rights, up = [], [], [], []
            for i in range(0, len(nodes), fanout):
                run, state = nodes[i : i + fanout], hashlib.sha256()
                for k, child in enumerate(run):
                    states.append(state.copy())
                    lefts.append(b"".join(run[:k]))
                    rights.append(b"".join(run[k + 1 :]))
                    state.update(child)
                up.append(state.hexdigest().encode())
            self.levels.append((states, lefts, rights))
            nodes = up
        (self.top,) = nodes

    def fold(self, i: int, digest: bytes) -> bytes:
        """The top if leaf i were digest."""
        for states, _, rights in self.levels:
            digest = _resumed(states[i], digest, rights[i])
            i //= self.fanout
        return digest

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """What stands left and right of leaf i and of its ancestors."""
        out = []
        for _, lefts, rights in self.levels:
            out.append((lefts[i], rights[i]))
            i //= self.fanout
        return out


def _resumed(state, digest: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def height(n: int, fanout: int, levels: int) -> int:
    """Levels above a block of a tree of n leaves: levels, or fewer where the block is the whole tree."""
    h, room = 0, 1
    while room < n and h < levels:
        h, room = h + 1, room * fanout
    return h


def _parents(row: dict, fanout: int, levels: int) -> Parents:
    return Parents([x["digest"].encode() for x in row["run"]], fanout, height(row["n"], fanout, levels))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _climb(fanout: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows))
            yield _batch(_NODES, [(r["tree"], r["block"], _parents(r, fanout, levels).top.decode()) for r in rows])

    return run


def _descend(fanout: int, levels: int):
    """Paths of all nodes of each block, the path above the block included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                parents, above = _parents(r, fanout, levels), [(x["left"], x["right"]) for x in r["path"]]
                own = [[(a.decode(), c.decode()) for a, c in parents.path(k)] for k in range(len(r["run"]))]
                yield _batch(_PATHS, [(r["tree"], x["pos"], r["subroot"], r["root"], [{"left": a, "right": c} for a, c in [*p, *above]]) for x, p in zip(r["run"], own, strict=True)])

    return run


def _fold(fanout: int, levels: int):
    """Every leaf, or what replaces it, folded through its block and the path above, whose states are set up once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                parents, width = _parents(r, fanout, levels), 64
                above = [(hashlib.sha256(x["left"].encode()), x["right"].encode()) for x in r["path"]]
                shared = [x[side][k : k + width] for x in r["path"] for side in ("left", "right") for k in range(0, len(x[side]), width)]
                rows = []
                for k, x in enumerate(r["run"]):
                    digest = parents.fold(k, (x["other"] or x["digest"]).encode())
                    for state, right in above:
                        digest = _resumed(state, digest, right)
                    own = [side[j : j + width].decode() for step in parents.path(k) for side in step for j in range(0, len(side), width)]
                    folded = digest.decode()
                    rows.append((x["doc_id"], x["digest"], r["subroot"], r["root"], own + shared, folded, folded == r["root"]))
                yield _batch(_FOLDED, rows)

    return run


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, ...) with pos, the place in the tree by order, and n, the tree's size. Ranges are sorted apart; what stands before a
    range in its tree comes from a table of one row a range and tree."""
    s = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    s = X.written(s.withColumn("at", F.monotonically_increasing_id()))  # grows along the ranges and within each
    s = s.withColumn("range", F.shiftright("at", 33))
    ranges = s.groupBy(F.col("tree").alias("_tree"), F.col("range").alias("_range")).agg(F.min("at").alias("_first"), F.count("*").alias("_rows"))
    w = W.partitionBy("_tree")
    ranges = ranges.select("*", F.coalesce(F.sum("_rows").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("n"))
    out = s.join(ranges, (F.col("tree") == F.col("_tree")) & (F.col("range") == F.col("_range")))
    return out.withColumn("pos", F.col("at") - F.col("_first") + F.col("_before")).drop("at", "range", "_tree", "_range", "_first", "_rows", "_before")


def _blocks(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    """(tree, n, block, run) of nodes (tree, n, pos, digest): size of them, in order, are a block."""
    block = F.floor(F.col("pos") / size).cast("long").alias("block")
    return nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *more))).alias("run"))


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The leaves and the digests of each round's blocks, and the root (tree, digest) of every tree."""
    size, rounds = fanout**levels, [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = _blocks(rounds[-1].filter("n > 1"), size)
        up = X.written(up.mapInArrow(X.task(_climb(fanout, levels)), "tree string, pos long, digest string"))
        n = up.groupBy(F.col("tree").alias("_t")).agg(F.count("*").alias("n"))
        rounds.append(up.join(n, F.col("tree") == F.col("_t")).drop("_t"))
        most = -(-most // size)
    roots = rounds[0].filter("n = 1").select("tree", "digest")
    for r in rounds[1:]:
        roots = roots.unionByName(r.filter("n = 1").select("tree", "digest"))
    return rounds, roots


def _above_blocks(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, pos, subroot, root, path): what is above block pos of the first round; above has it for the whole trees."""
    size = fanout**levels
    alone = rounds[0].filter((F.col("pos") == 0) & (F.col("n") <= size)).select("tree", "pos")
    out = alone.join(above, "tree").select("tree", "pos", "subroot", "root", "path")
    return out.unionByName(_paths(rounds[1:], above, fanout, levels)) if len(rounds) > 1 else out


def _paths(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Of every node of the first round what is above it, in trees of several nodes."""
    over = _above_blocks(rounds, above, fanout, levels)
    blocks = _blocks(rounds[0].filter("n > 1"), fanout**levels)
    return blocks.join(over.withColumnRenamed("pos", "block"), ["tree", "block"]).mapInArrow(X.task(_descend(fanout, levels)), _PATHS_SQL)


def merkle_manifest(documents: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, folded_root, verified) of every row.

    leaf is the digest of the row's columns. The rows of each value of tree, ordered by doc_id (null first; rows that repeat it by
    their leaves), are the leaves of a tree whose root is the subroot: every fanout consecutive nodes, in the last run fewer, become the
    digest of their digests, until one is left. The subroots, ordered by the value of tree (null first, then by UTF-8 bytes),
    are the leaves of the tree of root in the same way. siblings are the others of each run on the way from the leaf to root, level by
    level and from left to right.

    changed, a digest or null, replaces a leaf: folded_root is the root that follows from it (else from the leaf) and the unchanged
    siblings, and verified tells whether that is root. Equal rows are leaves of their own; an empty table gives no rows; columns
    beyond those named are ignored.
    """
    own = documents.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-")).alias("tree"), leaf_digest([F.col(c) for c in columns]).alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("other"))
    leaves = X.written(own.withColumn("row", F.monotonically_increasing_id()))  # many equal rows are still spread over ranges
    leaves = _placed(leaves, ["doc_id", "digest", "row"])
    rounds, subroots = _rounds(leaves, fanout, levels)
    subroots = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    tops, roots = _rounds(subroots, fanout, levels)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = roots.select("tree", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), none.alias("path"))
    one = subroots.filter("n = 1").join(root, "tree").select("tree", "pos", "subroot", "root", "path")
    above = subroots.join(one.unionByName(_paths(tops, root, fanout, levels)).drop("subroot"), ["tree", "pos"])
    above = X.written(above.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    over = _above_blocks(rounds, above, fanout, levels)
    blocks = _blocks(leaves, fanout**levels, "doc_id", "other").withColumnRenamed("block", "pos")
    return blocks.join(over, ["tree", "pos"]).mapInArrow(X.task(_fold(fanout, levels)), _FOLDED_SQL)
