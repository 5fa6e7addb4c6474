"""Merkle manifest of a dataset: mountain ranges over indexed partitions, merged at their edges, and a proof for each row."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyplan.llm import common

FANOUT = 8
#: Levels of a block: proofs are made for FANOUT ** BLOCK neighbouring leaves at once.
BLOCK = 4
#: The fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: FANOUT ** level, as far as a long goes.
_SIZES = [FANOUT**k for k in range(22) if FANOUT**k < 1 << 63]

_NODES = "tree string, n long, level int, idx long, digest string, edge boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of the fields one after the other, each its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tree_key(group: Column) -> Column:
    """A key that is never null and sorts as the groups do, null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("."), group.cast("string")), F.lit(""))


def count_at(level: int) -> Column:
    """Nodes of a level of a tree of ``n`` leaves; every run counts, short ones too."""
    return F.expr(f"(n - 1) div {_SIZES[level]} + 1")


class Mountains:
    """The peaks of a run of consecutive leaves of one tree.

    Nodes come in order; whenever FANOUT of them make a whole group, they carry: their parent goes to the next level. What
    belongs to a group that begins before the run or isn't full at its end is an edge, left to the merging of all runs.
    """

    def __init__(self, tree: str, n: int, first: int, out: list[tuple], block: int = BLOCK) -> None:
        self.tree, self.n, self.next, self.out, self.block = tree, n, first, out, block
        self.waiting: list[list] = []

    def push(self, nodes: list[str], level: int = 0, first: int | None = None) -> None:
        if first is None:
            first, self.next = self.next, self.next + len(nodes)
        if level == len(self.waiting):
            self.waiting.append([first, []])
        start, held = self.waiting[level]
        held = held + nodes
        lead = min(-start % FANOUT, len(held))  # not at a group's start: only at the run's left end
        self._emit(level, start, held[:lead], True)
        start, held = start + lead, held[lead:]
        whole = len(held) // FANOUT * FANOUT
        if whole:
            if level >= self.block:
                self._emit(level, start, held[:whole], False)
            parents = [digest("".join(held[k : k + FANOUT])) for k in range(0, whole, FANOUT)]
            self.waiting[level] = [start + whole, held[whole:]]
            self.push(parents, level + 1, start // FANOUT)
        else:
            self.waiting[level] = [start, held]

    def end(self) -> None:
        for level, (start, held) in enumerate(self.waiting):
            self._emit(level, start, held, True)

    def _emit(self, level: int, start: int, nodes: list[str], edge: bool) -> None:
        self.out.extend((self.tree, self.n, level, start + k, d, edge) for k, d in enumerate(nodes))


def _records(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    columns = zip(*out, strict=True) if out else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "n", "level", "idx", "digest", "edge"])


def _stacked(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        range_: Mountains | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            index = batch.column("idx").to_numpy()
            code = batch.column("tree").dictionary_encode()
            same = np.diff(code.indices.to_numpy()) == 0
            cuts = np.flatnonzero(~(same & (np.diff(index) == 1))) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                tree, first = batch.column("tree")[a].as_py(), int(index[a])
                if range_ is None or (range_.tree, range_.next) != (tree, first):
                    if range_:
                        range_.end()
                    range_ = Mountains(tree, batch.column("n")[a].as_py(), first, out, block)
                range_.push(batch.column("leaf").slice(a, b - a).to_pylist())
            if len(out) > 10_000:
                yield _records(out)
                out.clear()
        if range_:
            range_.end()
        yield _records(out)

    return run


def _joined(nodes: DataFrame) -> DataFrame:
    """(tree, n, idx, digests) of the groups of one level's nodes, FANOUT members at most, in order."""
    of = nodes.groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("members"))
    return of.select("tree", "n", "idx", F.col("members.digest").alias("digests"))


def merge_edges(edges: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes above the edges, level by level: a node that no run holds whole has only edges, and nodes made here, below it.

    A short last group is hashed as it is, without padding.
    """
    made: list[DataFrame] = []
    for level in range(depth):
        below = edges.where(F.col("level") == level).select("tree", "n", "idx", "digest")
        if made:
            below = below.unionByName(made[-1].select("tree", "n", "idx", "digest"))
        groups = _joined(below.where(count_at(level) > 1))
        nodes = groups.select("tree", "n", F.lit(level + 1).alias("level"), "idx", F.sha2(F.concat_ws("", "digests"), 256).alias("digest"))
        made.append(common.materialize(nodes, f"merkle-level-{level + 1}"))
    return made


def top_paths(subroots: list[tuple[str, str]]) -> tuple[str, dict[str, list[str]]]:
    """The root over the ordered trees' subroots, and for each tree the siblings on its way up: left, right, left, right, ..."""
    paths: dict[str, list[str]] = {tree: [] for tree, _ in subroots}
    level, members = [d for _, d in subroots], [[tree] for tree, _ in subroots]
    while len(level) > 1:
        above, over = [], []
        for k in range(0, len(level), FANOUT):
            group = level[k : k + FANOUT]
            for j, trees in enumerate(members[k : k + FANOUT]):
                sides = ["".join(group[:j]), "".join(group[j + 1 :])]
                for tree in trees:
                    paths[tree] = paths[tree] + sides
            above.append(digest("".join(group)))
            over.append([tree for trees in members[k : k + FANOUT] for tree in trees])
        level, members = above, over
    return level[0], paths


class Manifest(NamedTuple):
    """leaves(tree, n, idx, leaf, ...), nodes(tree, n, level, idx, digest) from level ``block`` on, tops(tree, n, subroot, root, path)."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame | None
    depth: int
    block: int


def manifest(leaves: DataFrame, order: list[str], block: int = BLOCK) -> Manifest:
    """The trees of ``leaves(tree, leaf, ...)``, in each of which rows ascend by ``order``, then by leaf.

    Rows are dealt out by range, so that a partition holds a piece of each order; pieces are counted and every row gets its
    index in its tree. A row may be repeated: equal rows have neighbouring places. Ranges are cut by a running number besides,
    so copies of one row needn't go to one task. The driver gets a row for each tree (not for each document).
    """
    (spread,) = common.fresh_names(leaves, "spread")
    first = common.materialize(leaves.withColumn(spread, F.monotonically_increasing_id()), "merkle-leaves")
    keys = ["tree", *order, "leaf", spread]
    place = F.monotonically_increasing_id()
    laid = first.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place).drop(spread)
    laid = common.materialize(laid.withColumn("part", F.shiftright("place", 33)), "merkle-ranges")
    common.discard(first)
    pieces = laid.groupBy("part", "tree").agg(F.min("place").alias("low"), F.count("*").alias("size"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("size").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("part", "tree", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"), F.sum("size").over(by_tree).alias("n"))
    indexed = laid.join(common.materialize(pieces, "merkle-pieces"), ["part", "tree"]).withColumn("idx", F.col("place") + F.col("shift")).drop("part", "place", "shift")
    stacked = indexed.select("tree", "n", "idx", "leaf").sortWithinPartitions("tree", "idx").mapInArrow(_stacked(block), _NODES)
    records = common.materialize(stacked, "merkle-peaks")
    most = records.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(indexed, records, None, 0, block)
    depth = next(k for k, size in enumerate(_SIZES) if size >= most)
    edges = records.where("edge")
    made = merge_edges(edges, depth)
    everything = records.drop("edge")
    for level in made:
        everything = everything.unionByName(level)
    own = F.array(*map(F.lit, _SIZES))
    is_top = (own[F.col("level")] >= F.col("n")) & ((F.col("level") == 0) | (own[F.greatest(F.col("level") - 1, F.lit(0))] < F.col("n")))
    found = sorted(((r["tree"], r["n"], r["digest"]) for r in everything.where(is_top).collect()), key=lambda x: x[0].encode())
    root, paths = top_paths([(tree, d) for tree, _, d in found])
    tops = leaves.sparkSession.createDataFrame([(tree, n, d, root, paths[tree]) for tree, n, d in found], "tree string, n long, subroot string, root string, path array<string>")
    return Manifest(indexed, everything.where(F.col("level") >= block), tops, depth, block)


def block_paths(m: Manifest) -> DataFrame:
    """(tree, block, n, subroot, root, path) for every block of leaves: the siblings on the way from the block's node to the
    root. From the top down, each level's groups meet their own node's path, one row to one row, so no node is a hot key."""
    paths = m.tops.select("tree", "n", F.lit(0).cast("long").alias("idx"), "subroot", "root", "path")
    depth_of = F.lit(0)
    for size in _SIZES[: m.depth]:
        depth_of = depth_of + (F.col("n") > size).cast("int")
    paths = paths.withColumn("level", F.greatest(depth_of, F.lit(m.block)))  # smaller trees join further down
    reached = paths.where(F.col("level") == max(m.depth, m.block)).drop("level")
    for level in range(m.depth - 1, m.block - 1, -1):
        groups = _joined(m.nodes.where((F.col("level") == level) & (count_at(level) > 1)).select("tree", "n", "idx", "digest"))
        opened = groups.join(reached, ["tree", "n", "idx"]).select("tree", "n", "subroot", "root", "path", "digests", "idx", F.posexplode("digests").alias("at", "own"))
        left = F.concat_ws("", F.slice("digests", F.lit(1), F.col("at")))
        right = F.concat_ws("", F.slice("digests", F.col("at") + 2, F.lit(FANOUT)))
        reached = opened.select("tree", "n", (F.col("idx") * FANOUT + F.col("at")).alias("idx"), "subroot", "root", F.concat(F.array(left, right), "path").alias("path"))
        reached = reached.unionByName(paths.where(F.col("level") == level).drop("level"))
    return reached.withColumnRenamed("idx", "block")


def fold(claim: str, path: list[str]) -> str:
    """The root that follows from a leaf and its siblings, left and right of it, level by level."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        claim = digest(left + claim + right)
    return claim


def leaf_paths(leaves: list[str], n: int, block: int = BLOCK) -> list[list[str]]:
    """The siblings of each leaf within its block, below the block's node or the subroot."""
    paths: list[list[str]] = [[] for _ in leaves]
    level, size = leaves, n
    for k in range(block):
        if size == 1:
            break
        groups = [level[j : j + FANOUT] for j in range(0, len(level), FANOUT)]
        sides = [["".join(g[:j]), "".join(g[j + 1 :])] for g in groups for j in range(len(g))]
        width = FANOUT**k
        for i, path in enumerate(paths):
            path.extend(sides[i // width])
        level, size = [digest("".join(g)) for g in groups], -(-size // FANOUT)
    return paths


def _proved(names: list[str], block: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        head, rows = table.slice(0, 1).to_pylist()[0], table.slice(1)
        leaves = rows.column("leaf").to_pylist()
        proofs, folded = [], []
        for path, own, claim in zip(leaf_paths(leaves, head["n"], block), leaves, rows.column("claim").to_pylist(), strict=True):
            path = path + head["path"]
            proofs.append(digest("".join(path)))
            folded.append(fold(own if claim is None else claim, path))
        m, root = len(leaves), head["root"]
        columns = [pa.array([head["subroot"]] * m, pa.string()), pa.array([root] * m, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
        return pa.Table.from_arrays([*(rows.column(c) for c in names), *columns], [*names, "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def prove(m: Manifest, identity: str, kind: T.DataType) -> DataFrame:
    """For every leaf its proof, and the root that follows from ``claim`` (null: the leaf) and the original siblings.

    Leaves of a block meet their block's path in a group of FANOUT ** block rows and one.
    """
    names = [identity, "tree", "idx", "leaf"]
    schema = T.StructType([T.StructField(identity, kind)]).add("tree", "string").add("idx", "long").add("leaf", "string")
    for name in ("subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, "string")
    schema = schema.add("verified", "boolean")
    if m.tops is None:
        return m.leaves.sparkSession.createDataFrame([], schema)
    rows = m.leaves.select("tree", F.expr(f"idx div {FANOUT**m.block}").alias("block"), "idx", F.col(identity), "leaf", "claim")
    heads = block_paths(m).select("tree", "block", F.lit(-1).cast("long").alias("idx"), "n", "subroot", "root", "path")
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.groupBy("tree", "block").applyInArrow(_proved(names, m.block), schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, claim) of documents: a tree is a language; a claim is the leaf of a tampered document, null if it is
    as it was. Where 3 divides the CRC-32 of doc_id in decimal digits, tampering puts A-Z of the text in lower case."""
    fields = [F.col(c) for c in FIELDS]
    forged = leaf(*(lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf(*fields).alias("leaf"), F.when(chosen, forged).alias("claim"))


def merkle_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The manifest's proofs of documents(doc_id, source, lang, n_chars, text).

    Result: a row for each row with doc_id, lang, position (in its language), leaf, subroot, root, proof_sha256, folded_root
    and verified. Nulls in any column have a leaf of their own; a null doc_id comes first in its language and is never
    tampered with, a null language is the first tree. Repeated rows are leaves each, in neighbouring places; rows of one
    doc_id that differ are ordered by leaf. A single document is its own subroot, a single subroot the root; proofs are then of
    nothing. An empty table gives no rows. Other columns aren't read.
    """
    proved = prove(manifest(document_leaves(docs), ["doc_id"], block), "doc_id", docs.schema["doc_id"].dataType)
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return proved.select("doc_id", lang.alias("lang"), F.col("idx").alias("position"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; see merkle_documents()."""
    return merkle_documents(common.documents(spark, sf_dir, *FIELDS))
