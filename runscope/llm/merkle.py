"""Merkle manifest of a document table (operator 11).

A row's leaf is the digest of its columns. Per language the leaves, ascending by doc_id, are the bottom of a tree in
which every WIDTH neighbouring nodes have a parent, the digest of their digests; the languages' subroots are the
leaves of one more tree. Digests are SHA-256 in lowercase hex, concatenated as text.

A parent is hashed child by child, and a copy of the hash state before each child's slot is kept. Folding a replaced
child into its parent resumes the state of its slot with the replacement and the siblings to its right; what is left
of the slot is never hashed again.

Leaves are numbered by a distributed sort. A task builds one chunk of SPAN neighbouring leaves, LEVELS levels of the
tree, and passes its top on; the tops are the leaves of the next round, until each tree has its root. What a chunk
needs of the levels above it (slot and siblings of each) comes back down, a row for each chunk. Hash states can't be
written to a table, so the task that folds a chunk's documents makes the states above the chunk once, from the
siblings to the left, and copies them for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import cut, fold, map_batches

#: Children of a node; levels that one task builds at a time; leaves of such a chunk.
WIDTH, LEVELS = 8, 4
SPAN = WIDTH ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_HEX = 64
#: What a path holds of each level.
_STEPS = ("slots", "sizes", "siblings")


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 bytes' count, a colon, the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, others: tuple[str, ...] = FIELDS[:-1]) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in others], field(text)), 256)


class Node:
    """A parent: its digest, and copies of its hash state before each child's slot."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The parent's digest with another child in the slot."""
        state = self.states[slot].copy()
        state.update(child)
        for right in self.children[slot + 1:]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1:])


def height(n: int) -> int:
    """Levels of parents above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def build(leaves: list[bytes], levels: int) -> list[list[Node]]:
    """The parents of neighbouring leaves, level by level."""
    out = []
    for _ in range(levels):
        out.append([Node(leaves[i:i + WIDTH]) for i in range(0, len(leaves), WIDTH)])
        leaves = [node.digest for node in out[-1]]
    return out


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict[str, list]]]:
    """(tree, chunk, columns) of each chunk; its rows stand together, in the order of ``at``."""
    key, held = None, {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        of, at = list(zip(columns["tree"], columns["chunk"])), 0
        while at < len(of):
            end = at
            while end < len(of) and of[end] == of[at]:
                end += 1
            if held and of[at] != key:
                yield *key, held
                held = {}
            key = of[at]
            for c, values in columns.items():
                held.setdefault(c, []).extend(values[at:end])
            at = end
    if held:
        yield *key, held


def _levels(sizes: list[int], leaves: list[bytes]) -> list[list[Node]]:
    """The levels of a chunk in a tree of that size: LEVELS, or as many as the whole tree has."""
    return build(leaves, min(LEVELS, height(sizes[-1])))


_TOPS = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top node of each chunk, a leaf of the next round."""
    rows = []
    for tree, chunk, c in _by_chunk(batches):
        levels = _levels(c["size"], c["digest"])
        rows.append({"tree": tree, "at": chunk, "size": -(-c["size"][-1] // SPAN),
                     "digest": levels[-1][0].digest if levels else c["digest"][0]})
        if len(rows) >= 1024:
            yield pa.RecordBatch.from_pylist(rows, schema=_TOPS)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_TOPS)


_PATH = "tree string, at long, root binary, slots array<int>, sizes array<int>, siblings binary"
_PATH_ARROW = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("root", pa.binary()),
                         ("slots", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("siblings", pa.binary())])


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each node: slots, sizes and siblings of its levels in the chunk, then those of the chunk's path."""
    for tree, _, c in _by_chunk(batches):
        levels, rows = _levels(c["size"], c["digest"][1:]), []
        for place, at in enumerate(c["at"][1:]):
            slots, sizes, siblings = [], [], []
            for nodes in levels:
                place, slot = divmod(place, WIDTH)
                slots.append(slot)
                sizes.append(len(nodes[place].children))
                siblings.append(nodes[place].siblings(slot))
            rows.append({"tree": tree, "at": at, "root": c["root"][0], "slots": slots + c["slots"][0],
                         "sizes": sizes + c["sizes"][0], "siblings": b"".join(siblings) + c["siblings"][0]})
        yield pa.RecordBatch.from_pylist(rows, schema=_PATH_ARROW)


_OUT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                  ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _parents_above(slots: list[int], sizes: list[int], siblings: bytes) -> list[tuple[Node, int]]:
    """The parents above a chunk as nodes whose states are made up to the chunk's slot, and that slot."""
    out, at = [], 0
    for slot, size in zip(slots, sizes):
        others = [siblings[at + _HEX * i:at + _HEX * (i + 1)] for i in range(size - 1)]
        at += _HEX * (size - 1)
        node = Node.__new__(Node)
        state = hashlib.sha256(b"".join(others[:slot]))
        node.children, node.states, node.digest = others[:slot] + [b""] + others[slot:], {slot: state}, None
        out.append((node, slot))
    return out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, c in _by_chunk(batches):
        rest, root, subroot = c["siblings"][0], c["root"][0].decode(), c["subroot"][0].decode()
        above = _parents_above(c["slots"][0], c["sizes"][0], rest)
        levels, rows = _levels(c["size"], c["digest"][1:]), []
        for place, (doc_id, own, changed) in enumerate(zip(c["doc_id"][1:], c["digest"][1:], c["changed"][1:])):
            digest, proof = changed or own, hashlib.sha256()
            for nodes in levels:
                place, slot = divmod(place, WIDTH)
                proof.update(nodes[place].siblings(slot))
                digest = nodes[place].fold(slot, digest)
            proof.update(rest)
            for node, slot in above:
                digest = node.fold(slot, digest)
            folded = digest.decode()
            rows.append((doc_id, own.decode(), subroot, root, proof.hexdigest(), folded, folded == root))
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _chunks(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Nodes dealt out by their chunk, in order, SPAN rows at most to a chunk; with ``paths``, that of the chunk stands
    before its nodes."""
    rows = nodes.withColumn("chunk", F.floor(F.col("at") / SPAN).cast("long"))
    if paths is not None:
        own = paths.withColumns({"chunk": F.col("at"), "at": F.lit(-1).cast("long")})
        rows = rows.unionByName(own, allowMissingColumns=True)
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "at")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``at``, their place in their tree (from 0), and ``size``, the tree's number of leaves; a written table.

    A sort by ranges of (tree, order): a tree or a key that holds most rows is spread over many tasks. Only the
    counts of (range, tree) pairs are added up in windows.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = cut(rows.withColumn("id", F.monotonically_increasing_id()), name)
    parts = rows.groupBy("tree", F.shiftright("id", 33).alias("part")).agg(
        F.min("id").alias("first"), F.count("*").alias("n"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("tree").alias("t"), F.col("part").alias("p"), F.sum("n").over(by_tree).alias("size"),
                         (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    rows = rows.join(parts, F.col("tree").eqNullSafe(F.col("t")) & (F.shiftright("id", 33) == F.col("p")))
    return cut(rows.withColumn("at", F.col("id") + F.col("shift")).drop("t", "p", "id", "shift"), name)


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """(tree, at, size, digest) tables from the leaves up; the last one holds one row for each tree, its root."""
    out = [nodes.select("tree", "at", "size", "digest")]
    while out[-1].where("size > 1").limit(1).count():
        out.append(cut(map_batches(_chunks(out[-1]), _tops, "tree string, at long, size long, digest binary"), name))
    return out


def _paths(rounds: list[DataFrame], name: str) -> DataFrame:
    """The way to the root from each chunk of leaves (``at`` is its number), read from the rounds above the leaves."""
    none = F.array().cast("array<int>")
    paths = rounds[-1].select("tree", "at", F.col("digest").alias("root"), none.alias("slots"), none.alias("sizes"),
                              F.encode(F.lit(""), "UTF-8").alias("siblings"))
    for nodes in reversed(rounds[1:-1]):
        paths = cut(map_batches(_chunks(nodes, paths), _above, _PATH), name)
    return paths


def manifest(docs: DataFrame, changed_text: Column | None = None, name: str = "merkle") -> DataFrame:
    """One row per document row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed_text`` is a text column (null: the row is as it was) from which a second leaf is made; folded_root is
    folded from that leaf, else from the original one, through the parents' kept states; verified tells whether it
    is the root. proof_sha256 is over the siblings on the way up, level by level through the subroot to the root.

    All columns may be null (hashed as a dash). Documents without a language form a tree of their own, the first;
    null ids come before others; rows of one doc_id are ordered by their leaf, and equal rows are leaves each. A
    language of one document has its leaf as subroot, and a single language its subroot as root. An empty table gives
    an empty result. Columns other than the five are not read.
    """
    rows = docs.select(*[F.col(c) for c in FIELDS], *([changed_text.alias("_changed")] if changed_text is not None
                                                      else [F.lit(None).cast("string").alias("_changed")]))
    rows = rows.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf(F.col("text")).alias("leaf"),
                       F.when(F.col("_changed").isNotNull(), leaf(F.col("_changed"))).alias("changed"),
                       F.monotonically_increasing_id().alias("row"))
    # Digests only from here on. ``row`` lets ranges part equal rows; their order changes nothing.
    rows = cut(rows.select("tree", "doc_id", F.encode("leaf", "UTF-8").alias("digest"),
                           F.encode("changed", "UTF-8").alias("changed"), "row"), name)
    leaves = numbered(rows, ["doc_id", "digest", "row"], name).drop("row")

    rounds = _rounds(leaves, name)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    subroots = numbered(cut(subroots, name), ["lang"], name)
    # Each subroot's way to the root, then each chunk's way to its subroot and on.
    rounds_above = _rounds(subroots, name)
    ways = _chunks(rounds_above[0], _paths(rounds_above, name))
    ways = map_batches(ways, _above, _PATH).select("at", "root", *[F.col(c).alias(f"{c}_above") for c in _STEPS])
    ways = cut(ways.join(subroots.select("at", "lang", F.col("digest").alias("subroot")), "at").drop("at"), name)
    paths = _paths(rounds, name).drop("root")
    paths = paths.join(ways, paths["tree"].eqNullSafe(ways["lang"]))
    paths = cut(paths.select("tree", "at", "root", "subroot",
                             *[F.concat(c, f"{c}_above").alias(c) for c in _STEPS]), name)
    return map_batches(_chunks(leaves, paths), _documents,
                       "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                       "folded_root string, verified boolean")


def lowered(text: Column) -> Column:
    """The tampering of the registered query: A-Z lower-cased, nulls as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(doc_id: Column, text: Column) -> Column:
    """The changed text of the rows whose crc32(doc_id as text) 3 divides; null for the others."""
    return F.when(fold(doc_id, 3) == 0, lowered(text))
