"""The prefix tree of conversations: which of them begin with the same turns, and what sharing those would save.

Conversations are cut into segments of bounded length, whose prefixes have hashes that say the whole prefix. Batches
of segments are inserted into z-fast tries: compacted nodes are kept by the hash at their handle, the depth in a node's
interval that the highest power of two divides; the exit node of a segment is located by fat binary search over those
handles, and split there if need be. Then the edges of a batch's trie are expanded into one row per node, with the sums
over its conversations, and rows of equal nodes of different batches are added up by Spark. So a node that many
conversations go through is one row per batch, wherever it is shuffled.

Sums over subtrees need no walk over the tree. A node belongs to its smallest conversation, and the nodes of a
conversation are then the lower end of its path, a chain. What is summed over all nodes below a node is thus the sum of
the chains of the conversations through it, without the part of the node's own chain that is above it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.operators.ranking import cut_slices, number_rows, running_before
from frameops.session import shuffle_partitions, stage

TURNS_PER_SEGMENT = 1_024
# Turns that a task holds in one trie.
TURNS_PER_TRIE = 200_000

# Prefix hashes are polynomials modulo a Mersenne prime, so those of segments can be joined; any base does.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the highest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def roll(prefix: int, turn: int) -> int:
    """The hash of a prefix with one more turn."""
    return (prefix * BASE + turn + 1) % PRIME


class Path:
    """A segment of a conversation: hashes of its prefixes, from that of ``start`` turns on, and bytes of its turns."""

    __slots__ = ("start", "end", "hashes", "sizes")

    def __init__(self, start: int, prefix: int, turns: list[int], sizes: list[int]) -> None:
        self.start, self.end, self.sizes = start, start + len(turns), sizes
        self.hashes = [prefix]
        for turn in turns:
            self.hashes.append(roll(self.hashes[-1], turn))

    def at(self, depth: int) -> tuple[int, int]:
        return depth, self.hashes[depth - self.start]


class Node:
    """A compacted node: the depths (above, depth] of ``path``, and what its subtree adds up to."""

    __slots__ = ("above", "depth", "path", "parent", "least", "sums")

    def __init__(self, above: int, depth: int, path: Path, parent: Node | None, width: int) -> None:
        self.above, self.depth, self.path, self.parent = above, depth, path, parent
        self.least, self.sums = None, [0] * width

    def add(self, least: int, sums: Iterable[int]) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]


class Trie:
    """A z-fast trie of paths, each with a conversation and some numbers that are summed over subtrees."""

    def __init__(self, width: int) -> None:
        self.width, self.turns = width, 0
        self.nodes: list[Node] = []
        self.handles: dict[tuple[int, int], Node] = {}
        self.firsts: dict[tuple[int, int], Node] = {}  # by the first prefix of a node's edge
        self.roots: dict[tuple[int, int], Node] = {}

    def _node(self, above: int, depth: int, path: Path, parent: Node | None) -> Node:
        node = Node(above, depth, path, parent, self.width)
        self.nodes.append(node)
        if parent is not None:
            self.handles[path.at(two_fattest(above, depth))] = self.firsts[path.at(above + 1)] = node
        return node

    def locate(self, path: Path) -> tuple[Node, int]:
        """The exit node of a path, and the depth in its edge up to which they agree."""
        node = self.roots.get(path.at(path.start))
        if node is None:
            node = self.roots[path.at(path.start)] = self._node(path.start, path.start, path, None)
        low, high = path.start, path.end
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get(path.at(depth))
            if found is None:
                high = depth - 1
            elif found.depth <= path.end and path.at(found.depth) == found.path.at(found.depth):
                node, low = found, found.depth
            else:  # the paths part between the handle and the end of this edge
                return found, self._agree(path, found, depth)
        edge = self.firsts.get(path.at(low + 1)) if low < path.end else None
        return (node, low) if edge is None else (edge, self._agree(path, edge, low + 1))

    @staticmethod
    def _agree(path: Path, node: Node, known: int) -> int:
        depths = range(known + 1, min(node.depth, path.end) + 1)
        return known + bisect_left(depths, True, key=lambda d: path.at(d) != node.path.at(d))

    def insert(self, path: Path, least: int, sums: list[int]) -> None:
        self.turns += path.end - path.start + 1
        node, depth = self.locate(path)
        if depth < node.depth:
            node = self._split(node, depth)
        if depth < path.end:
            node = self._node(depth, path.end, path, node)
        node.add(least, sums)

    def _split(self, node: Node, depth: int) -> Node:
        """A new node at ``depth`` of the edge of ``node``, above it. One of the two keeps the handle there was."""
        path, above = node.path, node.above
        del self.handles[path.at(two_fattest(above, node.depth))]
        upper = self._node(above, depth, path, node.parent)
        node.above, node.parent = depth, upper
        self.handles[path.at(two_fattest(depth, node.depth))] = self.firsts[path.at(depth + 1)] = node
        return upper

    def expanded(self) -> Iterator[tuple[int, int, int | None, int, int, list[int]]]:
        """Every node of the tree: depth, hash, hash of its parent, bytes of its last turn, smallest conversation, sums."""
        for node in sorted(self.nodes, key=lambda n: -n.depth):  # deeper nodes are complete before their parents
            if node.parent is not None:
                node.parent.add(node.least, node.sums)
        for node in self.nodes:
            path = node.path
            if node.parent is None and node.depth == 0:
                yield 0, path.hashes[0], None, 0, node.least, node.sums
            for i in range(node.above - path.start, node.depth - path.start):
                yield path.start + i + 1, path.hashes[i + 1], path.hashes[i], path.sizes[i], node.least, node.sums


def graft(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others, a test of the operator on any table of them: turns (conv_id, pos, role,
    text) and all ids (conv_id), those left without turns included.

    Conversation c has the first h turns of conversation c - c % 5 (all if it has fewer, none if it does not exist),
    then its own after its first h; h is the CRC-32 of the id as text, modulo 9.
    """
    said = ordered(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = said.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = stage(convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("giver")), "convs")
    heads = said.filter("pos < 8").select(F.col("conv_id").alias("giver"), "pos", "role", "text")
    given = convs.select("conv_id", "h", "giver").join(heads, "giver").filter("pos < h")
    size = convs.select(F.col("conv_id").alias("giver"), F.col("n").alias("gives"))
    shift = F.least("h", F.coalesce("gives", F.lit(0))) - F.col("h")
    moved = convs.select("conv_id", "h", "giver").join(size, "giver", "left").select("conv_id", "h", shift.alias("shift"))
    own = said.join(moved, "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") + F.col("shift"))
    columns = ["conv_id", "pos", "role", "text"]
    return given.select(*columns).unionAll(own.select(*columns)), convs.select("conv_id")


def ordered(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, pos, role, text): places from 0 in the order of the turn number, a null first, and for equal numbers
    of role and text. Null roles and texts count as empty, rows with a null conversation are left out."""
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        text(role_col).alias("role"),
        text(text_col).alias("text"),
    ).filter("conv_id is not null")
    numbered = number_rows(rows, ["turn", "role", "text"], over=["conv_id"], name="pos")
    return numbered.select("conv_id", (F.col("pos") - 1).alias("pos"), "role", "text")


SEGMENT = "conv_id bigint, seg bigint, prefix binary, last boolean, turns array<struct<pos: bigint, turn: binary, size: bigint>>"


def segments(said: DataFrame, convs: DataFrame, length: int = TURNS_PER_SEGMENT) -> DataFrame:
    """Segments of conversations, in order, with the hash of the turns before them. Each has its own row, so a long
    conversation is many rows; only their number, not the turns, is put in order by one task."""
    role = F.col("role")
    said_text = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.col("text"))
    facts = said.select(
        "conv_id",
        "pos",
        F.unhex(F.substring(F.sha2(said_text.cast("binary"), 256), 1, 30)).alias("turn"),
        F.octet_length("text").cast("long").alias("size"),
    )
    # A mark before the first turn: conversations without turns have a segment too.
    marks = convs.selectExpr("conv_id", "-1L as pos", "cast(null as binary) as turn", "0L as size")
    seg = F.floor(F.greatest("pos", F.lit(0)) / length).alias("seg")
    rows = facts.unionAll(marks).select("conv_id", seg, F.struct("pos", "turn", "size").alias("said"))
    parts = rows.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    parts = stage(parts, "segments")
    later = parts.filter("seg > 0")
    if not later.take(1):
        zero = F.lit(bytes(16)).alias("prefix")
        return parts.select("conv_id", "seg", zero, F.lit(True).alias("last"), "turns")

    def own_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            found = []
            for turns in some.column("turns").to_pylist():
                prefix, n = 0, 0
                for t in turns:
                    if t["turn"] is not None:
                        prefix, n = roll(prefix, int.from_bytes(t["turn"], "big")), n + 1
                found.append((n, prefix.to_bytes(16, "big")))
            made = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([some.column("conv_id"), some.column("seg"), *made], ["conv_id", "seg", "n", "own"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, prefix = None, 0
        for some in batches:
            before = []
            for conv, n, own in zip(*(some.column(c).to_pylist() for c in ("conv_id", "n", "own")), strict=True):
                if conv != of:
                    of, prefix = conv, 0
                before.append(prefix.to_bytes(16, "big"))
                prefix = (prefix * pow(BASE, n, PRIME) + int.from_bytes(own, "big")) % PRIME
            yield pa.RecordBatch.from_arrays(
                [some.column("conv_id"), some.column("seg"), pa.array(before, pa.binary())], ["conv_id", "seg", "prefix"]
            )

    long = later.groupBy("conv_id").agg(F.max("seg").alias("most"))
    known = parts.join(long.select("conv_id"), "conv_id", "left_semi")
    known = known.mapInArrow(own_hash, "conv_id bigint, seg bigint, n bigint, own binary")
    known = known.repartition(shuffle_partitions(said.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seg")
    known = stage(known.mapInArrow(carry, "conv_id bigint, seg bigint, prefix binary"), "prefixes")
    joined = parts.join(known, ["conv_id", "seg"], "left").join(long, "conv_id", "left")
    prefix, last = F.coalesce("prefix", F.lit(bytes(16))), F.col("seg") == F.coalesce("most", F.lit(0))
    return stage(joined.select("conv_id", "seg", prefix.alias("prefix"), last.alias("last"), "turns"), "segments")


def _partial(parts: DataFrame, sums: list[str], length: int, turns_per_trie: int) -> DataFrame:
    """Rows of the nodes of every batch's trie, and, with an ``end``, of the end of every conversation."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(sums))
        for some in rows:
            columns = [some.column(c).to_pylist() for c in ("conv_id", "seg", "prefix", "last", "turns", *sums)]
            ends = []
            for conv, seg, prefix, last, turns, *numbers in zip(*columns, strict=True):
                turns = [t for t in turns if t["turn"] is not None]
                ints = [int.from_bytes(t["turn"], "big") for t in turns]
                path = Path(seg * length, int.from_bytes(prefix, "big"), ints, [t["size"] for t in turns])
                trie.insert(path, conv, numbers)
                if last:
                    ends.append((*path.at(path.end), None, 0, conv, [0] * len(sums)))
                if trie.turns >= turns_per_trie:
                    yield batch(trie.expanded(), False)
                    trie = Trie(len(sums))
            yield batch(ends, True)
        yield batch(trie.expanded(), False)

    def batch(found: Iterable[tuple], end: bool) -> pa.RecordBatch:
        found = list(found)
        as_bytes = lambda h: None if h is None else h.to_bytes(16, "big")
        columns = [
            pa.array([f[0] for f in found], pa.int64()),
            pa.array([as_bytes(f[1]) for f in found], pa.binary()),
            pa.array([as_bytes(f[2]) for f in found], pa.binary()),
            pa.array([f[3] for f in found], pa.int64()),
            pa.array([f[4] for f in found], pa.int64()),
            pa.array([end] * len(found), pa.bool_()),
            *(pa.array([f[5][i] for f in found], pa.int64()) for i in range(len(sums))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["depth", "hash", "above", "size", "conv_id", "end", *sums])

    schema = "depth bigint, hash binary, above binary, size bigint, conv_id bigint, end boolean"
    return parts.mapInArrow(batches, ", ".join([schema, *(f"{c} bigint" for c in sums)]))


NODE = ["depth", "hash"]


def prefix_tree(
    said: DataFrame,
    convs: DataFrame | None = None,
    length: int = TURNS_PER_SEGMENT,
    turns_per_trie: int = TURNS_PER_TRIE,
) -> DataFrame:
    """One row per distinct prefix of the conversations ``said`` (conv_id, pos, role, text), see ``ordered``.

    depth, hash (of the prefix, 16 bytes); conv_id, the smallest conversation through it; parent_conv_id, that of the
    node above, null at the root; n_convs; n_children; n_leaves, nodes without children in its subtree, itself included;
    saved_tokens, over its subtree the UTF-8 bytes of a node's last text times its conversations but one; ends_sha256,
    of the ids that end here, ascending and joined by commas.

    ``convs`` (conv_id) may name conversations without turns; they go through the root alone. Copies of a conversation
    with ids of their own are conversations; no conversations, no rows, not even a root. Prefixes are told apart by
    hashes of 127 bits. The ids that end at one node are one digest's input, so their text, in bounded pieces, passes
    through one task; all else of a node is summed per batch first.
    """
    convs = said.select("conv_id").distinct() if convs is None else convs
    parts = segments(said, convs, length)
    rows = stage(_partial(parts.withColumn("n_convs", F.lit(1).cast("long")), ["n_convs"], length, turns_per_trie), "tries")
    nodes = rows.filter("not end").groupBy(*NODE).agg(
        F.max("above").alias("above"),
        F.max("size").alias("size"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
    )
    nodes = stage(nodes, "nodes")
    root = nodes.filter("depth = 0").first()
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("hash"))
    nodes = nodes.join(below.agg(F.count("*").alias("n_children")), NODE, "left")
    saves = (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saves": saves})

    # Places in the chains: what a chain saves before a node, and whether the node is its top.
    order = [F.col("depth").asc()]
    chained = cut_slices(nodes, ["conv_id"], order)
    nodes = stage(running_before(chained, ["conv_id"], order, {"saved": F.col("saves"), "rows": F.lit(1)}), "chains")
    owners = nodes.groupBy("conv_id").agg(
        F.sum("saves").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    weighed = parts.join(owners, "conv_id", "left")
    weighed = weighed.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("saved", "leaves")})
    sums = _partial(weighed, ["saved", "leaves"], length, turns_per_trie).filter("not end").groupBy(*NODE)
    nodes = nodes.join(sums.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves")), NODE)

    tops = nodes.filter("rows_before = 0 and depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("above").alias("hash"), "conv_id")
    owner = nodes.select(*NODE, F.col("conv_id").alias("parent"))
    parents = tops.join(owner, NODE).select((F.col("depth") + 1).alias("depth"), "conv_id", "parent")
    # A chain has one top, so its conversation and depth tell it.
    nodes = nodes.join(parents, ["depth", "conv_id"], "left")
    parent = F.when(F.col("depth") == 0, None).when(F.col("rows_before") > 0, F.col("conv_id"))
    parent = parent.when(F.col("depth") == 1, F.lit(root and root["conv_id"])).otherwise(F.col("parent"))
    ends = _ends(rows.filter("end").select(*NODE, "conv_id"))
    return nodes.join(ends, NODE, "left").select(
        *NODE,
        "conv_id",
        parent.cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("saved") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, hash, ends_sha256): the digest of the ids, cut into sorted slices and joined slice by slice."""
    sliced = cut_slices(rows, NODE, [F.col("conv_id").asc()])
    ids: Column = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = sliced.groupBy(*NODE, "__slice").agg(F.concat_ws(",", ids).alias("ids"))
    pieces = pieces.repartition(shuffle_partitions(rows.sparkSession), *NODE).sortWithinPartitions(*NODE, "__slice")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest = None, None
        for part in parts:
            done = []
            for depth, node, ids in zip(*(part.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (depth, node) != of:
                    if of is not None:
                        done.append((*of, digest.hexdigest()))
                    of, digest = (depth, node), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield batch(done)
        if of is not None:
            yield batch([(*of, digest.hexdigest())])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate(types)], [*NODE, "ends_sha256"]
        )

    return pieces.mapInArrow(batches, "depth bigint, hash binary, ends_sha256 string")
