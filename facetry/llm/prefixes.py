"""Prefix trie of conversations: one node for each distinct sequence of first turns, with counts of its subtree.

Splitter-skeleton. A conversation is its path, the joined 16-byte digests of its turns (of role and text), so paths in
byte order are the trie in preorder. Conversations are dealt into shards by splitters, a bounded sample of (path, conv_id)
in order; equal paths spread over shards by conv_id. A node with members in two shards is a prefix of the splitter
between them, so all nodes but the prefixes of the two splitters at a shard's ends are finished inside the shard. The
trie of the splitter paths, the skeleton, is broadcast; its nodes leave every shard as partial sums, are reduced by
Spark, and add up their subtrees in one pass over the skeleton. It has at most ``skeleton`` nodes (fewer splitters are
taken otherwise; at least one path), whatever the number of conversations.

A node's list of members that end there is hashed while it is read in order; a skeleton node's list leaves the shards
as pieces of up to 1 MB, which a task hashes one after another, as SHA-256 cannot be split.

Edge rows: turns are ordered by turn (null first), then by the digest of role and text; repeated rows are repeated
turns. A null role or text is empty. A null conv_id names no conversation. An empty table has no nodes, not even the
root. A conversation's digests and sizes (20 bytes a turn, not its texts) are one row, so one conversation of 10^7 turns
is 200 MB in a task; texts of any length are only hashed. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.session import small, written

WIDTH = 16
PIECE = 1 << 20
KINDS = LOCAL, PARTIAL, ENDS = 0, 1, 2
#: What shards give: finished nodes, partial sums of skeleton nodes (owner, depth), pieces of their lists of ends.
GIVEN = "kind int, owner int, depth long, parent_owner int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, ends_sha256 string, shard int, nth int, piece binary"
COLUMNS = GIVEN.replace(",", "").split()[::2]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for t in GIVEN.replace(",", "").split()[1::2]]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, path, sizes (UTF-8 bytes of each turn's text) of each conversation, turns in order."""
    said = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH))
    rows = said.select("conv_id", F.struct("turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    return grouped.select("conv_id", path.alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def branched(seqs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % ``family`` in place of its own first h; h = crc32(c) % ``most``.

    A family has at most ``family`` conversations, so no key of the join is hot.
    """
    head = seqs.select(F.col("conv_id").alias("_base"), F.substring("path", 1, WIDTH * (most - 1)).alias("_path"), F.slice("sizes", 1, most - 1).alias("_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = seqs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).join(head, "_base", "left").withColumn("_h", h)
    first = F.coalesce(F.substr("_path", F.lit(1), F.col("_h") * WIDTH), F.lit(b""))
    sizes = F.coalesce(F.slice("_sizes", F.lit(1), F.col("_h")), F.array().cast("array<bigint>"))
    return met.select(
        "conv_id", F.concat(first, F.substr("path", F.col("_h") * WIDTH + 1)).alias("path"),
        F.concat(sizes, F.slice("sizes", F.col("_h") + 1, F.greatest(F.size("sizes"), F.lit(1)))).alias("sizes"))


def shared(a: bytes, b: bytes | None) -> int:
    """Turns that both paths begin with; -1 if there is no other path (then not even the root is shared)."""
    if b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


def splitters(seqs: DataFrame, shard_turns: int, skeleton: int) -> list[tuple[bytes, int]]:
    """(path, conv_id) in order, each the greatest of its shard; from a sample by hash of about 16 conversations a shard.

    Shards hold about ``shard_turns`` turns; more if the splitter paths together had more than ``skeleton`` nodes.
    """
    n, turns = seqs.agg(F.count(F.lit(1)), F.sum(F.size("sizes") + 1)).first()
    shards = max(1, min(-(-(turns or 0) // shard_turns), skeleton // max(1, (turns or 0) // max(n, 1))))
    if shards < 2:
        return []
    every = max(1, n // (16 * shards))
    sample = sorted((bytes(r[0]), r[1], r[2]) for r in seqs.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("path", "conv_id", F.size("sizes") + 1).collect())
    step, passed, found, nodes = sum(s for _, _, s in sample) / shards, 0, [], 0
    for path, conv, size in sample[:-1]:
        passed += size
        if passed >= step and (nodes + size <= skeleton or not found):
            found.append((path, conv))
            nodes, passed = nodes + size, 0
    return found


def owners(paths: list[bytes]) -> list[list[int]]:
    """For each splitter path and depth, the first splitter with the same prefix: with the depth, the skeleton node's name."""
    found: list[list[int]] = []
    for i, p in enumerate(paths):
        same = shared(p, paths[i - 1]) if i else -1
        found.append((found[-1][: same + 1] if i else []) + [i] * (len(p) // WIDTH - same))
    return found


class Node:
    __slots__ = ("depth", "size", "conv", "n", "children", "leaves", "saved", "hash", "held", "pieces", "rows")

    def __init__(self, depth: int, size: int, conv: int):
        self.depth, self.size, self.conv = depth, size, conv
        self.n = self.children = self.leaves = self.saved = 0
        self.hash, self.held, self.pieces, self.rows = None, [], [], []

    def ended(self, conv: int, whole: bool) -> None:
        """A member ends here. Ids are held as text up to a piece, then hashed or, if shards share the node, kept as pieces."""
        self.held.append(str(conv))
        if len(self.held) * 8 >= PIECE:
            self.flush(whole)

    def flush(self, whole: bool) -> None:
        if not self.held:
            return
        said = ",".join(self.held).encode()
        self.held = []
        if not whole:
            self.pieces.append(said)
        elif self.hash is None:
            self.hash = hashlib.sha256(said)
        else:
            self.hash.update(b"," + said)


def shard_nodes(rows: Iterator[tuple[bytes, int, list[int]]], shard: int, low: bytes | None, high: bytes | None, low_owner: list[int], high_owner: list[int]) -> Iterator[tuple]:
    """Rows of GIVEN from the sorted conversations of a shard between two splitter paths."""
    stack: list[Node] = []
    before: bytes = b""
    common = -1  # greatest depth at which the open path is on the skeleton

    def name(depth: int, path: bytes) -> int:
        return low_owner[depth] if shared(path, low) >= depth else high_owner[depth]

    def close(down_to: int, path: bytes) -> Iterator[tuple]:
        while len(stack) > down_to:
            node = stack.pop()
            if node.depth <= common:
                node.flush(False)
                owner = name(node.depth, path)
                parent = name(node.depth - 1, path) if node.depth else None
                yield (PARTIAL, owner, node.depth, parent, node.conv, None, node.n, node.children, node.leaves, node.saved, node.size, None, None, None, None)
                for i, piece in enumerate(node.pieces):
                    yield (ENDS, owner, node.depth, None, None, None, None, None, None, None, None, None, shard, i, piece)
                for r in node.rows:
                    yield (LOCAL, None, node.depth + 1, owner, r[0], None, *r[1:5], None, r[5], None, None, None)
                continue
            node.flush(True)
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n - 1) * node.size
            for r in node.rows:
                yield (LOCAL, None, node.depth + 1, None, r[0], node.conv, *r[1:5], None, r[5], None, None, None)
            done = (node.conv, node.n, node.children, leaves, saved, (node.hash or hashlib.sha256()).hexdigest())
            if not stack:
                yield (LOCAL, None, 0, None, done[0], None, *done[1:5], None, done[5], None, None, None)
                continue
            up = stack[-1]
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            up.rows.append(done)

    for path, conv, sizes in rows:
        if stack:
            yield from close(shared(path, before) + 1, before)
        common = max(shared(path, low), shared(path, high))
        for depth in range(len(stack), len(sizes) + 1):
            stack.append(Node(depth, sizes[depth - 1] if depth else 0, conv))
        for node in stack:
            node.n += 1
            node.conv = min(node.conv, conv)
        stack[-1].ended(conv, stack[-1].depth > common)
        before = path
    yield from close(0, before)


def _batches(rows: Iterator[tuple], step: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == step:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], names=COLUMNS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TYPES)], names=COLUMNS)


def subtree_sums(reduced: DataFrame) -> DataFrame:
    """owner, depth, parent_owner, conv_id, n_convs, n_children, n_leaves, saved of the whole skeleton: children are added to parents.

    One pass in reverse preorder over the at most ``skeleton`` rows; it holds the open ancestors.
    """
    schema = "owner int, depth long, parent_owner int, conv_id long, n_convs long, n_children long, n_leaves long, saved long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due: dict[tuple, list[int]] = {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                children, leaves, saved = (r[k] + x for k, x in zip(("n_children", "n_leaves", "saved"), due.pop((r["owner"], r["depth"]), (0, 0, 0))))
                leaves, saved = leaves if children else 1, saved + (r["n_convs"] - 1) * r["size"]
                if r["depth"]:
                    up = due.setdefault((r["parent_owner"], r["depth"] - 1), [0, 0, 0])
                    up[:] = up[0] + 1, up[1] + leaves, up[2] + saved
                out.append({"owner": r["owner"], "depth": r["depth"], "parent_owner": r["parent_owner"], "conv_id": r["conv_id"], "n_convs": r["n_convs"], "n_children": children, "n_leaves": leaves, "saved": saved})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.int32() if c.endswith("owner") else pa.int64()) for c in schema.replace(",", "").split()[::2]]))

    return reduced.coalesce(1).sortWithinPartitions(F.desc("owner"), F.desc("depth")).mapInArrow(run, schema)


def hashed_ends(pieces: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the pieces of a skeleton node in order of shard, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[tuple[int, int], bytes]]:
            for b in batches:
                for owner, depth, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    yield (owner, depth), piece.as_py()

        out = []
        for (owner, depth), those in groupby(pairs(), lambda x: x[0]):
            digest, first = hashlib.sha256(), True
            for _, piece in those:
                digest.update(piece if first else b"," + piece)
                first = False
            out.append((owner, depth, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.string()))], names=["owner", "depth", "ends_sha256"])

    ordered = pieces.select("owner", "depth", "piece", "shard", "nth").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "shard", "nth")
    return ordered.mapInArrow(run, "owner int, depth long, ends_sha256 string")


def prefix_trie(seqs: DataFrame, shard_turns: int = 20_000, skeleton: int = 1 << 20) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = seqs.sparkSession
    seqs = written(seqs, "sequences")
    cuts = splitters(seqs, shard_turns, skeleton)
    shape = spark.sparkContext.broadcast((cuts, owners([p for p, _ in cuts])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_left(shape.value[0], key) for key in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def convs() -> Iterator[tuple]:
            for b in batches:
                for x in range(0, len(b), 1000):
                    yield from zip(*[c.to_pylist() for c in b.slice(x, 1000).columns])

        def nodes() -> Iterator[tuple]:
            cuts, owner = shape.value
            for shard, those in groupby(convs(), lambda r: r[0]):
                low, high = (cuts[shard - 1][0] if shard else None), (cuts[shard][0] if shard < len(cuts) else None)
                yield from shard_nodes((r[1:] for r in those), shard, low, high, owner[shard - 1] if shard else [], owner[shard] if shard < len(cuts) else [])

        yield from _batches(nodes())

    dealt = seqs.select("path", "conv_id", "sizes").mapInArrow(deal, "shard int, path binary, conv_id long, sizes array<long>")
    sharded = dealt.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    given = written(sharded.mapInArrow(finish, GIVEN), "trie-shards")
    reduced = given.where(F.col("kind") == PARTIAL).groupBy("owner", "depth", "parent_owner").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("size").alias("size"))
    bones = written(subtree_sums(reduced), "trie-skeleton")
    n = bones.count()
    ends = hashed_ends(given.where(F.col("kind") == ENDS))
    up = small(bones.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_up")), n, skeleton)
    nothing = F.lit(hashlib.sha256().hexdigest())
    top = bones.join(ends, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", "parent_owner"]
    nodes = given.where(F.col("kind") == LOCAL).select(*columns).unionByName(top.select(*columns)).join(up, ["parent_owner", "depth"], "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "_up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def conversation_trie(turns: DataFrame, shard_turns: int = 20_000) -> DataFrame:
    """The trie of ``branched`` conversations."""
    return prefix_trie(branched(sequences(turns)), shard_turns)
