"""Conversation prefix trie with vertical bitmaps.

Conversations are dealt to tasks by ranges of their ids, and each task cuts its range into shards of at most
``SHARD_TURNS`` turns. A shard is indexed vertically: for each position and turn, the bitset of the conversations
that have this turn there. The trie is walked depth first. The members of a child are the members of its parent
and the posting of its turn, met bit by bit; the lowest member that isn't placed yet names the next posting, so
there is one intersection per child. Bit counts are the members of the shard, and what a node shares with the
bitset of the conversations that end at its depth is its end list.

A node is named by a digest chained over its turns, so the shards' nodes meet by that name: counts add up, the
smallest id wins, and end lists follow each other because the shards are ranges of ids. A node known to one
shard only has its whole subtree there, and the sums over its subtree are the shard's own. Only nodes of several
shards need more: their sums follow parent links by doubling, in as many rounds as the depth has binary digits.

A conversation longer than a shard is a chain of nodes and is streamed; no task holds it. What a task holds is
bounded by ``SHARD_TURNS``, and an end list comes in pieces of one shard.

Defined cases: null role or text is empty; null turns come first; turns with equal numbers are ordered by the
digest of role and text, repeated rows stay turns of their own; rows with a null conversation id belong to no
conversation and are left out. Texts of any length travel as digests. An empty table has no nodes, not even a
root. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import batch_of

#: Turns of a shard, at most (a single longer conversation is streamed), and rows of an output batch.
SHARD_TURNS, BATCH_ROWS = 1 << 15, 1 << 13

_PART = pa.schema(
    [(c, pa.int64()) for c in ("d1", "d2", "p1", "p2", "depth", "chars", "n", "first", "parent_first", "children", "leaves", "saved")]
    + [("ends", pa.list_(pa.int64()))]
)
_PART_DDL = ", ".join(f"{c} long" for c in _PART.names[:-1]) + ", ends array<long>"
_NODE, _PARENT = ["d1", "d2"], ["p1", "p2"]
_ROOT = bytes(16)


def turn_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, digest, chars``: each turn as a 128-bit digest of role and text, and the text's code points."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    out = rows.where(F.col(conv).isNotNull())
    return out.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"),
        F.length(t).cast("long").alias("chars"),
    )


def numbered(digests: DataFrame) -> DataFrame:
    """Add ``place`` = 1, 2, 3 … of each turn in its conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return digests.withColumn("place", F.row_number().over(order).cast("long"))


def shared_heads(turns: DataFrame, base: Column, heads: Column, longest: int) -> DataFrame:
    """Conversations rebuilt on the beginnings of others, as ``conv_id, part, place, digest, chars``.

    ``turns`` is ``conv_id, place, digest, chars``; ``base`` and ``heads`` are columns of ``conv_id``. A conversation
    becomes the first ``heads`` turns (``longest`` at most) of conversation ``base``, or all of them if it has fewer, and
    then its own turns after its first ``heads``. A row without a digest stands for each conversation, so that those
    left without a turn are kept.
    """
    opening = F.array_sort(F.collect_list(F.struct("place", "digest", "chars")))
    begin = turns.where(F.col("place") <= longest).where(F.col("conv_id") == base)
    begin = begin.groupBy(F.col("conv_id").alias("base")).agg(opening.alias("opening"))
    convs = turns.where("place = 1").select("conv_id", heads.alias("heads"), base.alias("base"))
    taken = convs.where("heads > 0").join(begin, "base").withColumn("t", F.explode(F.slice("opening", F.lit(1), F.col("heads").cast("int"))))
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    own = turns.where(F.col("place") > heads).select("conv_id", F.lit(2).alias("part"), "place", "digest", "chars")
    return marks.unionByName(taken.select("conv_id", F.lit(1).alias("part"), "t.*")).unionByName(own)


class _Out:
    """Rows of the nodes of a task, given out in batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, digest, parent, depth, chars, n, first, parent_first, children, leaves, saved, ends):
        d, p = _halves(digest), _halves(parent) if parent is not None else (None, None)
        self.rows.append((*d, *p, depth, chars, n, first, parent_first, children, leaves, saved, ends or None))

    def full(self, least: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield batch_of(_PART, **dict(zip(_PART.names, zip(*self.rows, strict=True), strict=True)))
            self.rows = []


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _child(parent: bytes, turn: bytes) -> bytes:
    return blake2b(parent + turn, digest_size=16).digest()


def walk(convs: list[tuple[int, list[bytes], list[int]]], out: _Out) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard of ``(id, turns, code points)``, ids ascending."""
    posting: dict[tuple[int, bytes], int] = {}
    stop: dict[int, int] = {}
    for c, (_, turns, _) in enumerate(convs):
        bit = 1 << c
        stop[len(turns)] = stop.get(len(turns), 0) | bit
        for key in enumerate(turns):
            posting[key] = posting.get(key, 0) | bit
    # depth first; a node's row is kept until its subtree is done
    nodes: list[list] = []
    todo = [((1 << len(convs)) - 1, 0, _ROOT, -1, 0)]
    while todo:
        members, depth, digest, up, chars = todo.pop()
        own, n, first = len(nodes), members.bit_count(), (members & -members).bit_length() - 1
        rest = members & ~stop.get(depth, 0)
        ends, here = [], members ^ rest
        while here:
            low = here & -here
            ends.append(convs[low.bit_length() - 1][0])
            here ^= low
        children = 0
        while rest:
            c = (rest & -rest).bit_length() - 1
            turn = convs[c][1][depth]
            child = members & posting[depth, turn]
            rest &= ~child
            children += 1
            todo.append((child, depth + 1, _child(digest, turn), own, convs[c][2][depth]))
        nodes.append([digest, up, depth, chars, n, convs[first][0], children, int(not children), (n - 1) * chars, ends])
    for row in reversed(nodes):  # children stand behind their parents
        if row[1] >= 0:
            nodes[row[1]][7] += row[7]
            nodes[row[1]][8] += row[8]
    for digest, up, depth, chars, n, first, children, leaves, saved, ends in nodes:
        parent, parent_first = (nodes[up][0], nodes[up][5]) if up >= 0 else (None, None)
        out.add(digest, parent, depth, chars, n, first, parent_first, children, leaves, saved, ends)
        yield from out.full()


def _chain(conv: int, turns: Iterator[tuple[bytes, int]], out: _Out) -> Iterator[pa.RecordBatch]:
    """Nodes of one conversation, one after the other."""
    digest, parent, depth, chars = _ROOT, None, 0, 0
    for turn, size in turns:
        out.add(digest, parent, depth, chars, 1, conv, conv if depth else None, 1, 1, 0, None)
        yield from out.full()
        digest, parent, depth, chars = _child(digest, turn), digest, depth + 1, size
    out.add(digest, parent, depth, chars, 1, conv, conv if depth else None, 0, 1, 0, [conv])


def _shards(rows: Iterator[tuple[int, bytes | None, int]], out: _Out, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut turns that are sorted by conversation and place into shards, and walk them."""
    shard: list[tuple[int, list[bytes], list[int]]] = []
    held = 0  # turns and conversations in the shard
    row = next(rows, None)
    while row is not None:
        conv, turns, sizes = row[0], [], []

        def own():
            """The rest of this conversation's turns."""
            nonlocal row
            while row is not None and row[0] == conv:
                digest, size = row[1], row[2]
                row = next(rows, None)
                if digest is not None:
                    yield digest, size

        rest = own()
        for digest, size in rest:
            turns.append(digest)
            sizes.append(size)
            if len(turns) >= limit:
                break
        if len(turns) >= limit:  # longer than a shard: a chain
            if shard:
                yield from walk(shard, out)
            shard, held = [], 0
            yield from _chain(conv, _both(zip(turns, sizes, strict=True), rest), out)
            continue
        if shard and held + len(turns) + 1 > limit:
            yield from walk(shard, out)
            shard, held = [], 0
        shard.append((conv, turns, sizes))
        held += len(turns) + 1
    if shard:
        yield from walk(shard, out)
    yield from out.full(1)


def _both(first: Iterator, second: Iterator) -> Iterator:
    yield from first
    yield from second


def shard_tries(turns: DataFrame, order: list[str], shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of each shard, with the sums over the shard's own subtrees; written to a staged table."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for p in parts for x in zip(*(p.column(i).to_pylist() for i in range(3)), strict=True))
        yield from _shards(rows, _Out(), shard_turns)

    dealt = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", *order)
    return stage(dealt.select("conv_id", "digest", "chars").mapInArrow(run, _PART_DDL), "llm-trie-shards")


def end_digests(parts: DataFrame) -> DataFrame:
    """``d1, d2, n_ends, ends_sha256``: the ids that end at a node, ascending and comma-joined, hashed piece by piece."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, state, done = None, 0, None, []
        for p in batches:
            for d1, d2, ends in zip(*(p.column(i).to_pylist() for i in range(3)), strict=True):
                if (d1, d2) != now:
                    if now is not None:
                        done.append((*now, total, state.hexdigest()))
                    now, total, state = (d1, d2), 0, sha256()
                state.update(("," if total else "").encode() + ",".join(map(str, ends)).encode())
                total += len(ends)
            if done:
                yield batch_of(schema, **dict(zip(schema.names, zip(*done, strict=True), strict=True)))
                done = []
        if now is not None:
            yield batch_of(schema, d1=[now[0]], d2=[now[1]], n_ends=[total], ends_sha256=[state.hexdigest()])

    ends = parts.where("ends is not null").select(*_NODE, "first", "ends")
    # a shard is a range of ids, so its list lies before or behind any other's
    ends = ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "ends").select(*_NODE, "ends")
    return ends.mapInArrow(run, "d1 long, d2 long, n_ends long, ends_sha256 string")


def _subtree_sums(shared: DataFrame, kids: DataFrame) -> DataFrame:
    """``d1, d2, children, leaves, saved`` of the nodes of several shards, summed over their whole subtrees."""
    own = shared.join(kids, _NODE, "left").select(
        *_NODE, *_PARENT, F.coalesce("all_kids", F.lit(0)).alias("children"),
        (F.coalesce("kid_leaves", F.lit(0)) + F.when(F.col("all_kids").isNull(), 1).otherwise(0)).alias("leaves"),
        (F.coalesce("kid_saved", F.lit(0)) + (F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    sums = stage(own, "llm-trie-shared")
    deepest = shared.agg(F.max("depth").alias("d")).first()["d"] or 0
    for _ in range(int(deepest).bit_length()):
        up = sums.where("p1 is not null").groupBy(*_PARENT).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        up = up.withColumnsRenamed(dict(zip(_PARENT, _NODE, strict=True)))
        far = sums.where("p1 is not null").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        step = sums.join(up, _NODE, "left").join(far, _PARENT, "left")
        sums = stage(
            step.select(
                *_NODE, F.col("q1").alias("p1"), F.col("q2").alias("p2"), "children",
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "llm-trie-shared",
        )
    return sums.drop(*_PARENT)


def prefix_trie(turns: DataFrame, order: list[str], shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """Nodes and end lists of the trie of all conversations.

    ``turns`` is ``conv_id, digest, chars`` and the columns of ``order``, which sort the turns of a conversation; rows
    without a digest stand for conversations without turns.

    Nodes: ``d1, d2`` (name), ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved`` (sum of ``(n_convs - 1) * chars``) over the subtree. End lists: ``d1, d2, first, ends``,
    in pieces of one shard each.
    """
    parts = shard_tries(turns, order, shard_turns)
    whole = parts.groupBy(*_NODE).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min("parent_first").alias("parent_first"),
        F.count("*").alias("shards"), F.max("children").alias("children"), F.max("leaves").alias("leaves"),
        F.max("saved").alias("saved"),
    )
    whole = stage(whole, "llm-trie-nodes")
    shared = stage(whole.where("shards > 1").select(*_NODE, *_PARENT, "depth", "chars", "n", "first"), "llm-trie-top")
    up = shared.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("first").alias("up_first"))
    alone = F.when(F.col("shards") == 1, 1).otherwise(0)
    kids = whole.join(up, _PARENT, "left_semi").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    kids = kids.agg(
        F.count("*").alias("all_kids"), F.sum(alone * F.col("leaves")).alias("kid_leaves"), F.sum(alone * F.col("saved")).alias("kid_saved")
    )
    sums = _subtree_sums(shared, kids).withColumnsRenamed({c: f"all_{c}" for c in ("children", "leaves", "saved")})
    nodes = whole.join(sums, _NODE, "left").join(up, _PARENT, "left").select(
        *_NODE, "depth", F.col("first").alias("conv_id"), F.coalesce("up_first", "parent_first").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.coalesce("all_children", "children").alias("n_children"),
        F.coalesce("all_leaves", "leaves").alias("n_leaves"), F.coalesce("all_saved", "saved").alias("saved"),
    )
    return nodes, parts.where("ends is not null").select(*_NODE, "first", "ends")
