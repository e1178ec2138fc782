"""SimHash near-dedup: fingerprints, a binary trie self-join, and connected components.

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles. Documents with
fingerprints at most ``max_bits`` bits apart are linked; a group is whatever links connect.

The self-join works on distinct fingerprints, so copies of a text are one row before anything is joined. With
``max_bits`` errors, at least one of ``max_bits + 1`` blocks of a pair is free of errors: each fingerprint goes
into that many binary tries, the trie of a block has its bits on top, and the traversal of node pairs begins
below the block with equal nodes and no errors. From there pairs of nodes are split bit by bit, differing bits
are added up, and a pair over the budget is pruned. A pair whose fingerprints are all connected already is
pruned too, so dense groups cost no pairs. The subtree of a block's value is a unit of work; a unit of more than
``unit_rows`` fingerprints is split into the pairs of its subtrees some levels below, each a unit of its own, so
that a block value shared by a third of all documents is spread. A unit gives a spanning star per
component, never all pairs. The stars of all units are joined to components by alternating large-star and
small-star rounds, each of them written before the next.

Defined cases: null or empty text has fingerprint 0 and is linked like any other. A text of fewer words than a
shingle is one shingle. Rows with equal ids come back as rows of their own. Null ids belong to a component but
never name it. An empty table gives an empty result. Other columns are ignored by ``near_groups`` and pass through
``drop_near_copies`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import batch_of, utf8, without

HASH_SEED = 42
#: Fingerprints of a unit of work before it is split.
UNIT_ROWS = 200_000
#: Node pairs that are expanded at once, and pairs of fingerprints below which nodes are compared directly.
FRONTIER, LEAF = 500_000, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_PRINTS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a whole text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - shingle]).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, fp`` of each document; ``tag`` is a hash of the text, ``fp`` the fingerprint as a signed long."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            fp = np.array([fingerprint(t, shingle) for t in utf8(p.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(fp.view(np.int64))], schema=_PRINTS)

    return rows.mapInArrow(run, "id long, tag long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Labels of the components among some fingerprints; a label is the smallest place in its component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.stale = True

    def unite(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            if not len(u):
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
            self.stale = True

    def run_end(self) -> np.ndarray:
        """End of the run of equal labels that each place lies in."""
        if self.stale:
            cut = np.append(np.flatnonzero(self.label[1:] != self.label[:-1]) + 1, len(self.label))
            self._end = cut[np.searchsorted(cut, np.arange(len(self.label)), side="right")]
            self.stale = False
        return self._end


def trie_components(value: np.ndarray, unit: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int, deep: np.ndarray, budget: int) -> np.ndarray:
    """Component labels of fingerprints that are sorted by (unit, lo, hi, value).

    All values of a unit agree in their first ``top`` bits. ``lo`` and ``hi`` are the next ``deep`` bits that the
    two sides of the unit have; where they differ, only pairs across the two sides are compared.
    """
    n = len(value)
    forest = _Forest(n)
    if not n:
        return forest.label
    new = np.ones(n, bool)
    new[1:] = (unit[1:] != unit[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    depth = deep[begin] + top
    ones: dict[int, np.ndarray] = {}

    def split(a0: np.ndarray, a1: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum(value >> np.uint64(bit) & np.uint64(1)))).astype(np.int64)
        return a1 - (ones[bit][a1] - ones[bit][a0])

    work: list[tuple[int, tuple[np.ndarray, ...]]] = []
    for d in np.unique(depth):
        own = depth == d
        b, e, t = begin[own], end[own], int(d) - top
        same = lo[b] == hi[b]
        work.append((int(d), (b[same], e[same], b[same], e[same], np.zeros(int(same.sum()), np.int64))))
        b, e = b[~same], e[~same]
        if len(b):  # the smaller prefix comes first, so one place parts the two sides
            side = value >> np.uint64(64 - top - t) & np.uint64((1 << t) - 1)
            part = np.concatenate(([0], np.cumsum(side == hi.astype(np.uint64))))
            mid = e - (part[e] - part[b])
            work.append((int(d), (b, mid, mid, e, _popcount((lo[b] ^ hi[b]).astype(np.uint64)))))

    while work:
        d, pairs = work.pop()
        if len(pairs[0]) > FRONTIER:
            work.append((d, tuple(x[FRONTIER:] for x in pairs)))
            pairs = tuple(x[:FRONTIER] for x in pairs)
        a0, a1, b0, b1, bits = pairs
        run, label = forest.run_end(), forest.label
        same = a0 == b0
        live = (a1 > a0) & (b1 > b0) & (bits <= budget) & ~(same & (a1 - a0 == 1))
        at_a, at_b = np.minimum(a0, n - 1), np.minimum(b0, n - 1)
        live &= ~((run[at_a] >= a1) & (run[at_b] >= b1) & (label[at_a] == label[at_b]))
        a0, a1, b0, b1, bits, same = (x[live] for x in (a0, a1, b0, b1, bits, same))
        if not len(a0):
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (d >= 64)
        if small.any():
            s0, s1, t0, t1, eq = a0[small], a1[small], b0[small], b1[small], same[small]
            width = t1 - t0
            count = (s1 - s0) * width
            each = np.repeat(np.arange(len(s0)), count)
            k = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            u, v = s0[each] + k // width[each], t0[each] + k % width[each]
            keep = ~eq[each] | (u < v)
            u, v = u[keep], v[keep]
            near = _popcount(value[u] ^ value[v]) <= budget
            forest.unite(u[near], v[near])
        a0, a1, b0, b1, bits, same = (x[~small] for x in (a0, a1, b0, b1, bits, same))
        if not len(a0):
            continue
        bit = 63 - d
        am, bm = split(a0, a1, bit), split(b0, b1, bit)
        other = ~same  # a node with itself has its two children with each other once
        children = (
            np.concatenate((a0, am, a0, am[other])), np.concatenate((am, a1, am, a1[other])),
            np.concatenate((b0, bm, bm, b0[other])), np.concatenate((bm, b1, b1, bm[other])),
            np.concatenate((bits, bits, bits + 1, bits[other] + 1)),
        )
        work.append((d + 1, children))
    return forest.label


def links(prints: DataFrame, max_bits: int, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints ``fp`` that connect all that are ``max_bits`` bits apart."""
    blocks = max_bits + 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    top = min(b - a for a, b in zip(edge[:-1], edge[1:], strict=True))
    turned = [
        F.struct(
            F.lit(i).alias("rot"),
            (F.shiftleft("fp", edge[i]).bitwiseOR(F.shiftrightunsigned("fp", 64 - edge[i])) if edge[i] else F.col("fp")).alias("value"),
        )
        for i in range(blocks)
    ]
    rows = prints.select(F.inline(F.array(*turned)))
    rows = rows.withColumn("unit", F.shiftrightunsigned("value", 64 - top) * blocks + F.col("rot"))
    sizes = rows.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > unit_rows)
    sizes = stage(sizes.select("unit", F.least(F.ceil(F.log2(F.col("n") / unit_rows)), F.lit(12)).cast("int").alias("deep")), "llm-units")
    # at most blocks * 2**top units
    rows = rows.join(F.broadcast(sizes) if blocks << top <= 1 << 19 else sizes, "unit", "left").withColumn("deep", F.coalesce("deep", F.lit(0)))

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            unit, value, deep = (p.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out = []
            for t in np.unique(deep).tolist():
                own = np.flatnonzero(deep == t)
                v = value[own].view(np.uint64)
                side = (v >> np.uint64(64 - top - t) & np.uint64((1 << t) - 1)).astype(np.int64)
                flips = np.arange(1 << t)
                flips = flips[_popcount(flips.astype(np.uint64)) <= max_bits]
                for f in flips.tolist():
                    out.append((unit[own], np.minimum(side, side ^ f), np.maximum(side, side ^ f), value[own], np.full(len(own), t)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["unit", "lo", "hi", "value", "deep"])

    units = rows.select("unit", "value", "deep").mapInArrow(spread, "unit long, lo long, hi long, value long, deep long")
    # values of a unit agree in their first bit, so the order as signed numbers is the order of the trie
    parts_ = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts_, "unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi", "value")

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        unit, lo, hi, value, deep = cols
        v = np.ascontiguousarray(value).view(np.uint64)
        label = trie_components(v, unit, lo, hi, top, deep, max_bits)
        own = np.flatnonzero(label != np.arange(len(label)))
        back = np.array(edge)[(unit % blocks)]
        left, right = back.astype(np.uint64), ((64 - back) % 64).astype(np.uint64)
        fp = (v >> left) | np.where(back > 0, v << right, np.uint64(0))
        return batch_of(_LINKS, u=fp[label[own]].view(np.int64), v=fp[own].view(np.int64))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for p in parts:
            held.append([p.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            size += p.num_rows
            if size < 4 * FRONTIER // 10:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            if len(cut):  # the last unit may go on
                yield solve([c[: cut[-1] + 1] for c in cols])
                held = [[c[cut[-1] + 1 :] for c in cols]]
                size = len(held[0][0])
            else:
                held = [cols]
        if held:
            yield solve([np.concatenate(x) for x in zip(*held, strict=True)])

    return units.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``edges(u, v)``, by alternating large-star and small-star rounds."""
    state = None
    edges = stage(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct(), "llm-edges")
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == state or not seen["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stage(large.unionByName(least.select("u", F.col("m").alias("v")).where("u <> v")).distinct(), "llm-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stage(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "llm-small")


def near_groups(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text",
    unit_rows: int = UNIT_ROWS,
) -> DataFrame:
    """``id, tag, fp, component_id, stays`` of each document; ``stays`` marks one document per component."""
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "llm-prints")
    once = stage(prints.groupBy("fp").agg(F.min("id").alias("id"), F.min(F.struct("id", "tag")).alias("least")), "llm-prints-once")
    roots = stage(components(links(once.select("fp"), max_bits, unit_rows)), "llm-roots")
    named = once.join(roots, once["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("id").alias("component_id"), F.min("least").alias("least"))
    groups = stage(named.select("fp", "root").join(groups, "root").select("fp", "component_id", "least"), "llm-groups")
    out = prints.join(groups, "fp")
    return out.select("id", "tag", "fp", "component_id", F.struct("id", "tag").eqNullSafe(F.col("least")).alias("stays"))


def drop_near_copies(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One document of each group (the one with the smallest id), with all its columns."""
    groups = stage(near_groups(docs, shingle, max_bits, id_col, text_col), "llm-near")
    key = F.xxhash64("id", "tag").alias("__key")
    gone = stage(groups.where("not stays").select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), key).distinct(), "llm-near-gone")
    id_, tag = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    out = without(docs, F.xxhash64(id_, tag), gone, id_.eqNullSafe(gone["__id"]) & (tag == gone["__tag"]))
    if groups.where("stays").groupBy("id", "tag").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, text_col])
    return out
