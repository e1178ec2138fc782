"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veilwork.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns (role, text) per conversation: by turn, null first, then by the digest."""
    def digest(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            out.setdefault(conv, []).append(((turn is not None, turn or 0), digest(role, text), (role, text)))
    return {c: [x[2] for x in sorted(own)] for c, own in out.items()}


def trie(convs):
    """(depth, conv_id, parent, members, children, leaves, saved, ends) of every prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(k) == len(p) + 1 and k[: len(p)] == p for k in below)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        out.append((len(path), min(own), min(members[path[:-1]]) if path else None, len(own), len(kids), len(leaves), saved, ends))
    return sorted(out, key=lambda r: (*r[:2], r[3:]))


def rebuild(convs, block=100, most=6):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - c % block
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def found(nodes, ends):
    lists = {}
    for r in ends.collect():
        lists.setdefault((r.d1, r.d2), []).extend(r.ends)
    digests = {(r.d1, r.d2): (r.n_ends, r.ends_sha256) for r in prefixes.end_digests(ends).collect()}
    out = []
    for r in nodes.collect():
        own = ",".join(map(str, sorted(lists.get((r.d1, r.d2), []))))
        if own:
            assert digests[r.d1, r.d2] == (own.count(",") + 1, hashlib.sha256(own.encode()).hexdigest())
        out.append((r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, own))
    return sorted(out, key=lambda r: (*r[:2], r[3:]))


def conversations(seed, n=260):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rnd.choice([rnd.randrange(600), rnd.randrange(3) * 100, 7])
        turns = rnd.randrange(7)
        same = rnd.random() < 0.4
        for t in range(turns):
            text = f"t{t}" if same else rnd.choice(["", "é😀", None, f"x{rnd.randrange(3)}"])
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", "assistant", None]) if not same else "user", text))
    return rows


@pytest.mark.parametrize("seed,shard,parts", [(1, 1 << 15, 3), (2, 40, 4), (3, 5, 2)])
def test_trie(spark, seed, shard, parts):
    """Whole, over several shards, and with conversations longer than a shard."""
    rows = [*conversations(seed), (None, 1, "user", "lost"), *[(900, i, "user", f"t{i}") for i in range(30)], *[(901, i, "user", f"t{i}") for i in range(31)]]
    frame = spark.createDataFrame([(*r, 5) for r in rows], TURNS + ", depth int").repartition(parts)
    turns = prefixes.numbered(prefixes.turn_digests(frame))
    nodes, ends = prefixes.prefix_trie(turns, ["place"], shard)
    assert found(nodes, ends) == trie(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = conversations(5, 400)
    turns = prefixes.numbered(prefixes.turn_digests(spark.createDataFrame(rows, TURNS)))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(6))
    built = prefixes.shared_heads(turns, F.col("conv_id") - F.col("conv_id") % 100, heads, 5)
    nodes, ends = prefixes.prefix_trie(built, ["part", "place"], 64)
    want = trie(rebuild(ordered(rows)))
    assert found(nodes, ends) == want
    assert any(r[0] == 0 and r[7] for r in want)  # conversations left without a turn end at the root


def test_copies_of_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(4)]
    turns = prefixes.numbered(prefixes.turn_digests(spark.createDataFrame(rows, TURNS)))
    nodes, ends = prefixes.prefix_trie(turns, ["place"], 64)
    assert found(nodes, ends) == trie(ordered(rows))


def test_no_conversations(spark):
    turns = prefixes.numbered(prefixes.turn_digests(spark.createDataFrame([], TURNS)))
    nodes, ends = prefixes.prefix_trie(turns, ["place"])
    assert nodes.count() == 0 and prefixes.end_digests(ends).count() == 0


def test_long_texts(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (2, 0, "user", "x" * 2_000_000), (3, 0, "user", "x" * 2_000_001)]
    turns = prefixes.numbered(prefixes.turn_digests(spark.createDataFrame(rows, TURNS)))
    nodes, _ = prefixes.prefix_trie(turns, ["place"])
    assert sorted((r.depth, r.conv_id, r.n_convs, r.saved) for r in nodes.collect()) == [(0, 1, 3, 2_000_000), (1, 1, 2, 2_000_000), (1, 3, 1, 0)]
