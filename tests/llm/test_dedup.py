"""Substring, exact and near dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from veilwork.llm import exact, simhash
from veilwork.llm.substring import substring_dedup
from veilwork.llm.words import Rolling, Words, window_minimum

DOCS = "doc_id long, text string"


def phrases(rows, n):
    """Brute force: words under a window that starts earlier somewhere."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), (doc, i))
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if seen[tuple(words[i : i + n])] != (doc, i):
                gone[i : i + n] = [True] * n
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n_docs=150):
    rnd = random.Random(seed)
    lines = [[f"w{rnd.randrange(40)}é" for _ in range(rnd.randrange(3, 45))] for _ in range(30)]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(rnd.randrange(6)):
            line = list(rnd.choice(lines))
            if rnd.random() < 0.3:
                line[rnd.randrange(len(line))] = f"zz{rnd.randrange(9)}"
            if rnd.random() < 0.1:
                line = ["rep"] * rnd.randrange(60)
            words += line
        rows.append((d, rnd.choice([" ", "\n", "  \t", "\x0b"]).join(words) if rnd.random() > 0.03 else None))
    return rows


def found(out):
    return {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}


@pytest.mark.parametrize("seed,max_bits", [(1, 1 << 28), (2, 1 << 28), (3, 1)])
def test_substring(spark, seed, max_bits):
    rows = corpus(seed)
    got = found(substring_dedup(spark.createDataFrame(rows, DOCS).repartition(5), 20, max_bits=max_bits))
    want = phrases(rows, 20)
    assert got == want and sum(w[1] for w in want.values()) > 500


def test_substring_cases(spark):
    long_ = " ".join(f"a{i}" for i in range(120_000))
    rows = [(3, long_), (1, ""), (2, None), (7, " ".join(["x"] * 25)), (9, long_ + " tail"), (4, "\u00a0one\x1ctwo")]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, start int, key string")
    assert found(substring_dedup(frame, 20)) == phrases(rows, 20)
    assert substring_dedup(frame.limit(0), 20).count() == 0


def test_substring_repeated_and_null_ids(spark):
    line = " ".join(f"q{i}" for i in range(25))
    rows = [(5, line), (5, line), (None, line), (5, line + " more")]
    out = substring_dedup(spark.createDataFrame(rows, DOCS), 20).collect()
    assert sorted((r.id is None, r.n_words, r.n_removed) for r in out) == [
        (False, 25, 25), (False, 25, 25), (False, 26, 25), (True, 25, 0)
    ]


def test_words_and_rolling():
    texts = [b"", b" a  bb\t", b"ccccccccccccccccccccc a bb", b"\n"]
    w = Words(texts)
    assert np.diff(w.first).tolist() == [0, 2, 3, 0]
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    r = Rolling(h)
    assert r.windows(2)[0] == r.windows(2)[3] and r.at(np.array([0]), np.array([2]))[0] == r.windows(2)[0]
    v = np.array([5, 1, 3, 1, 9, 0, 0], np.uint64)
    assert window_minimum(v, 3).tolist() == [1, 1, 3, 5, 5]


def test_exact(spark):
    rows = [(1, "a"), (5, "a"), (3, "A"), (4, None), (6, ""), (7, "a "), (None, "n"), (5, "a")]
    frame = spark.createDataFrame([(*r, b"x", 1) for r in rows], DOCS + ", digest binary, keep_id int")
    got = exact.exact_groups(frame, exact.new_index(spark, 4)).collect()
    out = {(r.id, bytes(r.digest)): r for r in got}
    get = lambda i, t: out[i, hashlib.sha256(t.encode()).digest()]
    assert len(got) == len(rows) and len(out) == 7 and sum(r.kept for r in got if r.id == 5) == 2
    assert (get(1, "a").keep_id, get(1, "a").group_size, get(1, "a").kept) == (5, 3, False)
    assert get(5, "a").kept and get(3, "A").kept and get(7, "a ").kept and get(None, "n").kept
    assert not get(4, "").kept and get(6, "").kept
    kept = exact.drop_copies(frame, exact.new_index(spark, 4))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "n"), (3, "A"), (5, "a"), (6, ""), (7, "a ")]
    assert exact.drop_copies(frame.limit(0), exact.new_index(spark, 4)).count() == 0


def test_exact_index_is_kept(spark):
    index = exact.new_index(spark, 4)
    first = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    assert exact.drop_copies(first, index).count() == 2
    second = spark.createDataFrame([(8, "b"), (9, "c"), (10, "c")], DOCS)
    assert [(r.doc_id, r.text) for r in exact.drop_copies(second, index).collect()] == [(10, "c")]
    again = exact.DigestIndex(spark, "unused", 4, index.name)
    assert again.rows().count() == 3
    known = {r.id: (r.keep_id, r.known, r.kept) for r in exact.exact_groups(second, index).collect()}
    assert known == {8: (2, True, False), 9: (10, True, False), 10: (10, True, False)}
    again.forget()


def test_exact_batches_run_again(spark):
    """The even ids, then the rest; each batch again under its name, also after a part of its digests was lost."""
    rows = [(i, f"text {i % 7} {i % 2 if i > 20 else ''}") for i in range(60)] + [(61, None), (62, ""), (61, None)]
    frame = spark.createDataFrame(rows, DOCS)
    index = exact.new_index(spark, 4)
    parts = {"even": frame.where("doc_id % 2 = 0"), "odd": frame.where("doc_id % 2 = 1")}

    def run(name):
        return sorted(tuple(r) for r in exact.exact_groups(parts[name], index, batch=name).drop("tag").collect())

    first = {name: run(name) for name in parts}
    assert {name: run(name) for name in parts} == first and index.rows().count() == len({t or "" for _, t in rows})
    seen, want = {}, {}
    for name, part in parts.items():
        own = {}
        for r in part.collect():
            own.setdefault(r.text or "", []).append(r.doc_id)
        for text, ids in own.items():
            for i in ids:
                want.setdefault(name, []).append((i, seen.get(text, max(ids)), len(ids), text in seen, text not in seen and i == max(ids)))
        seen |= {t: seen.get(t, max(ids)) for t, ids in own.items()}
    assert {n: sorted(r[:5] for r in got) for n, got in first.items()} == {n: sorted(w) for n, w in want.items()}
    kept = exact.drop_copies(parts["odd"], index, batch="odd")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[0] for r in first["odd"] if r[4]})
    index.forget()


def test_columns_may_have_any_name(spark):
    frame = spark.createDataFrame([(1, "a", 7, 8, 9), (2, "a", 7, 8, 9)], DOCS + ", __own int, __id int, __key int")
    kept = exact.drop_copies(frame, exact.new_index(spark, 4))
    assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == [(2, "a", 7, 8, 9)]


def simhash_brute(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, budget):
    """Brute force: smallest place reachable over links."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("unit_rows,budget", [(200_000, 3), (10, 3), (10, 1), (200_000, 0)])
def test_trie_links(spark, unit_rows, budget):
    rnd = random.Random(unit_rows + budget)
    fps = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        fps.add(base)
        for _ in range(rnd.randrange(8)):
            fps.add(base ^ sum(1 << rnd.randrange(64) for _ in range(3)) & (1 << 64) - 1)
    dense = rnd.getrandbits(64)
    fps |= {dense ^ rnd.getrandbits(9) for _ in range(150)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), budget, unit_rows))
    got = {r.node: r.root for r in roots.collect()}
    groups, want = {}, {}
    for x, c in zip(signed, classes(fps, budget), strict=True):
        want.setdefault(c, set()).add(x)
        groups.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_groups(spark):
    rnd = random.Random(5)
    base = [[f"W{rnd.randrange(300)}" for _ in range(200)] for _ in range(12)]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "One"), (104, "two words"), (105, "TWO  WORDS")]
    for i in range(80):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(200)] = f"x{rnd.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows.append((500, " ".join(f"v{i}" for i in range(70_000))))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", fp int, tag int").repartition(6)
    out = {r.id: r for r in simhash.near_groups(frame).collect()}
    rows.sort()
    fps = [simhash_brute(t, 3) for _, t in rows]
    want = [rows[c][0] for c in classes(fps, 3)]
    assert [out[i].fp % (1 << 64) for i, _ in rows] == fps
    assert [out[i].component_id for i, _ in rows] == want
    kept = simhash.drop_near_copies(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(want)
    assert simhash.near_groups(frame.limit(0)).count() == 0


def test_near_copies_of_repeated_rows(spark):
    rows = [(1, "same text here now"), (1, "same text here now"), (2, "same text here now"), (None, "quite another one")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (True, None)]
