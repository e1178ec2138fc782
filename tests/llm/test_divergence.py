"""The source divergence audit against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from veilwork.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def audit(rows, top=200, least=3):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        groups = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= least) for s in {d[1] for d in own}}
        groups_p = {}
        whole = sum(groups.values(), Counter())
        for s, c in [*groups.items(), (None, whole)]:
            n = sum(c.values())
            groups_p[s] = {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}
        for s in groups:
            p = groups_p[s]
            pairs = [(o, sum((p[t] - groups_p[o][t]) ** 2 // groups_p[o][t] for t in kept)) for o in groups if o != s]
            q = groups_p[None]
            items = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", items, top)):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, n=400, sources=9):
    rnd = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3]}{'é' * (i % 4)}Q{'kl'[i % 2]}{'m' * (i // 60)}" for i in range(240)]
    rows = []
    for i in range(n):
        source = rnd.choice(["hot", "hot", "hot", *[f"s{k}" for k in range(sources)], None, ""])
        lang = rnd.choices(["aa", "bb", None, "only"], [10, 4, 2, 1])[0]
        size = rnd.choice([0, 3, 40])
        lo = rnd.randrange(200)
        text = rnd.choice([" ", "1", "_", "\n"]).join(rnd.choice(words[lo : lo + 40]) for _ in range(size))
        rows.append((i % 50, rnd.choice([text, text, text.upper(), None]), lang, source))
    return rows + [(9, "", "empty", "a"), (9, "one two", "empty", "b"), (9, None, "empty", "c")]


def found(out):
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("seed,tile,block", [(1, 64, 1 << 13), (2, 2, 16), (3, 4, 7)])
def test_divergence(spark, monkeypatch, seed, tile, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rows = corpus(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", rank int, term string").repartition(5)
    assert found(D.divergence(frame, 200, tile=tile)) == audit(rows)


def test_few_ranks(spark):
    rows = corpus(4)
    assert found(D.divergence(spark.createDataFrame(rows, DOCS), 3)) == audit(rows, top=3)


def test_no_documents(spark):
    assert D.divergence(spark.createDataFrame([], DOCS), 5).count() == 0


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 10)
    rows = corpus(6, 150)
    assert found(D.divergence(spark.createDataFrame(rows, DOCS), 200)) == audit(rows)


def test_long_texts_are_cut_at_gaps(monkeypatch):
    text = b"Alpha beta, " * 50 + b"x" * 900 + b" end"
    whole = [t for some in D.terms(text) for t in some]
    monkeypatch.setattr(D, "TEXT_BYTES", 64)
    pieces = list(D.terms(text))
    assert len(pieces) > 5 and [t for some in pieces for t in some] == whole


def test_runs_and_columns():
    rng = np.random.default_rng(1)
    for _ in range(50):
        size = int(rng.integers(1, 40))
        both = []
        for _ in range(2):
            dense = rng.integers(0, 3, size) * rng.integers(0, 2, size)
            at = np.flatnonzero(dense)
            first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(dense[at]) != 0)))) if len(at) else at
            length = np.diff(np.append(first, len(at)))
            starts, counts = D.full_column(at[first], length, dense[at][first], size)
            assert np.array_equal(np.repeat(counts, np.diff(np.append(starts, size))), dense)
            both.append((dense + 5, (starts, counts + 5)))
        (p, a), (q, b) = both
        assert D.met(a, b, size) == (int(((p - q) ** 2 // q).sum()), int(((p - q) ** 2 // p).sum()))


def test_large_counts_stay_exact():
    big = np.array([0, 10**11, 3 * 10**12])
    total = int(big.sum())
    assert D.probabilities(big, total, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 3) for c in big]
