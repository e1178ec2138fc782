"""Offsets, overlap resolution and dictionary match against brute force."""

import random
import re

from pyspark.sql import functions as F

from veilwork.operators.audit import leaks
from veilwork.operators.dictionary import hit_rows
from veilwork.operators.spans import resolve_overlaps, span_rows
from veilwork.operators.wordlists import loose_names, strict_names
from veilwork.rules import Rule


def test_offsets_in_long_texts(corpus):
    """More than one block of matches, astral characters, and a text that holds the usual mark."""
    text = "".join(f"é{chr(0x1F600)}{chr(0xFDD0)} n{i}x" for i in range(1000))
    rows = span_rows(corpus([text]), [Rule("t", "t", "t", 1.0, "n[0-9]+")], ["doc_id"]).collect()
    assert len(rows) == 1000
    assert all(text[r.start:r.end] == r.raw_value for r in rows)
    assert all(text[max(0, r.start - 50):r.start] == r.left_ctx for r in rows)
    assert all(text[r.end:r.end + 20] == r.right_ctx for r in rows)


def greedy(spans):
    taken, kept = set(), []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[2], s[0], s[3])):
        cells = set(range(s[0], s[1]))
        if not cells & taken:
            taken |= cells
            kept.append(s)
    return sorted(kept)


def test_overlaps_like_brute_force(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for doc in range(40):
        spans = set()
        for i in range(rng.choice([1, 3, 30])):
            start = rng.randrange(60)
            spans.add((start, start + rng.randrange(1, 12), rng.choice([0.7, 0.9]), i))
        expected[doc] = greedy(spans)
        rows += [(doc, *s) for s in spans]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, confidence double, det_ord int")
    got = resolve_overlaps(df.withColumn("rule_ord", F.lit(0))).collect()
    for doc, spans in expected.items():
        assert sorted((r.start, r.end, r.confidence, r.det_ord) for r in got if r.doc_id == doc) == spans


def test_large_islands(spark):
    """Clusters of thousands of spans that all hang together: chains of equal ones, and mixed lengths."""
    rng = random.Random(11)
    chain = [(3 * i, 3 * i + 4, 0.9, i) for i in range(20_000)]
    mixed = {(s, s + rng.choice([2, 3, 5, 40, 900]), rng.choice([0.7, 0.9]), i) for i, s in enumerate(rng.choices(range(4000), k=3000))}
    rows = [(1, *s) for s in chain] + [(2, *s) for s in mixed]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, confidence double, det_ord int")
    got = resolve_overlaps(df.withColumn("rule_ord", F.lit(0))).collect()
    for doc, spans in ((1, chain), (2, mixed)):
        assert sorted((r.start, r.end, r.confidence, r.det_ord) for r in got if r.doc_id == doc) == greedy(spans)


def test_dictionary_hits_in_a_long_document(spark, corpus):
    """A document with 100,000 candidates of a large dictionary, which is tested against a bit filter first."""
    entries = [(f"name{i} sur{i % 7}", f"E{i}") for i in range(12_000)]
    text = " ".join(f"{entries[i % 15_000][0] if i % 15_000 < 12_000 else 'other word'}{',' if i % 3 else ''}" for i in range(100_000))
    got = hit_rows(corpus([text]), spark.createDataFrame(entries, "variant string, name string"), "name")
    want = sum(1 for i in range(100_000) if i % 15_000 < 12_000)
    row = got.selectExpr("count(*) as n", "count(distinct start) as starts", "sum(int(substring(name, 2) = regexp_extract(raw_value, 'name([0-9]+)', 1))) as same").first()
    assert (row.n, row.starts, row.same) == (want, want, want)


def brute_hits(text, variants):
    out, i = [], 0
    word = re.compile("[A-Za-z0-9_]")
    while i < len(text):
        hit = None
        if i == 0 or not word.match(text[i - 1]) or not word.match(text[i]):
            for v in sorted(variants, key=len, reverse=True):
                end = i + len(v)
                if text.startswith(v, i) and (end == len(text) or not word.match(text[end])):
                    hit = v
                    break
        if hit:
            out.append((i, i + len(hit), hit))
            i += len(hit)
        else:
            i += 1
    return out


def test_dictionary_like_brute_force(spark, corpus):
    rng = random.Random(3)
    pieces = ["a", "ab", "b_c", "+1", " ", " ", ".", "-", "(", "é", "Иван", "7", "a.b", "\n", "$x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    variants = {"ab", "a.b", "a b", "+1 ab", "(a", "b_c.", "Иван", "é a", "ab a.b", "7-7", "a\nab", "$x", "ab."}
    entries = spark.createDataFrame([(v, v) for v in variants], "variant string, name string")
    got = hit_rows(corpus(texts), entries, "name").collect()
    assert all(r.name == r.raw_value for r in got)
    for i, t in enumerate(texts):
        assert sorted((r.start, r.end, r.raw_value) for r in got if r.doc_id == i) == brute_hits(t, variants), t


def test_leaks_like_brute_force(spark, corpus):
    rng = random.Random(5)
    pieces = ["abcd", "xabcdy", "abc", "d", " ", "12 34", ".", "john.doe", "Иван!", "é", "@"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    values = ["abcd", "abcd abc", "d 12 34", "john.doe", "Иван", "c.xa", "2 34.", "dabc", "34", "(no)", "Иван!é"]
    registry = spark.createDataFrame([("c", v, "name", f"T{i}") for i, v in enumerate(values)],
                                     "case_id string, raw_value string, pii_type string, token string")
    got = {(r.doc_id, r.raw_value) for r in leaks(corpus(texts), registry, "c").collect()}
    assert got == {(i, v) for i, t in enumerate(texts) for v in values if len(v) >= 4 and v in t}


def test_names(spark, corpus):
    terms = spark.createDataFrame(
        [("anna", "firstname"), ("jo", "firstname"), ("Marie-Claire", "firstname"), ("Peeters", "lastname"),
         ("dubois", "lastname")],
        "term string, pii_type string",
    )
    docs = corpus(["Anna Peeters met jo Dubois, Marie-Claire and ANNA.", "Peeters, Jo", "anna the Peeters annas"])
    loose = {(r.doc_id, r.raw_value, r.pii_type) for r in loose_names(docs, terms).collect()}
    assert loose == {
        (0, "Anna", "firstname"), (0, "Peeters", "lastname"), (0, "Dubois", "lastname"),
        (0, "Marie-Claire", "firstname"), (1, "Peeters", "lastname"), (2, "anna", "firstname"), (2, "Peeters", "lastname"),
    }
    any_case = {(r.doc_id, r.raw_value) for r in loose_names(docs, terms, case_sensitive=False).collect()}
    assert (0, "ANNA") in any_case
    strict = {(r.doc_id, r.raw_value, r.pii_type) for r in strict_names(docs, terms).collect()}
    assert strict == {
        (0, "Anna", "firstname"), (0, "Peeters", "lastname"), (0, "jo", "firstname"), (0, "Dubois", "lastname"),
        (1, "Peeters", "lastname"), (1, "Jo", "firstname"),
    }
