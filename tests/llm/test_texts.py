"""Quality, language, tokens, mixing, chat, tiling and URLs."""

import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from veilwork.llm import chat, langid, mixing, quality, queries, tiling, urls
from veilwork.llm.tokens import count_tokens
from veilwork.plans.staging import stage_root

DOCS = "doc_id long, text string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ber", "ein", "ich"], "cc": ["é", "eau", "oi", "tre", "qu"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def language_rows(n=600):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        rows.append((i, prose(rnd, lang, rnd.randrange(3, 60)), lang))
    return rows


def test_language(spark):
    rows = language_rows()
    extra = [(9001, None, "aa"), (9002, "123 .. \u0661", "bb"), (9003, "", None), (9004, "Ж", "cc"), (9005, "kalo " * 50_000, None)]
    frame = spark.createDataFrame([(*r, 1, 0.5) for r in rows + extra], DOCS + ", lang string, id int, score double")
    model = langid.learn(frame)
    assert model.languages == sorted(SYLLABLES)
    out = {r.id: r for r in langid.identify(frame, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([out[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert [(out[i].lang_pred, out[i].score, out[i].rejected) for i in (9001, 9002, 9003)] == [("und", 0.0, True)] * 3
    assert out[9004].lang_pred != "und" and out[9005].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = langid.drop_rejected(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}


def test_language_ignores_held_out_labels(spark):
    rows = language_rows(400)
    frame = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("h", langid.held_out(F.col("doc_id")))
    wrong = frame.selectExpr("doc_id", "text", "if(h, 'zz', lang) as lang")
    a, b = langid.learn(frame.drop("h")), langid.learn(wrong)
    assert a.languages == b.languages and np.allclose(a.logits, b.logits)


def test_language_without_labels(spark):
    frame = spark.createDataFrame([(1, "kalo", None)], DOCS + ", lang string")
    assert [r.lang_pred for r in langid.identify(frame, langid.learn(frame)).collect()] == ["und"]
    assert langid.drop_rejected(frame.limit(0)).count() == 0


def test_subwords_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"ab cd", b"", b"x", "é ün".encode(), b"ABC"]
    bucket, first = langid.subwords(texts)
    alone = [np.sort(langid.subwords([t])[0]).tolist() for t in texts]
    assert [np.sort(bucket[a:b]).tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == alone


def test_quality(spark):
    rnd = random.Random(4)
    rows, ratings = [], []
    for i in range(900):
        grade = rnd.choice([0, 1, 2])
        words = prose(rnd, "aa", rnd.randrange(20, 80)).split()
        if grade == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vilely", "vilest"]))
        if grade == 1:
            words = [w + "$$" for w in words]
        rows.append((i, " ".join(words)))
        ratings.append((i, grade))
    frame = spark.createDataFrame([*rows, (9000, None), (9001, "")], DOCS)
    rated = spark.createDataFrame(ratings[:600] + [(5000, 1), (None, 2), (3, None)], "doc_id long, grade long")
    model = quality.learn(frame, rated)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = {r.id: r for r in quality.grade_documents(frame, model, 2).collect()}
    held = ratings[600:]
    assert np.mean([out[i].kept == (g == 2) for i, g in held]) > 0.95
    assert np.mean([round(out[i].expected_grade) == g for i, g in held]) > 0.85
    assert 0 <= out[9000].tail_prob <= 1 and out[9000].tail_prob == out[9001].tail_prob


def test_language_threshold():
    """Single wrong labels don't move the threshold; scores that are mostly wrong are rejected."""
    score = np.linspace(1, 0.3, 700)
    few = np.zeros(700, bool)
    few[[100, 250, 419, 600]] = True
    assert langid.threshold(score, few) == score[-1]
    one = np.zeros(120, bool)
    one[40] = True
    assert langid.threshold(score[:120], one) == score[119]
    low = np.zeros(700, bool)
    low[500:] = np.arange(200) % 4 > 0
    assert abs(langid.threshold(score, low) - score[499]) < 0.01
    assert langid.threshold(score, np.ones(700, bool)) == 0.0
    noisy = np.random.default_rng(1).random(700) < 0.2
    assert langid.threshold(score, noisy) < score[650]


def test_language_sample_is_bounded(spark, monkeypatch):
    """One id on all rows, and one text on many: neither swells nor starves what is learned from."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 100)
    seen = []
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(len(rows)))
    rows = [(0, f"kalo mi{i}", "aa") for i in range(2000)] + [(9, "schung ber", "bb")] * 2000
    langid.learn(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert 50 < seen[0] < 200


def test_language_by_hand():
    """Subwords, mean, softmax and temperature in plain Python."""
    rng = np.random.default_rng(5)
    model = langid.Model(["aa", "bb"], rng.normal(0, 1, (langid.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.7, 0.5)
    m32 = (1 << 32) - 1

    def buckets(text):
        out = []
        for word in re.findall(rb"[a-z\x80-\xff]+", text.lower()):
            word = b" " + word + b" "
            for i in range(len(word) - 2):
                three = word[i] | word[i + 1] << 8 | word[i + 2] << 16
                out.append((three * 0x9E3779B1 & m32) >> 17)
                if i + 3 < len(word):
                    h = ((three | word[i + 3] << 24) ^ 0x5BD1E995) * 0x85EBCA6B & m32
                    h ^= h >> 13
                    out.append((h * 0xC2B2AE35 & m32) >> 17)
        return out

    texts = [b"Kalo, mi!", "é ün".encode(), b"a", b"x1y2 zzz " * 40]
    lang, score, rejected = model.predict(texts)
    for k, text in enumerate(texts):
        own = buckets(text)
        z = [sum(float(model.logits[b, j]) for b in own) / len(own) + model.bias[j] for j in range(2)]
        e = [np.exp(x / model.temperature) for x in z]
        best = int(e[1] > e[0])
        assert lang[k] == model.languages[best] and abs(score[k] - e[best] / sum(e)) < 1e-5 and rejected[k] == (score[k] < 0.5)


def test_quality_by_hand():
    """Features, score, expected grade, tail and likelihood in plain Python."""
    rng = np.random.default_rng(6)
    size = quality.BUCKETS
    model = quality.Model(
        rng.normal(0, 1, size).astype(np.float32), rng.uniform(0.5, 2, size).astype(np.float32), rng.normal(0, 1, quality.MEASURES),
        rng.normal(0, 1, quality.MEASURES), rng.uniform(1, 2, quality.MEASURES), np.array([-0.5, 0.4, 1.5]), np.array([0, 2, 3, 10]),
    )

    def bucket(word, n=None):
        words = quality.Words([word], quality._GAP, quality._FOLD)
        return int((words.hashes() if n is None else words.prefixes(n)[1])[0] >> np.uint64(46))

    def score(text):
        raw = text.decode()
        words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower())
        count = {}
        for w in words:
            for b in [bucket(w), *[bucket(w, n) for n in quality.BEGINNINGS if len(w) > n]]:
                count[b] = count.get(b, 0) + 1
        value = {b: np.log1p(c) * model.idf[b] for b, c in count.items()}
        norm = sum(v * v for v in value.values()) ** 0.5
        ascii_ = [c for c in raw if c < "\x80" and c > " "]
        shares = [
            sum(not c.isalnum() for c in ascii_), sum(c.isdigit() for c in ascii_), sum(c.isupper() for c in ascii_),
        ]
        n, length = len(words), len(text)
        dense = [*[x / max(length, 1) for x in shares], len(set(words)) / max(n, 1), np.log1p(n), length / max(n, 1)]
        z = [min(5, max(-5, (x - m) / s)) for x, m, s in zip(dense, model.mean, model.spread, strict=True)]
        return sum(v * model.weights[b] for b, v in value.items()) / max(norm, 1e-9) + sum(a * b for a, b in zip(z, model.dense, strict=True))

    texts = ["Good words, good 12 GRAMMAR!".encode(), b"", "été longueword longuewords".encode(), b"a b c a"]
    assert np.allclose(model.score(texts), [score(t) for t in texts], atol=1e-5)
    expected, tail = model.grades(texts, 3)
    for k, t in enumerate(texts):
        over = [1 / (1 + np.exp(-(score(t) - x))) for x in model.thresholds]
        each = [1 - over[0], over[0] - over[1], over[1] - over[2], over[2]]
        assert abs(sum(each) - 1) < 1e-9 and abs(expected[k] - sum(p * g for p, g in zip(each, model.levels, strict=True))) < 1e-4
        assert abs(tail[k] - (each[2] + each[3])) < 1e-5


def test_quality_of_stray_grades(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, "aa" if i % 2 else "bb", 30)) for i in range(300)]
    frame = spark.createDataFrame(rows, DOCS)
    rated = spark.createDataFrame([(i, 1_000_000 if i % 2 else 5) for i in range(300)], "doc_id long, grade long")
    model = quality.learn(frame, rated)
    assert len(model.thresholds) == 1 and model.levels.tolist() == [5, 1_000_000]
    out = {r.id: r for r in quality.grade_documents(frame, model, 6).collect()}
    assert np.mean([out[i].kept == bool(i % 2) for i in range(300)]) > 0.95 and all(5 <= r.expected_grade <= 1_000_000 for r in out.values())
    with pytest.raises(ValueError, match="different grades"):
        quality.learn(frame, spark.createDataFrame([(i, i) for i in range(300)], "doc_id long, grade long"))


def test_tiling_of_signs_and_scripts(spark):
    """Typographic signs and scripts without blanks don't hide a passage."""
    plain = "the quick brown fox said it jumps over all the lazy dogs today"
    han = "\u6625\u7720\u4e0d\u89c9\u6653\u5904\u5904\u95fb\u557c\u9e1f\u591c\u6765\u98ce\u96e8\u58f0"
    docs = spark.createDataFrame(
        [
            (1, "x the quick\u00a0brown \u201cfox\u201d said\u2014it jumps over all the\u2026lazy dogs\u2019 today y"),
            (2, "\u524d\u6587\u3002" + han + "\u3002\u540e\u6587"), (3, "\u6625 \u548c \u590f"), (4, "quick the fox brown"),
        ],
        DOCS,
    )
    items = spark.createDataFrame([(1, plain), (2, han)], "item_id long, text string")
    for most in (8 << 20, 0):
        hits = tiling.contaminated(docs, items, max_bytes=most).collect()
        assert sorted((r.id, r.item_id, r.coverage) for r in hits) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert tiling._words(["e\u0301te\u0301 caf\u00e9".encode()]).first.tolist() == [0, 2]


def test_quality_without_ratings(spark):
    frame = spark.createDataFrame([(1, "a")], DOCS)
    model = quality.learn(frame, spark.createDataFrame([], "doc_id long, grade long"))
    assert [(r.expected_grade, r.kept) for r in quality.grade_documents(frame, model, 2).collect()] == [(0.0, False)]


def test_quality_gradient():
    """The fit lowers the likelihood's loss on separable grades."""
    n = 300
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, n)
    start = np.arange(n + 1) * 3
    bucket = np.stack([grade * 10 + rng.integers(0, 2, n), 100 + rng.integers(0, 5, n), 200 + grade], axis=1).ravel()
    order = np.argsort(bucket.reshape(n, 3), axis=1)
    bucket = np.take_along_axis(bucket.reshape(n, 3), order, axis=1).ravel()
    model = quality.train(grade, start, bucket, np.ones(3 * n, int), np.zeros((n, quality.MEASURES)), 2)
    value = np.log1p(1) * model.idf[bucket.reshape(n, 3)]
    s = (value / np.sqrt((value**2).sum(axis=1, keepdims=True)) * model.weights[bucket.reshape(n, 3)]).sum(axis=1)
    assert np.mean((s[:, None] > model.thresholds[None, :]).sum(axis=1) == grade) > 0.97


@pytest.fixture(scope="module")
def bpe():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@pytest.mark.parametrize("max_bits", [1 << 28, 1])
def test_tokens(spark, bpe, max_bits):
    rnd = random.Random(6)
    letters = " \t\n\r'sSdLrE09²½ªº÷×éßǅ.,!\u00ad \u0085 中😀\x1c_<|endoftext|>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(300)]
    texts += ["a<|endoftext|>b", "", "x" * 20_000, "same", "same", "Some  words, aren't they?\n\n" * 500]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (3, "again 3"), (None, "no id"), (None, "other")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", digest string, n_tokens int")
    own = tokenizers.Tokenizer.from_str(bpe.decode())
    cache = f"{stage_root(spark)}/tokens-{uuid.uuid4().hex}"
    out = count_tokens(frame, bpe, cache, max_bits=max_bits).collect()
    want = sorted(
        (i is None, i or 0, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows
    )
    assert sorted((r.id is None, r.id or 0, r.n_bytes, r.n_tokens) for r in out) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    # a second run adds only what is new
    more = frame.unionByName(frame.limit(1).selectExpr("7777 as doc_id", "'brand new' as text", "digest", "n_tokens"))
    assert count_tokens(more, bpe, cache).where("id = 7777").first().n_tokens == len(own.encode("brand new").ids)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1


def test_other_tokenizers_are_encoded_whole(spark):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        definition = f.read()
    own = tokenizers.Tokenizer.from_str(definition.decode())
    own.no_truncation()
    own.no_padding()
    texts = ["Hello World", "  a  b", "", "<|endoftext|>"]
    out = count_tokens(spark.createDataFrame(list(enumerate(texts)), DOCS), definition, f"{stage_root(spark)}/tokens-{uuid.uuid4().hex}")
    assert {r.id: r.n_tokens for r in out.collect()} == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def water(sizes, weights, share, most):
    """Brute force: share the budget by weight, reshare what is over a limit."""
    target, budget, free = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while free and budget > 1e-9:
        total = sum(weights[s] for s in free)
        level = budget / total
        full = {s for s in free if weights[s] * level >= most * sizes[s] - 1e-9}
        if not full:
            for s in free:
                target[s] = weights[s] * level
            break
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
        free -= full
    return target


def test_mix(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(1500):
        source = rnd.choices(["b", "a", "Z", "é", None, ""], [60, 10, 5, 2, 8, 1])[0]
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 7, 7, 7, rnd.randrange(300)])), source))
    rows += [(2000, None, "b"), (2001, "x " * 50_000, "a")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", source string, size int")
    out = {r.id: r for r in mixing.mix(frame, [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    assert len(out) == len(rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: [3.0, 1.0, 2.0][i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    want = water(sizes, weights, 1.5, 2.0)
    for i, text, source in rows:
        r = out[i]
        assert r.size == len((text or "").split()) and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
    for s in names:
        near = sum(out[i].taken for i, _, x in rows if x == s)
        assert abs(near - want[s]) <= max(1, 0.001 * want[s]) or s == "a"  # one document holds most of a
    again = {r.id: r.taken for r in mixing.mix(frame.repartition(7), [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    assert again == {i: r.taken for i, r in out.items()}
    assert mixing.mix(frame.limit(0), [1.0]).count() == 0


def test_fit_is_a_subset_sum():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.choice(np.arange(1, 60), rng.integers(1, 9), replace=False)
        counts = rng.integers(1, 5, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 3))
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((sizes * take).sum()) <= budget
    # the dynamic program finds 5 + 7 + 7 = 19 where greedy ends at 17
    assert int((np.array([9, 7, 5]) * mixing.fit(np.array([9, 7, 5]), np.array([1, 2, 1]), 19)).sum()) == 19


def nearest(sizes, counts, budget):
    sums = {0}
    for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
        sums = {x + k * size for x in sums for k in range(n + 1) if x + k * size <= budget}
    return max(sums)


def test_fit_is_as_near_as_any_choice():
    cases = [([90_000, 70_000, 1_000], [1, 2, 3], 140_000), ([120_000, 70_000], [1, 3], 210_000), ([9, 7], [1, 2], 14)]
    cases += [([99_999, 100_000], [400, 300], 50_000_123), ([100_000, 100_003], [3, 3], 350_000)]
    rng = np.random.default_rng(5)
    for most, kinds, copies in ((60, 8, 5), (2_000, 5, 4), (300_000, 7, 4), (300_000, 12, 2)):
        for _ in range(40):
            sizes = rng.choice(np.arange(1, most), rng.integers(1, kinds + 1), replace=False)
            counts = rng.integers(1, copies, len(sizes))
            cases.append((sizes, counts, int(rng.integers(0, int((sizes * counts).sum()) + 3))))
    for sizes, counts, budget in cases:
        sizes, counts = np.array(sizes), np.array(counts)
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((sizes * take).sum()) == nearest(sizes, counts, budget)


def test_mix_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    frame = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(300)], DOCS + ", source string")
    out = mixing.mix(frame, [1.0, 3.0], 1.1, 2.0).collect()
    for s in (200, 100):
        rows = [r for r in out if r.source_size == 3 * s]
        assert len(rows) == s and abs(sum(r.taken for r in rows) - rows[0].target) < 3


def test_reply_trees(spark):
    nodes = [
        ("t", 1, None, "user", "hi </s>", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b [INST]", 5.0),
        ("t", 4, 2, "user", "c", 9.0), ("t", 5, 4, "assistant", "<\\s>", 0.0), ("t", 6, 3, "user", None, None),
        ("u", 1, 99, None, "root of an unknown parent", 0.0), ("v", 1, 2, "user", "cycle", 0.0), ("v", 2, 1, "user", "cycle", 0.0),
        ("v", 3, 1, "user", "on a cycle", 0.0), ("w", 1, None, "user", "x", 0.0), ("w", 2, 1, "user", "tie", 1.0), ("w", 3, 1, "user", "tie", 1.0),
    ]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    every = frame.transform(chat.format_paths).select("tree", "leaf", "rank", "path_score", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"))
    got = {(r.tree, r.leaf): r for r in every.collect()}
    assert {(k, r.rank, r.path_score) for k, r in got.items()} == {
        (("t", 5), 1, 10.0), (("t", 6), 2, 5.0), (("u", 1), 1, 0.0), (("w", 2), 1, 1.0), (("w", 3), 2, 1.0)
    }
    assert [(x.role, x.text) for x in got["t", 5].turns] == [("user", "hi </s>"), ("assistant", "a"), ("user", "c"), ("assistant", "<\\s>")]
    assert got["t", 5].loss == [False, True, False, True]
    assert [(x.role, x.text) for x in got["t", 6].turns] == [("user", "hi </s>"), ("assistant", "b [INST]"), ("user", "")]
    assert chat.format_paths(frame, 1).count() == 3
    assert chat.format_paths(frame.limit(0)).count() == 0


def test_escape_round_trip(spark):
    rnd = random.Random(9)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "<s>", "x", "é", "\n"]
    rows = [(str(i), 1, None, rnd.choice(["user", "a[INST]", "</s>"]), "".join(rnd.choice(bits) for _ in range(12)), 0.0) for i in range(400)]
    rows.append(("deep", 1, None, "user", "start", 0.0))
    rows += [("deep", i, i - 1, "assistant", f"turn {i}", 0.0) for i in range(2, 300)]
    frame = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_paths(frame).select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"))
    got = {r.tree: r for r in out.collect()}
    for tree, _, _, role, text, _ in rows[:400]:
        assert [(t.role, t.text) for t in got[tree].turns] == [(role, text)]
        assert got[tree].formatted.count("[INST]") == 1 and got[tree].formatted.count("</s>") == 1
    assert [t.text for t in got["deep"].turns] == ["start", *[f"turn {i}" for i in range(2, 300)]]


def test_chat_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "ü</s>"), (2, 5, None, "x"), (2, 5, "assistant", "same turn"), (None, 0, "assistant", "no id")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op7(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None, -7}
    assert got[1].loss_sha256 == hashlib.sha256("ü</s>".encode()).hexdigest() and got[1].loss_chars == 5
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\nassistant\nsame turn\n").hexdigest()
    ok = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
    assert got[-7].loss_chars == len(ok)


def tiles_brute(doc, item, least):
    """Greedy string tiling by definition: again and again all longest matches of unmarked words."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best, found = least, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_i:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not (used_d & set(range(i, i + best)) or used_i & set(range(j, j + best))):
                used_d |= set(range(i, i + best))
                used_i |= set(range(j, j + best))
                tiles.append((i, j, best))


def test_tiles():
    rng = np.random.default_rng(1)
    for _ in range(150):
        item = rng.integers(0, 6, rng.integers(5, 30)).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 6, rng.integers(0, 20)), *[item[a : a + 8] for a in rng.integers(0, len(item), 3)]]).astype(np.uint64)
        grams = {tuple(item[j : j + 5]) for j in range(len(item) - 4)}
        starts = np.array([i for i in range(len(doc) - 4) if tuple(doc[i : i + 5]) in grams], int)
        got, want = tiling.tile(doc, starts, item, 5), tiles_brute(doc.tolist(), item.tolist(), 5)
        assert sorted(n for _, _, n in got)[::-1][:1] == sorted(n for _, _, n in want)[::-1][:1]
        for i, j, n in got:
            assert (doc[i : i + n] == item[j : j + n]).all()
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)
        assert len({x for _, j, n in got for x in range(j, j + n)}) == sum(n for *_, n in got)


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_contaminated(spark, max_bytes):
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.randrange(2000)}" for _ in range(n)]
    items = {i: words(rnd.randrange(15, 50)) for i in range(30)} | {50: ["only", "three", "words"], 51: [], 52: words(20)}
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(53, None), (54, " ".join(items[0]))]
    rows, want = [], set()
    for d in range(60):
        text, item = words(rnd.randrange(10, 200)), rnd.randrange(30)
        kind = d % 5
        own = items[item]
        if kind == 0:  # whole, in capitals and with signs
            text[5:5] = [w.upper() + "!!" for w in own]
        elif kind == 1:  # halves changed round, apart
            half = len(own) // 2
            text = own[half:] + text + own[:half]
        elif kind == 2:  # too little of it
            text[3:3] = own[: len(own) // 2]
        if kind < 2:
            want |= {(d, item)} | ({(d, 54)} if item == 0 else set())
        rows.append((d, " ".join(text)))
    rows += [(100, "here are Only, three   WORDS!"), (101, None), (102, ""), (103, "only three"), (104, " ".join(items[52] * 3000))]
    want |= {(100, 50), (104, 52)}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", tag int, item_id int")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    hits = tiling.contaminated(docs, benchmark, max_bytes=max_bytes).collect()
    assert {(r.id, r.item_id) for r in hits} == want and len(hits) == len(want)
    assert all(0.8 <= r.coverage <= 1 for r in hits)
    if max_bytes:
        kept = tiling.drop_contaminated(docs, benchmark)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert tiling.contaminated(docs.limit(0), benchmark, max_bytes=max_bytes).count() == 0
    assert tiling.contaminated(docs, benchmark.limit(0), max_bytes=max_bytes).count() == 0


def judge_brute(url, rules):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0] if m else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_urls(spark):
    rnd = random.Random(12)
    hosts = ["example.org", "A.Example.ORG", "example.org:80", "x.com", "com", "notorg", "é.org", ".org", "", "www.spam.net"]
    made = [f"{rnd.choice(['http', 'x'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/es/', '/en/1', '/en/12?x', '/fr/a#b', '/de/', '?/es/', '/ES/'])}" for _ in range(200)]
    made += [None, "", "no scheme/es/", "a://b://c/d", "://org/", "http://org/\n/es/", "http://www.spam.net/p/?utm_a=1&b=2#f", "https://spam.net/p?b=2"]
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(made)], "page_id long, url string, host string, curl int")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("spam.net/p?b=2",), ("spam.net/p?b=2",), ("",)], "curl string")
    out = {r.id: r for r in urls.judge(frame, rules, listed, "page_id", "url").collect()}
    for i, u in enumerate(made):
        host, path, rule, verdict = judge_brute(u, queries.URL_RULES)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        block = u in (made[-1], made[-2])
        assert out[i].listed == block and out[i].verdict == (verdict or ("block" if block else "allow"))
    none = listed.limit(0)
    assert urls.judge(frame, rules.limit(0), none, "page_id", "url").where("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.judge(frame.limit(0), rules, listed, "page_id", "url").count() == 0


def test_bloom_filter_misses_nothing(spark):
    every = spark.range(4000).selectExpr("concat('h', id, '.org/p') as curl")
    listed = spark.range(0, 4000, 5).selectExpr("concat('h', id, '.org/p') as curl")
    for blocks in (1, 1 << 17):  # one block: everything passes to the join, which is exact
        assert urls.listed_urls(every, listed, blocks).count() == 800
    assert urls.bloom_blocks(listed, 64).count() <= 64
