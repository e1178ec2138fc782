"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed words and word beginnings (and a few measures of the whole text) gives a score ``s``; ordered
thresholds turn it into ``P(grade <= k) = sigmoid(threshold_k - s)``. All grades share the weights, so a rated
document teaches every step of the scale. The expected grade and the tail probability of reaching a grade are
what documents are selected by. Grades are any whole numbers from 0, ``MOST_GRADES`` different ones at most; they are
ranked for the fit, and expected grades are on their own scale.

The model is fitted by Adam in numpy on about ``RATED_DOCS`` rated documents, drawn by a seeded hash (the bound
of the sample; their hashed counts, not their texts, go to the driver). The rest is one scan over whole texts
with a weight table of fixed size; nothing is shuffled.

Defined cases: null text is empty and scored like any other text. A document rated several times has its lowest
grade. Null ratings and ratings of unknown documents teach nothing; without ratings every document has expected
grade 0 and is not kept, and with one grade alone every document has that grade. Rows with equal ids are scored each
for itself, texts of any length whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, shared, utf8
from .words import Words, batches

BUCKETS = 1 << 18
#: Rated documents that are learned from, at most about (bound of the training sample).
RATED_DOCS = 6_000
#: Different grades that a scale may have.
MOST_GRADES = 50
EPOCHS, RATE, DECAY, SEED = 25, 0.1, 1e-5, 11
TEXT_BYTES = 1 << 20
MEASURES = 6
#: Rated documents a feature must occur in; rarer ones can't be weighed and would only add to the norm.
LEAST_SEEN = 5
#: Lengths, in bytes, of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_GAP = np.arange(256) == 32
_KIND = np.zeros(256, np.int64)  # 1 sign, 2 digit, 3 capital
for _c in range(33, 128):
    _KIND[_c] = 2 if chr(_c).isdigit() else 3 if chr(_c).isupper() else 0 if chr(_c).isalpha() else 1

_SAMPLE = pa.schema(
    [("grade", pa.int64()), ("bucket", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())), ("measure", pa.list_(pa.float64()))]
)
_SCORED = pa.schema([("id", pa.int64()), ("expected_grade", pa.float64()), ("tail_prob", pa.float64())])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of each distinct word or beginning, and the measures of each text."""
    words = Words(texts, _GAP, _FOLD)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    whole = owner * BUCKETS + (words.hashes() >> np.uint64(46)).astype(np.int64)
    every = [whole]
    for n in BEGINNINGS:
        which, h = words.prefixes(n)
        every.append(owner[which] * BUCKETS + (h >> np.uint64(46)).astype(np.int64))
    pair, count = np.unique(np.concatenate(every), return_counts=True)
    size = np.array([len(t) for t in texts])
    kind = _KIND[np.frombuffer(words.raw, np.uint8)]
    at = np.concatenate(([0], np.cumsum(size + 1)))
    shares = []
    for k in (1, 2, 3):
        sums = np.concatenate(([0], np.cumsum(kind == k)))
        shares.append((sums[at[1:] - 1] - sums[at[:-1]]) / np.maximum(size, 1))
    n = np.diff(words.first)
    distinct = np.bincount(np.unique(whole) // BUCKETS, minlength=len(texts))
    measures = np.stack([*shares, distinct / np.maximum(n, 1), np.log1p(n), size / np.maximum(n, 1)], axis=1)
    return pair // BUCKETS, pair % BUCKETS, count, measures


@dataclass
class Model:
    weights: np.ndarray  # float32 per bucket, inverse document frequency included in ``idf``
    idf: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    thresholds: np.ndarray
    levels: np.ndarray  # the grades in order

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, bucket, count, measures = features(texts)
        value = np.log1p(count) * self.idf[bucket]
        norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
        sums = np.bincount(doc, value * self.weights[bucket], len(texts))
        z = np.clip((measures - self.mean) / self.spread, -5, 5)
        return sums / np.maximum(norm, 1e-9) + z @ self.dense

    def grades(self, texts: list[bytes], tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of grade ``tail`` or more."""
        if not len(self.thresholds):
            only = self.levels[0] if len(self.levels) else 0
            return np.full(len(texts), float(only)), np.full(len(texts), float(len(self.levels) > 0 and only >= tail))
        over = _sigmoid(self.score(texts)[:, None] - self.thresholds[None, :])
        at = min(max(int(np.searchsorted(self.levels, tail)), 1), over.shape[1]) - 1
        return self.levels[0] + over @ np.diff(self.levels), over[:, at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(
    grade: np.ndarray, start: np.ndarray, bucket: np.ndarray, count: np.ndarray, measures: np.ndarray, top: int, levels=None
) -> Model:
    """Fit on rows ``bucket[start[i]:start[i + 1]]``; grades are ranks 0 … ``top`` of ``levels``."""
    n = len(grade)
    zero = np.zeros(MEASURES)
    levels = np.arange(top + 1) if levels is None else np.asarray(levels)
    if not n or top < 1:
        return Model(np.zeros(BUCKETS, np.float32), np.ones(BUCKETS, np.float32), zero, zero, zero + 1, np.zeros(0), levels if n else np.zeros(0))
    seen = np.bincount(bucket, minlength=BUCKETS)
    idf = np.where(seen < LEAST_SEEN, 0, np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    value = (np.log1p(count) * idf[bucket]).astype(np.float32)
    row = np.repeat(np.arange(n), np.diff(start))
    value /= np.maximum(np.sqrt(np.bincount(row, value * value, n)), 1e-9)[row]
    mean, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-6
    z = np.clip((measures - mean) / spread, -5, 5)

    # parameters: words, measures, first threshold, logarithms of the steps between thresholds
    part = np.cumsum(np.bincount(grade, minlength=top + 1))[:-1] / n
    cut = np.log(np.clip(part, 0.01, 0.99) / (1 - np.clip(part, 0.01, 0.99)))
    w, dense = np.zeros(BUCKETS), np.zeros(MEASURES)
    low, gaps = np.array([cut[0]]), np.log(np.maximum(np.diff(cut), 0.1))
    params = [w, dense, low, gaps]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, t, size = np.random.default_rng(SEED), 0, 64
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, size):
            t += 1
            own = order[lo : lo + size]
            at = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
            who = np.repeat(np.arange(len(own)), start[own + 1] - start[own])
            s = np.bincount(who, value[at] * w[bucket[at]], len(own)) + z[own] @ dense
            theta = low[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            cdf = np.concatenate((np.zeros((len(own), 1)), _sigmoid(theta[None, :] - s[:, None]), np.ones((len(own), 1))), axis=1)
            slope = cdf * (1 - cdf)
            g, i = grade[own], np.arange(len(own))
            p = np.maximum(cdf[i, g + 1] - cdf[i, g], 1e-9)
            ds = (slope[i, g + 1] - slope[i, g]) / p / len(own)  # d loss / d s
            dtheta = np.zeros(top)
            for k in range(top):
                up, down = g == k, g == k + 1
                dtheta[k] = (-(slope[up, k + 1] / p[up]).sum() + (slope[down, k + 1] / p[down]).sum()) / len(own)
            tailsum = np.cumsum(dtheta[::-1])[::-1]
            grads = [None, ds @ z[own], np.array([tailsum[0]]), tailsum[1:] * np.exp(gaps)]
            buckets, back = np.unique(bucket[at], return_inverse=True)
            gw = np.bincount(back, value[at] * ds[who]) + DECAY * w[buckets]
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
            first[0][buckets] = 0.9 * first[0][buckets] + 0.1 * gw
            second[0][buckets] = 0.999 * second[0][buckets] + 0.001 * gw * gw
            w[buckets] -= 5 * rate * (first[0][buckets] / fix1) / (np.sqrt(second[0][buckets] / fix2) + 1e-6)
            for j in (1, 2, 3):
                first[j] = 0.9 * first[j] + 0.1 * grads[j]
                second[j] = 0.999 * second[j] + 0.001 * grads[j] ** 2
                params[j] -= rate * (first[j] / fix1) / (np.sqrt(second[j] / fix2) + 1e-8)
    theta = low[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return Model(w.astype(np.float32), idf, dense, mean, spread, theta, levels)


def learn(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
) -> Model:
    """Fit on ``ratings(id, grade)`` of the documents; more than ``MOST_GRADES`` different grades raise ``ValueError``."""
    rated = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("long").alias("grade"))
    rated = rated.where("id is not null and grade >= 0").groupBy("id").agg(F.min("grade").alias("grade"))
    levels = sorted(r["grade"] for r in rated.select("grade").distinct().limit(MOST_GRADES + 1).collect())
    if len(levels) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} different grades: no graded scale")
    known = rated.agg(F.count("*").alias("n")).first()
    rank = F.array_position(F.array(*[F.lit(x).cast("long") for x in levels] or [F.lit(0).cast("long")]), F.col("grade")) - 1
    rated = rated.withColumn("grade", rank)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, RATED_DOCS / max(known["n"], 1)))
    sample = F.broadcast(rated.where(drawn))  # about RATED_DOCS rows of 16 bytes at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(sample, "id").select("grade", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (x for p in parts for x in zip(p.column(0).to_pylist(), utf8(p.column(1)), strict=True))
        for grades, texts in batches(stream, TEXT_BYTES):
            doc, bucket, count, measures = features(texts)
            cut = np.searchsorted(doc, np.arange(1, len(texts)))
            yield batch_of(
                _SAMPLE, grade=grades, bucket=np.split(bucket.astype(np.int32), cut), count=np.split(count.astype(np.int32), cut),
                measure=list(measures),
            )

    got = rows.mapInArrow(run, "grade long, bucket array<int>, count array<int>, measure array<double>").toArrow()
    if not len(got):
        return train(np.zeros(0, int), np.zeros(1, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, MEASURES)), 0)
    cols = [got.column(i).combine_chunks() for i in range(4)]
    start, flat = cols[1].offsets.to_numpy(), cols[1].values.to_numpy(zero_copy_only=False)
    grade, size = cols[0].to_numpy(zero_copy_only=False), np.diff(start)
    counts, measures = cols[2].values.to_numpy(zero_copy_only=False), cols[3].values.to_numpy(zero_copy_only=False).reshape(-1, MEASURES)
    # a fixed order, whatever order the tasks ended in
    total = np.array([flat[a:b].astype(np.int64).sum() for a, b in zip(start[:-1], start[1:], strict=True)])
    order = np.lexsort((*measures.T, total, size, grade))
    at = np.concatenate([np.arange(start[i], start[i + 1]) for i in order])
    begin = np.concatenate(([0], np.cumsum(size[order])))
    return train(grade[order], begin, flat[at].astype(np.int64), counts[at], measures[order], len(levels) - 1, levels)


def grade_documents(
    docs: DataFrame, model: Model, tail: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, expected_grade, tail_prob, kept``: kept if grade ``tail`` is reached with probability ``least``."""
    sent = shared(docs.sparkSession, (model.weights, model.idf, model.dense, model.mean, model.spread, model.thresholds, model.levels))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        stream = (x for p in parts for x in zip(p.column(0).to_pylist(), utf8(p.column(1)), strict=True))
        for ids, texts in batches(stream, TEXT_BYTES):
            expected, reached = own.grades(texts, tail)
            yield batch_of(_SCORED, id=ids, expected_grade=expected, tail_prob=reached)

    scored = rows.mapInArrow(run, "id long, expected_grade double, tail_prob double")
    return scored.withColumn("kept", F.col("tail_prob") >= least)
