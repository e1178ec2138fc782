"""Toxicity scores learned from confirmed toxic examples and unlabelled text.

No document is ever taken as clean. With the share of toxic documents ``prior``, the risk of a classifier ``g`` is
``prior * E_toxic[l(g)] + max(0, E_any[l(-g)] - prior * E_toxic[l(-g)])``: the second part is the risk on clean text,
got from unlabelled text by taking away what its toxic part adds. When that part falls below zero, the step goes the
other way (non-negative risk estimator). ``MEMBERS`` linear classifiers are fitted like this by Adam in numpy on
different halves of the unlabelled sample; the score is the mean of their sigmoids.

Features are hashed words and word beginnings, present or not. Those are kept whose share among toxic examples
differs from that in unlabelled text by ``LEAST_Z`` standard errors or more.

The samples are bounded: about ``TOXIC_DOCS`` toxic and ``ANY_DOCS`` unlabelled documents with different texts. Toxic ids
are drawn by a seeded hash first, then rows by one of their text, so neither repeated rows nor repeated ids can swell
them; their buckets (at most ``BUCKETS`` a document), not their texts, go to the driver. The prior is the share of toxic documents among all labelled
ones that may be learned from, counted over all rows, or given. Scoring is one scan over whole texts with a table of
fixed size; nothing is shuffled.

Defined cases: null text is empty; a text without features has the score of the bias. A document labelled several
times is toxic if one label says so. Null labels and labels of unknown documents teach nothing. Without toxic
examples every score is 0. A long text is cut at gaps and looked at piece by piece. Rows with equal ids are scored
each for itself. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, shared, utf8
from .words import Words, batches

BUCKETS = 1 << 18
#: Toxic and unlabelled documents that are learned from, about (bounds of the samples).
TOXIC_DOCS, ANY_DOCS = 4_000, 12_000
#: Kept features: documents of the samples they occur in, and standard errors between the shares.
LEAST_SEEN, LEAST_Z = 5, 6.0
MEMBERS, STEPS, RATE, DECAY, SEED = 3, 300, 0.1, 1e-4, 23
#: Bytes that are looked at once; a longer text is cut into pieces of about this size.
TEXT_BYTES = 1 << 20
#: Lengths, in bytes, of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_GAP = np.arange(256) == 32

_SAMPLE = pa.schema([("toxic", pa.bool_()), ("any", pa.bool_()), ("tag", pa.int64()), ("bucket", pa.list_(pa.int32()))])
_SCORED = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts, cut at gaps where they are long, in batches with the number of the text each piece is from."""

    def cut() -> Iterator[tuple[int, bytes]]:
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > TEXT_BYTES:
                end = text.find(b" ", at + TEXT_BYTES)
                end = len(text) if end < 0 else end
                yield i, text[at:end]
                at = end
            yield i, text[at:]

    yield from batches(cut(), TEXT_BYTES)


def features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each feature present, once per text; only those ``wanted`` (a mask over the buckets)."""
    found = [np.zeros(0, np.int64)]
    for numbers, some in pieces(texts):
        words = Words(some, _GAP, _FOLD)
        owner = np.repeat(np.array(numbers), np.diff(words.first))
        every = [(owner, words.hashes())]
        for n in BEGINNINGS:
            which, h = words.prefixes(n)
            every.append((owner[which], h))
        for own, h in every:
            bucket = (h >> np.uint64(46)).astype(np.int64)
            if wanted is not None:
                use = wanted[bucket]
                own, bucket = own[use], bucket[use]
            found.append(np.unique(own * BUCKETS + bucket))
    pair = np.unique(np.concatenate(found))
    return pair // BUCKETS, pair % BUCKETS


@dataclass
class Model:
    wanted: np.ndarray  # mask over the buckets
    weights: np.ndarray  # bucket by member
    bias: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.bias):
            return np.zeros(len(texts))
        doc, bucket = features(texts, self.wanted)
        sums = [np.bincount(doc, self.weights[bucket, k], len(texts)) + b for k, b in enumerate(self.bias)]
        return np.mean([_sigmoid(s) for s in sums], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_step(g_toxic: np.ndarray, g_any: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the non-negative risk (logistic loss) by the scores of toxic and of unlabelled documents."""
    n, m = max(len(g_toxic), 1), max(len(g_any), 1)
    loss_any = np.logaddexp(0, g_any).mean()  # l(-g) on unlabelled text
    loss_toxic = np.logaddexp(0, g_toxic).mean()  # l(-g) on toxic examples
    d_toxic_as_clean, d_any_as_clean = prior * _sigmoid(g_toxic) / n, _sigmoid(g_any) / m
    if loss_any - prior * loss_toxic < 0:
        return d_toxic_as_clean, -d_any_as_clean
    return prior * (_sigmoid(g_toxic) - 1) / n - d_toxic_as_clean, d_any_as_clean


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit on the buckets of each toxic and each unlabelled document."""
    if not toxic or not unlabelled:
        return Model(np.zeros(BUCKETS, bool), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    in_toxic, in_any = (np.bincount(np.concatenate(x), minlength=BUCKETS) for x in (toxic, unlabelled))
    seen = in_toxic + in_any
    share = seen / (len(toxic) + len(unlabelled))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / len(toxic) + 1 / len(unlabelled)))
    z = (in_toxic / len(toxic) - in_any / len(unlabelled)) / error
    wanted = (seen >= LEAST_SEEN) & (np.abs(z) >= LEAST_Z)
    number = np.cumsum(wanted) - 1
    p_rows, u_rows = ([number[b[wanted[b]]] for b in x] for x in (toxic, unlabelled))
    weights, bias = np.zeros((BUCKETS, MEMBERS), np.float32), np.zeros(MEMBERS)
    for k in range(MEMBERS):
        half = np.random.default_rng(SEED + k).permutation(len(u_rows))[: max(1, (len(u_rows) + 1) // 2)]
        w, bias[k] = _fit(p_rows, [u_rows[i] for i in half], prior, int(wanted.sum()))
        weights[wanted, k] = w
    return Model(wanted, weights, bias)


def _fit(p_rows: list[np.ndarray], u_rows: list[np.ndarray], prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier; the last parameter is the bias. Each step sees the whole sample."""
    params = np.zeros(size + 1)
    params[size] = np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    rows, n = p_rows + u_rows, len(p_rows)
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    for t in range(1, STEPS + 1):
        g = np.bincount(owner, params[flat], len(rows)) + params[size]
        slope = np.concatenate(risk_step(g[:n], g[n:], prior))
        grad = np.bincount(flat, slope[owner], size + 1) + DECAY * params
        grad[size] = slope.sum()
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        rate = RATE * (1 - 0.9 * t / STEPS)
        params -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return params[:size], float(params[size])


def held_out(id_: Column) -> Column:
    """Whether a document's label is never learned from: its id's CRC-32 divides by 5."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(5)) == 0


def learn(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on the toxic ones of ``labels(id, label)`` and on documents whatever their labels; neither from held-out rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where("id is not null and y is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    n = known.agg(F.count("*").alias("all"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("toxic")).first()
    if not n["toxic"]:
        return train([], [], 0.0)
    prior = min(max(n["toxic"] / n["all"] if prior is None else prior, 1e-3), 0.9)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(~held_out(F.col("id")))
    scale = 1 << 30
    cut = [int(scale * min(1.0, most / max(of, 1))) for most, of in ((TOXIC_DOCS, n["toxic"]), (ANY_DOCS, rows.count()))]
    some = known.where("y = 1").where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(scale)) < cut[0])
    some = F.broadcast(some.select("id", F.lit(True).alias("hit")))  # about TOXIC_DOCS rows of 9 bytes at most
    hits = rows.join(some, "id", "left_semi").count()
    tag = F.xxhash64(F.lit(SEED), "text")
    draw = F.pmod(tag, F.lit(scale))
    toxic = F.col("hit").isNotNull() & (draw < int(scale * min(1.0, TOXIC_DOCS / max(hits, 1))))
    flagged = rows.where("text is not null").join(some, "id", "left")
    drawn = flagged.select(toxic.alias("toxic"), (draw < cut[1]).alias("any"), tag.alias("tag"), "text").where("toxic or any")
    drawn = drawn.dropDuplicates(["tag", "toxic"])  # copies teach once

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (
            (x[:3], x[3]) for p in parts for x in zip(*(p.column(i).to_pylist() for i in range(3)), utf8(p.column(3)), strict=True)
        )
        for heads, texts in batches(stream, TEXT_BYTES):
            doc, bucket = features(texts)
            cut = np.searchsorted(doc, np.arange(1, len(texts)))
            yield batch_of(
                _SAMPLE, toxic=[h[0] for h in heads], any=[h[1] for h in heads], tag=[h[2] for h in heads],
                bucket=np.split(bucket.astype(np.int32), cut),
            )

    got = drawn.mapInArrow(run, "toxic boolean, any boolean, tag long, bucket array<int>").toArrow()
    cols = [got.column(i).to_pylist() for i in range(3)]
    flat = got.column(3).combine_chunks()
    start = flat.offsets.to_numpy() if len(flat) else np.zeros(1, int)
    values = flat.values.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int32)
    one, other = {}, {}
    for i in range(len(got)):  # by tag: in the same order whatever order the tasks ended in
        own = values[start[i] : start[i + 1]]
        if cols[0][i]:
            one[cols[2][i]] = own
        if cols[1][i]:
            other[cols[2][i]] = own
    return train([one[k] for k in sorted(one)], [other[k] for k in sorted(other)], prior)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: how likely each document is toxic."""
    sent = shared(docs.sparkSession, (model.wanted, model.weights, model.bias))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        stream = (x for p in parts for x in zip(p.column(0).to_pylist(), utf8(p.column(1)), strict=True))
        for ids, texts in batches(stream, TEXT_BYTES):
            yield batch_of(_SCORED, id=ids, score=own.score(texts))

    return rows.mapInArrow(run, "id long, score double")
