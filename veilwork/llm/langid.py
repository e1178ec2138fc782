"""Language identification with averaged hashed subword embeddings.

A text is folded to lower-case words; the subwords are the byte 3-grams and 4-grams of its words with their
borders, hashed to ``BUCKETS`` embeddings. The mean embedding of all subwords goes through a linear softmax.
Embeddings and softmax are trained together by stochastic gradient descent in numpy, on about
``PER_LANGUAGE`` documents of each language (drawn by a seeded hash of id and text, equal texts once; this is the bound
of the sample). A fifth of the sample is set aside: it gives the temperature of the scores and the rejection threshold.
Scores are calibrated by isotonic regression of right and wrong predictions, which pools neighbouring scores, so that
single wrong labels move nothing; rejected are the scores at which a prediction is right in fewer than ``ACCEPT`` of
the cases, and those under one half.

Mean and softmax are linear up to the end, so a model is one small table of logits per bucket and language;
that is what executors get. Whole texts are predicted where they are read, nothing is shuffled.

Defined cases: texts of any length are predicted whole; null text and texts without a letter give ``und`` with score 0, rejected. Without any labelled
document all texts are ``und``. A null language never teaches. Rows with equal ids are judged each for
itself. Other columns are ignored by ``identify`` and pass through ``drop_rejected`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import batch_of, shared, utf8, without
from .words import batches

BUCKETS, DIM = 1 << 15, 8
#: Documents of each language that are learned from, about (bound of the training sample).
PER_LANGUAGE = 700
#: Share of right predictions below which a score is rejected.
ACCEPT = 0.5
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Bytes of text that are predicted at once.
TEXT_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c

_SAMPLE = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("bucket", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])
_PREDICTED = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and for each text the place of its first (one more at the end)."""
    b = _FOLD[np.frombuffer(b" " + b"\n".join(texts) + b"    ", np.uint8)].astype(np.uint32)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])  # place of the gap before each text
    gap = b == 32
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    inside = ~gap[1:-1]
    use3, use4 = np.flatnonzero(inside), np.flatnonzero(inside[:-1] & inside[1:])
    h3 = three[use3] * np.uint32(0x9E3779B1)
    h4 = (four[use4] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)
    h4 ^= h4 >> np.uint32(13)
    place = np.concatenate((use3, use4))
    bucket = np.concatenate((h3 >> np.uint32(17), (h4 * np.uint32(0xC2B2AE35)) >> np.uint32(17)))
    order = np.argsort(np.searchsorted(at, place, side="right"), kind="stable")
    first = np.searchsorted(use3, at) + np.searchsorted(use4, at)
    return bucket[order].astype(np.int32), first


def has_letter(text: bytes) -> bool:
    folded = _FOLD[np.frombuffer(text, np.uint8)]
    if ((folded < 128) & (folded != 32)).any():
        return True
    return any(c.isalpha() for c in text.decode()) if (folded >= 128).any() else False


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # float32, bucket by language
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections of whole texts."""
        known = np.array([has_letter(t) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        bucket, first = subwords(texts)
        count = np.maximum(np.diff(first), 1)
        z = np.empty((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            sums = np.concatenate(([0.0], np.cumsum(self.logits[bucket, j], dtype=np.float64)))
            z[:, j] = (sums[first[1:]] - sums[first[:-1]]) / count + self.bias[j]
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        lang = [self.languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
        return lang, score, ~known | (score < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> Model:
    """Model of ``(language, part, buckets, shares)`` rows; part 0 of 5 calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(SEED)
    number = {x: i for i, x in enumerate(languages)}
    fit = [r for r in rows if r[1]] or rows
    held = [r for r in rows if not r[1]] or rows
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (len(languages), DIM)).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = EPOCHS * len(fit)
    for epoch in range(EPOCHS):
        for k, i in enumerate(rng.permutation(len(fit))):
            lang, _, bucket, share = fit[i]
            rate = RATE * (1 - (epoch * len(fit) + k) / steps)
            own = emb[bucket]
            mean = share @ own
            g = _softmax(out @ mean + bias)
            g[number[lang]] -= 1
            back = g @ out
            out -= rate * np.outer(g, mean)
            bias -= 0.1 * rate * g
            # a subword's step grows with its share; the factor makes up for the mean over many of them
            emb[bucket] = own - (rate * 20) * np.outer(share, back)
    logits = emb @ out.T
    z = np.array([share @ logits[bucket] + bias for _, _, bucket, share in held])
    truth = np.array([number[r[0]] for r in held])
    at = np.arange(len(held))
    heat = np.geomspace(0.25, 20, 61)
    loss = [-np.log(np.maximum(_softmax(z / t)[at, truth], 1e-12)).mean() for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    return Model(languages, logits.astype(np.float32), bias, temperature, max(0.5, threshold(score, wrong)))


def threshold(score: np.ndarray, wrong: np.ndarray, accept: float = ACCEPT) -> float:
    """Smallest score that is right often enough, by isotonic regression; 0 if no score is (the labels then say nothing)."""
    order = np.argsort(-score, kind="stable")
    blocks: list[list[float]] = []  # right ones and size of each pool, the share falls from pool to pool
    for ok in ~wrong[order]:
        blocks.append([float(ok), 1.0])
        while len(blocks) > 1 and blocks[-1][0] * blocks[-2][1] >= blocks[-2][0] * blocks[-1][1]:
            right, size = blocks.pop()
            blocks[-1][0] += right
            blocks[-1][1] += size
    taken = 0
    for right, size in blocks:
        if right < accept * size:
            break
        taken += int(size)
    return float(score[order][taken - 1]) if taken else 0.0


def held_out(id_: Column) -> Column:
    """Whether a document is never learned from: remainder 1 of the id's CRC-32 by 3."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(3)) == 1


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the documents that aren't held out and have a language and a text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id"))).where("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one per language
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, PER_LANGUAGE / n))])
    draw = F.xxhash64(F.lit(SEED), F.col("id"), F.col("text"))
    uniform = F.pmod(draw, F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where("text is not null").where(uniform < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    sample = sample.select("lang", F.pmod(F.shiftright(draw, 24), F.lit(5)).alias("part"), "text")

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            heads = list(zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True))
            for keys, texts in batches(zip(heads, utf8(p.column(2)), strict=True), TEXT_BYTES):
                bucket, first = subwords(texts)
                own = [np.unique(bucket[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                use = [i for i, (u, _) in enumerate(own) if len(u)]
                yield batch_of(
                    _SAMPLE, lang=[keys[i][0] for i in use], part=[keys[i][1] for i in use],
                    bucket=[own[i][0] for i in use], share=[(own[i][1] / own[i][1].sum()).astype(np.float32) for i in use],
                )

    drawn = sample.mapInArrow(features, "lang string, part long, bucket array<int>, share array<float>").toArrow()
    cols = [drawn.column(i).combine_chunks() for i in range(4)]
    at = cols[2].offsets.to_numpy() if len(cols[2]) else np.zeros(1, int)
    bucket, part = cols[2].values.to_numpy(zero_copy_only=False), cols[3].values.to_numpy(zero_copy_only=False)
    labels, fold = cols[0].to_pylist(), cols[1].to_pylist()
    out = [(labels[i], fold[i], bucket[at[i] : at[i + 1]], part[at[i] : at[i + 1]]) for i in range(len(labels))]
    return train(sorted(out, key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes())))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag, lang_pred, score, rejected`` of each document (``tag`` is a hash of its text)."""
    sent = shared(docs.sparkSession, (model.languages, model.logits, model.bias, model.temperature, model.threshold))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for p in parts:
            heads = zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)
            for keys, texts in batches(zip(heads, utf8(p.column(2)), strict=True), TEXT_BYTES):
                lang, score, rejected = own.predict(texts)
                yield batch_of(
                    _PREDICTED, id=[k[0] for k in keys], tag=[k[1] for k in keys], lang_pred=lang, score=score, rejected=rejected
                )

    return rows.mapInArrow(run, "id long, tag long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is known well enough, with all their columns."""
    out = identify(docs, learn(docs, id_col, text_col, lang_col), id_col, text_col).where("rejected")
    key = F.xxhash64("id", "tag").alias("__key")
    gone = stage(out.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), key).distinct(), "llm-rejected")
    id_, tag = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    return without(docs, F.xxhash64(id_, tag), gone, id_.eqNullSafe(gone["__id"]) & (tag == gone["__tag"]))
