"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-case words of letters, marks and digits of any script; typographic quotes, dashes and blanks
part words like ASCII signs do, and scripts without blanks between words are cut into characters. A document and a benchmark item become a pair if
they share a seed of ``SEED_WORDS`` words (shorter items: the whole item). Each pair is tiled: for falling
search lengths, windows of unmarked words are compared by running Karp-Rabin hashes, equal windows are
lengthened word by word, and the longest matches are marked first, so that tiles never overlap on either side.
The order of the tiles doesn't matter, so reordered passages are found. The share of an item's words under tiles
is its coverage; a document that covers ``0.8`` or more of some item is contaminated.

Seeds of a benchmark within ``max_bytes`` go to all executors, and documents are tiled where they are read:
nothing is shuffled. A larger benchmark is joined with the documents' distinct seeds; pairs that share too few
seeds for the threshold are dropped by an exact count, and only the rest is tiled. Both ways give the same rows.

Defined cases: null texts are empty, texts of any length are tiled whole; empty items match nothing; items that occur several times give a row each;
documents with equal ids are judged each for itself (``tag`` is a hash of the text). Empty tables give an empty
result. Other columns are ignored by ``contaminated`` and pass through ``drop_contaminated`` unchanged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import batch_of, shared, utf8, without
from .words import Rolling, Words, batches

SEED_WORDS = 5
COVERAGE = 0.8
#: Benchmarks with more bytes of text are joined instead of sent to the executors.
MAX_BENCHMARK_BYTES = 8 << 20

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = _c
_GAP = np.arange(256) == 32

_HITS = pa.schema(
    [("id", pa.int64()), ("tag", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("words", pa.int64())]
)
_HITS_DDL = "id long, tag long, item_id long, coverage double, tiles long, words long"
_SEEDS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("size", pa.int32()), ("seed", pa.int64())])


# characters beyond ASCII that aren't plain accented Latin letters: only texts with some need the slower cut
_OTHER = regex.compile(r"[\u0080-\u00BF\u00D7\u00F7\u0250-\U0010FFFF]")
_SIGNS = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7F]+")
_UNSPACED = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)")


def _folded(text: bytes) -> bytes:
    """Lower case, with blanks for signs beyond ASCII and around the characters of scripts without blanks."""
    if text.isascii():
        return text.lower()
    low = text.decode().lower()
    if _OTHER.search(low):
        low = _UNSPACED.sub(r" \1 ", _SIGNS.sub(" ", low))
    return low.encode()


def _words(texts: list[bytes]) -> Words:
    return Words([_folded(t) for t in texts], _GAP, _FOLD)


def tile(doc: np.ndarray, starts: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(place in doc, place in item, words)`` between two arrays of word hashes.

    ``starts``: places of the document at which ``least`` words of the item begin; no longer match can start
    anywhere else.
    """
    roll_d, roll_i = Rolling(doc), Rolling(item)
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = len(item)
    while size >= least:
        at_d = starts[starts + size <= len(doc)]
        sums_d, sums_i = np.concatenate(([0], np.cumsum(free_d))), np.concatenate(([0], np.cumsum(free_i)))
        at_d = at_d[sums_d[at_d + size] - sums_d[at_d] == size]
        at_i = np.arange(len(item) - size + 1)
        at_i = at_i[sums_i[at_i + size] - sums_i[at_i] == size]
        found: dict[tuple[int, int], int] = {}
        if len(at_d) and len(at_i):
            h_d, h_i = roll_d.at(at_d, at_d + size), roll_i.at(at_i, at_i + size)
            order = np.argsort(h_i, kind="stable")
            lo, hi = np.searchsorted(h_i[order], h_d, "left"), np.searchsorted(h_i[order], h_d, "right")
            for k in np.flatnonzero(hi > lo):
                i = int(at_d[k])
                for j in at_i[order[lo[k] : hi[k]]].tolist():
                    if i and j and free_d[i - 1] and free_i[j - 1] and doc[i - 1] == item[j - 1]:
                        continue  # part of a match that starts earlier
                    n = 0
                    while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                        n += 1
                    if n >= size:
                        found[i, j] = n
        longest = max(found.values(), default=0)
        if longest > 2 * size:  # start again with the length of the longest match
            size = longest
            continue
        heap = [(-n, i, j) for (i, j), n in found.items()]
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            both = free_d[i : i - n] & free_i[j : j - n]
            if both.all():
                free_d[i : i - n] = False
                free_i[j : j - n] = False
                tiles.append((i, j, -n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], both.view(np.int8), [0]))))
            for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= size:
                    heapq.heappush(heap, (a - b, i + a, j + a))
        size = max(size // 2, least) if size > 2 * least else (least if size > least else 0)
    return tiles


class _Items:
    """Benchmark items of an executor: hashes of their words, and which items a seed belongs to."""

    def __init__(self, ids: list, texts: list[bytes]):
        words = _words(texts)
        h = words.hashes()
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.least = [min(SEED_WORDS, len(w)) for w in self.words]
        roll = Rolling(h)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, SEED_WORDS + 1):
            own = [d for d in range(len(ids)) if self.least[d] == k]
            at = np.concatenate([np.arange(words.first[d], words.first[d + 1] - k + 1) for d in own] or [np.zeros(0, int)])
            if len(at):
                owner = np.repeat(own, [len(self.words[d]) - k + 1 for d in own])
                seed = roll.at(at, at + k)
                order = np.argsort(seed, kind="stable")
                self.seeds[k] = seed[order], owner[order]

    def hits(self, h: np.ndarray, roll: Rolling, first: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, coverage, tiles, words) of the texts whose word hashes are ``h``."""
        pairs: dict[tuple[int, int], list[np.ndarray]] = {}
        for k, (seed, owner) in self.seeds.items():
            grams = roll.windows(k)
            sieve = np.zeros(1 << 20, bool)
            sieve[seed & np.uint64((1 << 20) - 1)] = True
            at = np.flatnonzero(sieve[grams & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(seed, grams[at], "left"), np.searchsorted(seed, grams[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + k <= first[doc + 1]
            at, lo, n, doc = at[inside], lo[inside], (hi - lo)[inside], doc[inside]
            each = np.repeat(np.arange(len(at)), n)
            item = owner[lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
            code = doc[each] * len(self.ids) + item
            order = np.lexsort((at[each], code))
            code, place = code[order], at[each][order]
            for own in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code)) + 1) if len(code) else []:
                d, i = divmod(int(code[own[0]]), len(self.ids))
                pairs[d, i] = np.unique(place[own]) - first[d]
        for (d, i), starts in pairs.items():
            item = self.words[i]
            if min(len(starts) * self.least[i], len(item)) < least * len(item) - 1e-9:
                continue  # tiles can't cover more words than that
            doc = h[first[d] : first[d + 1]]
            tiles = tile(doc, starts, item, self.least[i])
            covered = sum(n for _, _, n in tiles)
            if covered >= least * len(item) - 1e-9:
                yield d, i, covered / len(item), len(tiles), covered


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _stream(parts: Iterator[pa.RecordBatch]):
    for p in parts:
        yield from zip(zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True), utf8(p.column(2)), strict=True)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BENCHMARK_BYTES,
) -> DataFrame:
    """``id, tag, item_id, coverage, tiles, words``: one row per document and item it covers enough of."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("item")
    )
    size = items.agg(F.sum(F.octet_length("item").cast("long") + 16).alias("n")).first()["n"] or 0
    if size > max_bytes:
        return _joined(rows, items, least)
    own = items.collect()  # at most ``max_bytes``
    sent = shared(spark, ([r["item_id"] for r in own], [r["item"].encode() for r in own]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Items(*sent.value)
        for heads, texts in batches(_stream(parts), 1 << 20):
            words = _words(texts)
            h = words.hashes()
            hits = list(known.hits(h, Rolling(h), words.first, least))
            yield batch_of(
                _HITS, id=[heads[x[0]][0] for x in hits], tag=[heads[x[0]][1] for x in hits],
                item_id=[known.ids[x[1]] for x in hits], coverage=[x[2] for x in hits], tiles=[x[3] for x in hits],
                words=[x[4] for x in hits],
            )

    return rows.mapInArrow(run, _HITS_DDL)


def _joined(rows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The same for a benchmark of any size."""
    numbered = stage(items.withColumn("num", F.xxhash64("item_id", "item")), "llm-items").dropDuplicates(["num"])
    once = stage(numbered.select("num", "item"), "llm-items-once")

    def item_seeds(parts):
        for p in parts:
            for nums, texts in batches(zip(p.column(0).to_pylist(), utf8(p.column(1)), strict=True), 1 << 20):
                known = _Items(nums, texts)
                for k, (seed, owner) in known.seeds.items():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([nums[o] for o in owner], pa.int64()), pa.array([k] * len(seed), pa.int32()),
                            pa.array(seed.view(np.int64)), pa.array([len(known.words[o]) for o in owner], pa.int32()),
                        ],
                        ["num", "size", "seed", "length"],
                    )

    seeds = once.mapInArrow(item_seeds, "num long, size int, seed long, length int")
    seeds = stage(seeds.groupBy("num", "size", "seed", "length").agg(F.count("*").alias("places")), "llm-seeds")
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]  # at most SEED_WORDS numbers

    def doc_seeds(parts):
        for heads, texts in batches(_stream(parts), 1 << 20):
            words = _words(texts)
            roll = Rolling(words.hashes())
            for k in sizes:
                at = np.flatnonzero(words.whole(k))
                doc = np.searchsorted(words.first, at, side="right") - 1
                pair = np.unique(np.stack([doc.astype(np.uint64), roll.windows(k)[at]], axis=1), axis=0)
                who = pair[:, 0].astype(np.int64)
                yield batch_of(
                    _SEEDS, id=[heads[d][0] for d in who], tag=[heads[d][1] for d in who], size=np.full(len(who), k),
                    seed=np.ascontiguousarray(pair[:, 1]).view(np.int64),
                )

    asked = rows.mapInArrow(doc_seeds, "id long, tag long, size int, seed long").distinct()
    pairs = asked.join(seeds, ["size", "seed"]).groupBy("id", "tag", "num", "size", "length").agg(F.sum("places").alias("places"))
    # a place begins at most ``size`` covered words
    pairs = pairs.where(F.col("places") * F.col("size") >= least * F.col("length") - 1e-9).select("id", "tag", "num")
    pairs = stage(pairs, "llm-item-pairs").alias("p")
    texts = rows.alias("r").join(pairs, F.expr("r.id <=> p.id and r.tag = p.tag")).select("r.id", "r.tag", "r.text", "p.num")
    texts = texts.join(once, "num").select("id", "tag", "text", "num", "item")

    def run(parts):
        for p in parts:
            stream = zip(zip(*(p.column(i).to_pylist() for i in (0, 1, 3)), utf8(p.column(4)), strict=True), utf8(p.column(2)), strict=True)
            for heads, docs in batches(stream, 1 << 20):
                out = []
                for (id_, tag, num, item), text in zip(heads, docs, strict=True):
                    words = _words([text])
                    h = words.hashes()
                    for hit in _Items([num], [item]).hits(h, Rolling(h), words.first, least):
                        out.append((id_, tag, num, *hit[2:]))
                cols = list(zip(*out, strict=True)) or [[]] * 6
                yield batch_of(_HITS, **dict(zip(_HITS.names, cols, strict=True)))

    hits = texts.mapInArrow(run, _HITS_DDL).withColumnRenamed("item_id", "num").distinct()
    ids = items.select(F.xxhash64("item_id", "item").alias("num"), "item_id")
    return hits.join(ids, "num").select("id", "tag", "item_id", "coverage", "tiles", "words")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents that cover no item, with all their columns."""
    hits = contaminated(docs, benchmark, least, id_col, text_col)
    key = F.xxhash64("id", "tag").alias("__key")
    gone = stage(hits.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), key).distinct(), "llm-contaminated")
    id_, tag = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    return without(docs, F.xxhash64(id_, tag), gone, id_.eqNullSafe(gone["__id"]) & (tag == gone["__tag"]))
