"""Source divergence audit on run-length encoded count columns.

Every source of a language is a column over the language's vocabulary: how often each kept term occurs in it. Terms
are put in an order that lays equal counts together (by the number of sources they occur in, the set of those
sources, and the counts in them), so a column is a few long runs, most of them zeros. Columns are cut into blocks of
``BLOCK`` terms and run-length encoded block by block. The divergence of a pair of sources is a sum over the terms
of ``f = floor((p - q)**2 / q)`` with ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; it is computed per block by
meeting the run boundaries of both columns and multiplying ``f`` by the length of each common run.

Scale: terms are counted in the scan and added up by shuffles with partial sums. One (source, block) column holds at
most ``BLOCK`` terms whatever the source's size. Pairs are formed in tiles of about ``TILE`` by ``TILE`` sources of one
block, so a language with many sources, or many terms, is spread over many tasks and no task holds more than two
tiles of one block. All numbers are exact integers; sums stay below 2**63 while a vocabulary has fewer than 2**31 terms.

Defined cases: null text, language or source is the empty string. Terms are counted per row, so rows with equal ids
count each for themselves. Long texts are cut at gaps and counted piece by piece. A language without kept terms has
divergence 0 for all its pairs and no term rows. Equal values are ranked by name. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import sequence_table, with_group_number
from ..plans.staging import stage
from .common import batch_of, utf8

#: Documents of its language that a term must occur in.
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Terms of a block, sources of a tile (about).
BLOCK, TILE = 1 << 13, 64
#: Bytes of text that are cut into terms at once, and (group, term) counts that a task holds before it hands them on.
TEXT_BYTES, HELD = 1 << 22, 600_000
# a held count is one integer, occurrences below and documents above; bounds on both until they are handed on
_DOC, _MOST_DOCS, _MOST_TERMS = 1 << 40, 1 << 22, 1 << 39

# letters and everything beyond ASCII are parts of terms, the rest is a gap; only A-Z are folded
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_RUNS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("block", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("start", "length", "count")]
)
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_DDL = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text, in lists of bounded size where gaps allow."""
    if len(text) <= TEXT_BYTES:
        yield text.translate(_FOLD).split()
        return
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = at + TEXT_BYTES
        if end < len(folded):
            cut = folded.find(b" ", end)
            end = len(folded) if cut < 0 else cut
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term; the empty term stands for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = docs_held = terms_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                n = len(own)
                both = np.fromiter(own.values(), np.int64, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(list(own), pa.binary()).cast(pa.string()),
                        pa.array(both & (_DOC - 1)), pa.array(both >> 40),
                    ],
                    schema=_COUNTS,
                )

        for p in parts:
            for lang, source, text in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), utf8(p.column(2)), strict=True):
                here: Counter = Counter()
                for some in terms(text):
                    here.update(some)
                    terms_held += len(some)
                own = held.get((lang, source))
                if own is None:
                    own = held[lang, source] = {b"": 0}
                before, known = len(own), own.get
                for term, n in here.items():
                    own[term] = known(term, 0) + n + _DOC
                size += len(own) - before
                docs_held += 1
                if size > HELD or docs_held >= _MOST_DOCS or terms_held >= _MOST_TERMS:
                    yield from out()
                    held, size, docs_held, terms_held = {}, 0, 0, 0
        yield from out()

    counted = rows.mapInArrow(run, _ddl(_COUNTS))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, total, place``: the kept terms, numbered from 0 per language so that equal counts lie together."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("sources"),
        F.bit_xor(F.xxhash64("source")).alias("where"), F.bit_xor(F.xxhash64("source", "n")).alias("how"),
    )
    kept = kept.where(F.col("docs") >= least_docs)
    order = ["lang", "sources", "where", "how", "term"]
    placed = with_group_number(sequence_table(kept, order, "llm-terms"), "lang", "place")
    return placed.select("lang", "term", "total", (F.col("place") - 1).alias("place"))


def probability(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + size))``, exactly."""
    above = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, (total + size).cast("decimal(20,0)"))


def probabilities(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """The same for an array of counts."""
    if int(count.max(initial=0)) < 1 << 33:  # SCALE * (count + 1) fits
        return 1 + SCALE * (count + 1) // (total + size)
    return np.array([1 + SCALE * (int(c) + 1) // (total + size) for c in count], np.int64)


def run_lengths(entries: DataFrame) -> DataFrame:
    """``lang, source, block, start, length, count``: the runs of equal counts above 0 in each block of a column."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, count = None, [], []

        def encode():
            at, n = np.array(place), np.array(count)
            begin = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(n) != 0)))
            first = np.flatnonzero(begin)
            length = np.diff(np.append(first, len(at)))
            return batch_of(_RUNS, lang=[key[0]], source=[key[1]], block=[key[2]], start=[at[first]], length=[length], count=[n[first]])

        for p in parts:
            for lang, source, block, at, n in zip(*(p.column(i).to_pylist() for i in range(5)), strict=True):
                if (lang, source, block) != key:
                    if key is not None:
                        yield encode()
                    key, place, count = (lang, source, block), [], []
                place.append(at)
                count.append(n)
        if key is not None:
            yield encode()

    cut = entries.select("lang", "source", F.floor(F.col("place") / BLOCK).alias("block"), F.col("place") % BLOCK, "n")
    cut = cut.toDF("lang", "source", "block", "at", "n")
    key = ["lang", "source", "block"]
    return cut.repartition(*key).sortWithinPartitions(*key, "at").mapInArrow(run, _ddl(_RUNS))


def full_column(start, length, count, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Run starts and counts over a whole block, runs of zeros included."""
    if start is None or not len(start):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    start, count = np.asarray(start, np.int64), np.asarray(count, np.int64)
    end = start + np.asarray(length, np.int64)
    gap = np.flatnonzero(np.append(start[1:], size) > end)  # runs that zeros follow
    starts, counts = np.concatenate((start, end[gap])), np.concatenate((count, np.zeros(len(gap), np.int64)))
    if start[0] > 0:
        starts, counts = np.append(starts, 0), np.append(counts, 0)
    order = np.argsort(starts)
    return starts[order], counts[order]


def met(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> tuple[int, int]:
    """Sums of ``f(a, b)`` and ``f(b, a)`` over two columns of ``(run starts, p)``."""
    cuts = np.union1d(a[0], b[0])
    length = np.diff(np.append(cuts, size))
    p = a[1][np.searchsorted(a[0], cuts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], cuts, side="right") - 1]
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def pair_sums(columns: DataFrame, tile: int = TILE) -> DataFrame:
    """``lang, source, item, value`` of all ordered pairs of one language's columns, summed over the blocks.

    ``columns`` is ``lang, source, block, size, total, terms, sources, start, length, count``: one row per column and block.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right = None, [], []

        def pairs() -> Iterator[pa.RecordBatch]:
            lang, _, one, two = key
            for i, (source, size, column) in enumerate(left):
                rest = left[i + 1 :] if one == two else right
                if not rest:
                    continue
                both = [met(column, other, size) if size else (0, 0) for _, _, other in rest]
                names = [x[0] for x in rest]
                n = len(rest)
                yield batch_of(
                    _PAIRS, lang=[lang] * (2 * n), source=[source] * n + names, item=names + [source] * n,
                    value=[x[0] for x in both] + [x[1] for x in both],
                )

        for p in parts:
            for row in zip(*(p.column(i).to_pylist() for i in range(12)), strict=True):
                lang, block, one, two, own, source, size, total, terms_, *runs = row
                if (lang, block, one, two) != key:
                    if key is not None:
                        yield from pairs()
                    key, left, right = (lang, block, one, two), [], []
                column = None
                if size:
                    starts, counts = full_column(*runs, size)
                    column = (starts, probabilities(counts, total, terms_))
                (left if own == one else right).append((source, size, column))
        if key is not None:
            yield from pairs()

    tiles = F.ceil(F.col("sources") / tile)
    own = F.pmod(F.xxhash64("source"), tiles)
    dealt = columns.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    key = ["lang", "block", "one", "two"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "own", "source")
    dealt = dealt.select(*key, "own", "source", "size", "total", "terms", "start", "length", "count")
    return dealt.mapInArrow(run, _ddl(_PAIRS)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, top_terms: int, least_docs: int = LEAST_DOCS, tile: int = TILE,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` ranks the other sources of the language by their divergence from the source, part ``term`` the
    ``top_terms`` terms that are commoner in the source than in its language by their share of that.
    """
    counts = stage(term_counts(docs, lang_col, source_col, text_col), "llm-term-counts")
    words = stage(vocabulary(counts, least_docs), "llm-vocabulary")
    entries = counts.where("term <> ''").select("lang", "source", "term", "n").join(words, ["lang", "term"])
    entries = stage(entries, "llm-term-entries")

    langs = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sources = counts.where("term = ''").groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sources, "lang").na.fill(0, ["total", "terms", "lang_total"])
    groups = stage(groups, "llm-term-groups")  # one row per source of a language

    last = F.greatest(F.ceil(F.col("terms") / BLOCK) - 1, F.lit(0))
    columns = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    columns = columns.withColumn("size", F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK))
    columns = columns.join(run_lengths(entries), ["lang", "source", "block"], "left")
    pairs = pair_sums(columns, tile).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = _ranked(pairs)

    p, q = probability(F.col("n"), F.col("total_"), F.col("terms")), probability(F.col("total"), F.col("lang_total"), F.col("terms"))
    own = entries.join(groups.select("lang", "source", F.col("total").alias("total_"), "terms", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    own = own.selectExpr("lang", "source", "'term' as part", "term as item", "((p - q) * (p - q)) div q as value")
    return pairs.unionByName(_ranked(own).where(F.col("rank") <= top_terms))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(order))
