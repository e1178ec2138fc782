"""Mixing sources to target weights by fitting budgets with subset sums.

Sources are ordered by code point (null last) and weighted by a repeating list. They share a budget of
``share`` times all words; no source gets more than ``most`` times its own words, the excess is shared again
by weight. A source takes all its documents as often as its target holds them; for the rest a subset of
its documents is chosen. Documents count by their exact length: the rest is first taken from all lengths in
proportion, then from the longest that still fit, and the last words are fitted by a bounded-knapsack dynamic
program over the lengths that are left. If that doesn't spend the budget to the word, the program takes more and
more of the picks back, until it does or no choice of documents can come nearer. Of each length the documents
first in the order of a seeded hash are taken.

The dynamic program sees one row per source and length, never documents. Documents of one length are ranked
in hashed buckets of about ``BUCKET`` rows, so that a length held by a third of all documents is spread over
many tasks. Reruns agree: only ids, texts, sources and the seed decide.

Defined cases: null text has 0 words. A source without words has target 0. Rows with equal or
null ids are documents of their own, told apart by ``tag``, a hash of their text; if one of two equal rows is
taken, either may be meant. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import WORD

#: Documents of one source and length that are ranked together.
BUCKET = 10_000
#: Words of a rest at which the longest-first picks end and the dynamic program takes over.
FIT_WORDS = 1 << 16


def source_targets(totals: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``skey, source_size, target`` from one row per source ``skey, source, source_size``.

    Water filling: a source is full if the level at which its limit is reached is below the level that spends
    the budget. There is one row per source, so the window without a partition stays small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = totals.withColumn("w", weight).withColumn("limit", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("limit") / F.col("w"), "skey")
    every = Window.partitionBy()
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(every) * float(share))
        .withColumn("full", F.sum("limit").over(upto))
        .withColumn("open_w", F.sum("w").over(every) - F.sum("w").over(upto))
    )
    # a source is full if its own level, given to all sources not yet full, spends no more than the budget
    fits = F.col("full") + F.col("open_w") * F.col("limit") / F.col("w") <= F.col("budget")
    rows = rows.withColumn("is_full", fits)
    left = F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("limit")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("is_full"), F.col("limit")).otherwise(left * F.col("w") / F.nullif(open_, F.lit(0.0)))
    return rows.select("skey", "source_size", target.alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to ``budget`` from below
    as any choice can. Lengths are positive and distinct.

    Some best choice is reached from any one that misses the budget by less than the longest length ``w``, by
    taking back at most ``w * w`` words: done in a fitting order the changes never leave the ``2 * w`` sums
    around the budget, and changes between two equal sums can be left out. So the program need not reopen more.
    """
    counts = counts.astype(np.int64)
    if budget >= int((sizes * counts).sum()):
        return counts.copy()
    unit = int(np.gcd.reduce(sizes))
    sizes, budget = sizes.astype(np.int64) // unit, budget // unit
    total = int((sizes * counts).sum())
    take = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if 0 <= rest <= FIT_WORDS:
            break
        if rest < 0:  # rounding of the proportion
            n = min(int(take[i]), -(rest // int(sizes[i])))
            take[i] -= n
        else:
            n = -min(int(counts[i] - take[i]), rest // int(sizes[i]))
            take[i] -= n
        rest += n * int(sizes[i])
    longest, back = int(sizes.max()), 0
    while rest > 0:
        _refit(sizes, counts, take, order, rest, back)
        rest = budget - int((sizes * take).sum())
        most = min(longest * longest, budget - rest, total - budget + rest)
        if back >= most:
            break
        back = min(4 * max(back, longest), most)
    return take


def _refit(sizes: np.ndarray, counts: np.ndarray, take: np.ndarray, order: np.ndarray, rest: int, back: int) -> None:
    """Change ``take`` so that as much as possible of ``rest`` is spent, taking back ``back`` words at most.

    A bit of ``reached`` is a sum of changes, ``back`` the sum 0. Only every ``step``-th state is kept; those
    between are made again when the way is read backwards.
    """
    pieces: list[tuple[int, int]] = []
    for sign, free in ((-1, take), (1, counts - take)):
        for i in order:
            left, part = min(int(free[i]), (back + rest * (sign > 0)) // int(sizes[i])), 1
            while left > 0:
                n = min(part, left)
                pieces.append((int(i), sign * n))
                left -= n
                part *= 2
    window = (1 << (back + rest + 1)) - 1

    def add(reached: int, piece: tuple[int, int]) -> int:
        by = piece[1] * int(sizes[piece[0]])
        return reached | ((reached << by) & window if by > 0 else reached >> -by)

    step = math.isqrt(len(pieces)) + 1
    reached, kept, done = 1 << back, [], 0
    for k, piece in enumerate(pieces):
        if reached >> (back + rest) & 1:
            break
        if k % step == 0:
            kept.append(reached)
        reached, done = add(reached, piece), k + 1
    at = reached.bit_length() - 1
    for b in range(len(kept) - 1, -1, -1):
        own = pieces[b * step : min(done, (b + 1) * step)]
        states = [kept.pop()]
        for piece in own[:-1]:
            states.append(add(states[-1], piece))
        for (i, n), before in zip(reversed(own), reversed(states), strict=True):
            if not before >> at & 1:
                take[i] += n
                at -= n * int(sizes[i])


def source_key(source: Column) -> Column:
    """The source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(
    docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    with_key: bool = False,
) -> DataFrame:
    """``id, size, source_size, target, taken``: the words of each document that the mix takes.

    ``with_key`` adds ``tag, skey``: with the id they say which document a row is about.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        source_key(F.col(source_col)).alias("skey"),
        F.xxhash64(F.col(text_col).cast("string")).alias("tag"),
    )
    rows = stage(rows, "llm-sizes")
    lengths = stage(rows.groupBy("skey", "size").agg(F.count("*").alias("n")), "llm-lengths")
    totals = lengths.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    totals = totals.withColumn("source", F.when(F.col("skey") != "", F.substring("skey", 2, 1 << 30)))
    targets = stage(source_targets(totals, weights, share, most), "llm-targets")

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        words, target = int(own["source_size"].iloc[0]), float(own["target"].iloc[0])
        whole = min(int(target // words), math.floor(most)) if words else 0
        use = (own["size"] > 0).to_numpy()
        extra = np.zeros(len(own), np.int64)
        budget = round(target) - whole * words
        if budget > 0 and whole < most:
            extra[use] = fit(own["size"].to_numpy()[use], own["n"].to_numpy()[use], budget)
        return own[["skey", "size", "n"]].assign(whole=whole, extra=extra)

    plan = (
        lengths.join(targets, "skey")
        .groupBy("skey")
        .applyInPandas(choose, "skey string, size long, n long, whole long, extra long")
    )
    plan = stage(plan, "llm-mix-plan")
    ranked = rows.join(plan, ["skey", "size"]).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("id", "tag")))
    ranked = ranked.withColumn("bucket", F.pmod(F.shiftright("h", 16), F.ceil(F.col("n") / BUCKET)))
    ranked = stage(ranked, "llm-mix-rows")
    each = ranked.groupBy("skey", "size", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("off", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    place = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("h", "id", "tag"))
    chosen = ranked.withColumn("rn", place).join(each, ["skey", "size", "bucket"])
    copies = F.col("whole") + (F.col("rn") + F.col("off") <= F.col("extra")).cast("long")
    return chosen.join(targets, "skey").select(
        "id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *(["tag", "skey"] if with_key else [])
    )
