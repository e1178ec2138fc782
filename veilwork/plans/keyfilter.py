"""Bit filter of a key set, tested where rows are made so that few of them reach a shuffle.

The filter is blocked: a 64-bit key picks one word of the bitmap and a mask of three bits in it, so a test reads one
word. Spark builds the bitmap; it reaches the tasks as the one value of a scalar subquery, at most ``MAX_WORDS`` longs.
Larger key sets get no filter, the join that follows does the same work with more rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Words of the largest bitmap (8 MiB), keys from which on a filter is built, and keys of a word.
MAX_WORDS, LEAST_KEYS, KEYS_PER_WORD = 1 << 20, 10_000, 4
#: A bitmap that is fuller than this lets too much pass.
MOST_PER_WORD = 16


def _mask(key: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, at).bitwiseAND(63).cast("int")) for at in (32, 40, 48)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


@dataclass
class KeyFilter:
    bits: DataFrame | None
    words: int = 0

    def passes(self, key: Column) -> Column:
        """Whether a 64-bit key may be in the set: true for all that are, and for a few others."""
        if self.bits is None:
            return F.lit(True)
        word = F.get(self.bits.scalar(), key.bitwiseAND(self.words - 1).cast("int"))
        return word.bitwiseAND(_mask(key)) == _mask(key)


def key_filter(keys: DataFrame, column: str, least: int = LEAST_KEYS, max_words: int = MAX_WORDS) -> KeyFilter:
    """Filter of a long column of a staged table; one that lets all pass if the keys are few or too many."""
    n = keys.count()
    if n < least or n > max_words * MOST_PER_WORD:
        return KeyFilter(None)
    words = min(max_words, 1 << max(0, (n // KEYS_PER_WORD).bit_length()))
    key = F.col(column)
    own = keys.groupBy(key.bitwiseAND(words - 1).alias("id")).agg(F.bit_or(_mask(key)).alias("bits"))
    every = keys.sparkSession.range(words).join(own, "id", "left")
    packed = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("b"))
    return KeyFilter(stage(packed.selectExpr("transform(b, x -> x.bits) as bits"), "key-filter"), words)
