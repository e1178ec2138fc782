"""Audits of rewritten data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import marked_parts, q
from ..plans.staging import stage
from .dictionary import RUN, WORD, wordless_runs, wordless_sizes
from .spans import with_mark

MIN_LEAK_LENGTH = 4
_GRAM = 4


def _grams(text: str, n: int) -> str:
    """Distinct character runs of length ``n``, found in one pass by a lookahead."""
    return f"array_distinct(regexp_extract_all({text}, {q(f'(?s)(?=(.{{{n}}}))')}, 1))"


def value_needles(values: DataFrame) -> DataFrame:
    """``(raw_value, kind, needle)``: what a document must hold if it holds the value as a substring.

    ``word``: a whole word (a word of the value with other characters on both sides inside the value).
    ``part``: a piece of a word (a word at the edge of the value may go on outside it).
    ``run``: a run of up to ``RUN`` characters, for values without any word; of a value's runs the one that the
    fewest values hold.
    The longest choice is taken, whole words first.
    """
    marked = with_mark(values.withColumnRenamed("raw_value", "text").select("text"), [])
    parts = marked_parts("text", q(f"()({WORD})()"), "_mark")
    chosen = (
        "transform(sequence(1, cast(size(p) div 2 as int)), i -> named_struct("
        "'whole', (i > 1 or get(p, 0) <> '') and (2 * i + 1 < size(p) - 1 or get(p, size(p) - 1) <> ''), "
        "'n', length(get(p, 2 * i - 1)), 'w', get(p, 2 * i - 1)))"
    )
    pick = f"array_max({chosen})"
    rows = marked.selectExpr("text as raw_value", f"{parts} as p").selectExpr(
        "raw_value", f"if(size(p) > 1, {pick}, null) as b"
    )
    worded = rows.where("b is not null").selectExpr(
        "raw_value", "case when b.whole then 'word' else 'part' end as kind", "b.w as needle"
    )
    by_size = " ".join(
        f"when length(raw_value) {'=' if n < RUN else '>='} {n} then {wordless_runs('raw_value', n)}" for n in range(1, RUN + 1)
    )
    runs = rows.where("b is null").selectExpr("raw_value", f"posexplode(case {by_size} end) as (pos, run)")
    rare = (
        runs.join(runs.groupBy("run").count(), "run")
        .groupBy("raw_value")
        .agg(F.min(F.struct("count", "pos", "run")).alias("r"))
        .selectExpr("raw_value", "'run' as kind", "r.run as needle")
    )
    return worded.unionByName(rare)


def leaks(outputs: DataFrame, registry: DataFrame, case_id: str) -> DataFrame:
    """``(doc_id, raw_value, pii_type, token)``: values of at least four characters left in a text.

    Occurrence is a plain substring, case-sensitive, also inside words. Documents are reduced to their
    distinct words. Whole-word needles meet them in an equi-join; word pieces are first looked up in the
    vocabulary of the corpus (each distinct word once, by one short character run of the piece), which
    grows far slower than the corpus. The last test is on the text itself.
    """
    known = registry.where((F.col("case_id") == case_id) & (F.length("raw_value") >= MIN_LEAK_LENGTH))
    needles = stage(value_needles(known.select("raw_value").distinct()), "needles")
    marked = with_mark(outputs, ["doc_id"])
    words = marked.selectExpr("doc_id", f"explode(array_distinct(regexp_extract_all(text, {q(WORD)}, 0))) as word")

    pieces = needles.where("kind = 'part'").withColumn("n", F.expr(f"least(length(needle), {_GRAM})"))
    whole = needles.where("kind = 'word'").selectExpr("raw_value", "needle as word")
    lookup = whole
    sizes = sorted(r.n for r in pieces.select("n").distinct().collect())  # at most four rows
    if sizes:
        vocabulary = stage(words.select("word").distinct(), "vocabulary")
        # one rare run per piece: the run that the fewest pieces hold
        by_size = " ".join(f"when n = {n} then {_grams('needle', n)}" for n in sizes)
        runs = pieces.selectExpr("raw_value", "needle", f"posexplode(case {by_size} end) as (pos, gram)")
        rare = (
            runs.join(runs.groupBy("gram").count(), "gram")
            .groupBy("raw_value", "needle")
            .agg(F.min(F.struct("count", "pos", "gram")).alias("r"))
            .selectExpr("raw_value", "needle", "r.gram as gram")
        )
        all_grams = ", ".join(_grams("word", n) for n in sizes)
        word_grams = vocabulary.selectExpr("word", f"explode(flatten(array({all_grams}))) as gram")
        inside = word_grams.join(rare, "gram").where("contains(word, needle)").select("raw_value", "word").distinct()
        lookup = whole.unionByName(inside)
    hits = words.join(stage(lookup, "leak-words"), "word").select("doc_id", "raw_value")
    if run_sizes := wordless_sizes(needles, "raw_value"):
        every = ", ".join(wordless_runs("text", n) for n in run_sizes)
        runs = outputs.selectExpr("doc_id", f"explode(array_distinct(concat({every}))) as needle")
        wordless = needles.where("kind = 'run'").select("raw_value", "needle")
        hits = hits.unionByName(runs.join(wordless, "needle").select("doc_id", "raw_value"))
    suspects = stage(hits.groupBy("doc_id").agg(F.collect_set("raw_value").alias("_v")), "suspects")
    found = (
        outputs.select("doc_id", "text")
        .join(suspects, "doc_id")
        .selectExpr("doc_id", "explode(filter(_v, v -> contains(text, v))) as raw_value")
    )
    return found.join(known.select("raw_value", "pii_type", "token"), "raw_value").select(
        "doc_id", "raw_value", "pii_type", "token"
    )


def round_trip_differences(originals: DataFrame, restored: DataFrame) -> DataFrame:
    """Documents that are not the same after restoring: their lengths before and after.

    Digests and lengths are compared; no text is moved.
    """
    pairs = originals.selectExpr("doc_id", "sha2(text, 256) as before", "length(text) as n_before").join(
        restored.selectExpr("doc_id", "sha2(text, 256) as after", "length(text) as n_after"), "doc_id", "full"
    )
    return pairs.where("not before <=> after").select("doc_id", "n_before", "n_after")


def inconsistent_mappings(registry: DataFrame) -> DataFrame:
    """Values with more than one token and tokens with more than one value, per case."""
    by_value = registry.groupBy("case_id", F.col("raw_value").alias("item")).agg(
        F.countDistinct("token").alias("n")
    ).withColumn("kind", F.lit("value"))
    by_token = registry.groupBy("case_id", F.col("token").alias("item")).agg(
        F.countDistinct("raw_value").alias("n")
    ).withColumn("kind", F.lit("token"))
    return by_value.unionByName(by_token).where("n > 1")
