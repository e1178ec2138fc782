"""Corpus dictionary match: find every entry of a large dictionary in every document.

Word characters are ASCII letters, digits and ``_``. A hit starts at the start of a word or at a
non-word character, and a non-word character or the end follows it. Hits are leftmost-longest.

Plan: a text is cut into gaps and words, gap, word, gap, … An entry is looked up by its rarest key, a word or a pair
of neighbouring words with what stands between them, as a 64-bit hash, and knows at which of its words that key
stands. The words of the documents are tested against a bit filter of all keys where they are made; the few that
pass are joined with the entries, each with its place. A place and the key's offset give the one place where the
entry can stand, and there its words and the ends of its first and last gap are compared. An entry without any such
word (other scripts, signs) lies inside a gap and is looked up by its rarest run of up to ``RUN`` characters.
Hits of a document are sorted once and chosen in one pass; nothing is compared with a whole dictionary, and no
candidate is capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import marked_parts, q, running_max, value_ends
from ..plans.keyfilter import KeyFilter, key_filter
from ..plans.staging import stage
from .spans import with_mark

WORD = "[A-Za-z0-9_]+"
#: Characters of the key of an entry without a word; shorter entries are their own key.
RUN = 6
#: Pieces that surely hold 50 characters (a word and the gap before it have one at least), and context around a hit.
_CTX_PIECES, _LEFT, _RIGHT = 101, 50, 20


def wordless_runs(text: str, n: int) -> str:
    """All runs of ``n`` characters of which none is a word character, found in one pass by a lookahead."""
    return f"regexp_extract_all({text}, {q(f'(?s)(?=([^A-Za-z0-9_]{{{n}}}))')}, 1)"


def _parts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``p``, the text as gap, word, gap, word, …, gap."""
    marked = with_mark(docs.where("text is not null"), keep)
    return marked.selectExpr(*keep, f"{marked_parts('text', q(f'()({WORD})()'), '_mark')} as p")


def entry_keys(entries: DataFrame) -> DataFrame:
    """``variant, _key``: the key under which ``entry_anchors`` puts each entry of these."""
    anchors = entry_anchors(entries.select("variant", F.lit("").alias("_none")), "_none")
    return anchors.selectExpr("concat(lead, core, tail) as variant", "_key")


def entry_anchors(entries: DataFrame, payload: str) -> DataFrame:
    """``entries(variant, payload)`` with the one key under which a document finds them, and its place ``r`` in the entry.

    ``lead`` and ``tail`` are the gaps at the ends, ``core`` is what stands between, ``k`` its number of words.

    The rarest key among all entries is taken, pairs before single words, so that entries which share a
    common word (a mail domain, a country code) do not meet under it.
    """
    cut = _parts(entries.withColumnRenamed("variant", "text").where("text <> ''"), ["text", payload])
    words = "transform(sequence(1, k), i -> struct(i - 1 as r, xxhash64(get(p, 2 * i - 1)) as key))"
    pairs = (
        "if(k > 1, transform(sequence(1, k - 1), i -> struct(i - 1 as r, "
        "xxhash64(get(p, 2 * i - 1), get(p, 2 * i), get(p, 2 * i + 1)) as key)), array())"
    )
    runs = " ".join(
        f"when length(text) {'=' if n < RUN else '>='} {n} then "
        f"transform({wordless_runs('text', n)}, (x, i) -> struct(i as r, xxhash64(x) as key))"
        for n in range(1, RUN + 1)
    )
    shaped = cut.selectExpr("text as variant", payload, "p", "cast(size(p) div 2 as int) as k").selectExpr(
        "variant", payload, "k",
        "if(k > 0, get(p, 0), '') as lead", "if(k > 0, get(p, 2 * k), '') as tail",
        "if(k > 0, array_join(slice(p, 2, 2 * greatest(k, 1) - 1), ''), variant) as core",
    )
    # the generator holds the keys themselves: of a column of them, Spark would test the size below the cutting of the
    # text and cut it anew for every word
    keyed = cut.selectExpr("text", "p", "cast(size(p) div 2 as int) as k")
    flat = keyed.selectExpr("text as variant", f"posexplode(if(k > 0, concat({words}, {pairs}), case {runs} end)) as (_pos, _k)")
    flat = flat.selectExpr("variant", "_pos", "_k.r as r", "_k.key as _key")
    weight = flat.groupBy("_key").count()
    best = (
        flat.join(weight, "_key")
        .groupBy("variant")
        .agg(F.min(F.struct("count", F.expr("-_pos").alias("p"), "_key", "r")).alias("_best"))
    )
    return shaped.join(best.selectExpr("variant", "_best._key as _key", "_best.r as r"), "variant").drop("variant")


def wordless_sizes(entries: DataFrame, column: str = "variant") -> list[int]:
    """Run lengths of the entries without any word (at most ``RUN`` numbers); documents give runs of these only."""
    sizes = entries.where(f"not {column} rlike {q(WORD)} and {column} <> ''")
    return sorted(r.n for r in sizes.selectExpr(f"least(length({column}), {RUN}) as n").distinct().collect())


def _word_places(docs: DataFrame, keys: KeyFilter, words: str) -> DataFrame:
    """``doc_id, i, _key``: words and pairs whose key passes, with the number of their (first) word."""
    zipped = "arrays_zip(p, slice(p, 2, size(p)), slice(p, 3, size(p)))"
    flat = _parts(docs, ["doc_id"]).selectExpr("doc_id", f"posexplode({zipped}) as (at, z)").where("at % 2 = 1")
    flat = flat.where(words.replace("{word}", "z.p"))
    hashed = flat.selectExpr(
        "doc_id", "cast(at div 2 as int) as i", "xxhash64(z.p) as k1", "if(z.`2` is null, null, xxhash64(z.p, z.`1`, z.`2`)) as k2"
    )
    one, two = keys.passes(F.col("k1")), F.col("k2").isNotNull() & keys.passes(F.col("k2"))
    passed = hashed.where(one | two).selectExpr("doc_id", "i", "explode(array(k1, k2)) as _key")
    return passed.where("_key is not null").where(keys.passes(F.col("_key")))


def _run_places(docs: DataFrame, keys: KeyFilter, sizes: list[int]) -> DataFrame:
    """``doc_id, i, o, _key``: runs in the gaps whose key passes, with the number of the gap and the place in it."""
    gaps = _parts(docs, ["doc_id"]).selectExpr("doc_id", "posexplode(transform(p, x -> x)) as (at, gap)")
    gaps = gaps.where(f"at % 2 = 0 and length(gap) >= {sizes[0]}")
    places = None
    for size in sizes:
        runs = gaps.selectExpr("doc_id", "cast(at div 2 as int) as i", f"posexplode({wordless_runs('gap', size)}) as (o, run)")
        places = runs if places is None else places.unionByName(runs)
    return places.selectExpr("doc_id", "i", "o", "xxhash64(run) as _key").where(keys.passes(F.col("_key")))


def candidate_entries(docs: DataFrame, entries: DataFrame, payload: str, words: str = "true") -> DataFrame:
    """``(doc_id, f, k, lead, core, tail, o, payload)``: entries that can start at word (or stand in gap) ``f``.

    ``words`` is a test of ``{word}`` that every key word of the entries passes; other words aren't looked up.
    """
    anchors = stage(entry_anchors(entries, payload), "anchors")
    keys = key_filter(anchors, "_key")
    columns = ["k", "lead", "core", "tail"]
    found = _word_places(docs, keys, words).join(anchors.where("k > 0"), "_key")
    found = found.selectExpr("doc_id", "i - r as f", *columns, "0 as o", payload).where("f >= 0")
    sizes = wordless_sizes(anchors.where("k = 0"), "core")
    if not sizes:
        return found
    runs = _run_places(docs, keys, sizes).join(anchors.where("k = 0"), "_key")
    return found.unionByName(runs.selectExpr("doc_id", "i as f", *columns, "o - r as o", payload).where("o >= 0"))


def text_keys(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``_key``: all distinct keys under which entries may be found in the documents; ``sizes`` as of ``wordless_sizes``."""
    every = KeyFilter(None)
    words = _word_places(docs, every, "true").select("_key")
    return (words.unionByName(_run_places(docs, every, sizes).select("_key")) if sizes else words).distinct()


#: A hit spans from offset ``os`` of gap ``gs`` to offset ``oe`` of gap ``ge``. Its fields are in the order of choice:
#: what starts first, then what ends last.
_LEAD = "if(x.k > 0, length(get(p, 2 * x.f)) - length(x.lead), x.o)"
_TAIL = "if(x.k > 0, length(x.tail), x.o + length(x.core))"
_HIT = f"struct(x.f as gs, {_LEAD} as os, -(x.f + x.k) as ge, -{_TAIL} as oe, concat(x.lead, x.core, x.tail) as value, x.payload as payload)"
_AFTER = "get(p, 2 * (x.f + x.k))"
_WORDS = "if(x.k = 1, get(p, 2 * x.f + 1), array_join(slice(p, 2 * x.f + 2, 2 * x.k - 1), ''))"
_TRUE = (
    f"if(x.k = 0, substring(get(p, 2 * x.f), x.o + 1, length(x.core)) = x.core "
    f"and (x.o + length(x.core) < length(get(p, 2 * x.f)) or x.f = size(p) div 2), "
    f"x.f + x.k <= size(p) div 2 and {_WORDS} = x.core and endswith(get(p, 2 * x.f), x.lead) and (x.tail = '' "
    f"or startswith({_AFTER}, x.tail) and (length({_AFTER}) > length(x.tail) or x.f + x.k = size(p) div 2)))"
)


def _place(gap: str, offset: str) -> str:
    return f"(shiftleft(cast({gap} as bigint), 32) + {offset})"


def _leftmost(hits: str) -> str:
    """Hits in order that start where the one taken before has ended.

    Hits that overlap hang together in islands, cut where all earlier hits have ended; the choice runs inside them.
    """
    start, end = _place("{x}.gs", "{x}.os"), _place("-{x}.ge", "-{x}.oe")
    reach = f"get(transform(array(transform({hits}, x -> {end.format(x='x')})), e -> {running_max('e')}), 0)"
    cuts = f"filter(sequence(0, size({hits}) - 1), i -> i = 0 or {start.format(x=f'get({hits}, i)')} >= get(reach, i - 1))"
    fold = (
        f"aggregate(one, named_struct('e', 0L, 'a', filter(one, x -> false)), (a, x) -> if({start.format(x='x')} < a.e, a, "
        f"named_struct('e', {end.format(x='x')}, 'a', concat(a.a, array(x)))), a -> a.a)"
    )
    island = f"slice({hits}, c + 1, coalesce(get(cuts, j + 1), size({hits})) - c)"
    chosen = f"get(transform(array({island}), one -> if(size(one) = 1, one, {fold})), 0)"
    islands = f"flatten(transform(cuts, (c, j) -> {chosen}))"
    apart = f"not exists(sequence(1, size({hits}) - 1), i -> {start.format(x=f'get({hits}, i)')} < {end.format(x=f'get({hits}, i - 1)')})"
    whole = f"get(transform(array({reach}), reach -> get(transform(array({cuts}), cuts -> {islands}), 0)), 0)"
    return f"if(size({hits}) <= 1, {hits}, if({apart}, {hits}, {whole}))"


def chosen_hits(
    docs: DataFrame, entries: DataFrame, payload: str, keep: list[str], how: str = "inner", texts: str = "true", words: str = "true"
) -> DataFrame:
    """The ``keep`` columns of the documents, ``text``, its parts ``p`` and the chosen hits ``h`` (null without candidates).

    ``texts`` and ``words`` are tests that every text with a hit, and every key word, passes.
    """
    columns = ["f", "k", "lead", "core", "tail", "o", F.col(payload).alias("payload")]
    found = candidate_entries(docs.where(texts), entries, payload, words)
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("c"))
    joined = docs.join(stage(found, "candidates"), "doc_id", how)
    marked = with_mark(joined, [*keep, "c"])
    cut = marked.selectExpr(*keep, "text", "c", f"if(c is null, null, {marked_parts('text', q(f'()({WORD})()'), '_mark')}) as p")
    hits = f"if(c is null, null, sort_array(transform(filter(c, x -> {_TRUE}), x -> {_HIT})))"
    return cut.selectExpr(*keep, "text", "p", f"{hits} as h").selectExpr(*keep, "text", "p", f"if(h is null, null, {_leftmost('h')}) as h")


def hit_rows(docs: DataFrame, entries: DataFrame, payload: str) -> DataFrame:
    """``(doc_id, ord, start, end, raw_value, payload, left_ctx, right_ctx)`` of all hits."""
    first = f"greatest(1, 2 * h.gs + 2 - {_CTX_PIECES})"
    left = f"array_join(slice(p, {first}, 2 * h.gs + 2 - {first}), '')"
    left = f"right(left({left}, length({left}) - length(get(p, 2 * h.gs)) + h.os), {_LEFT})"
    right = f"substring(array_join(slice(p, 1 - 2 * h.ge, {_CTX_PIECES}), ''), 1 - h.oe, {_RIGHT})"
    found = chosen_hits(docs, entries, payload, ["doc_id", "ord"])
    found = found.selectExpr("doc_id", "ord", "p", "h", f"concat(array(0), {value_ends('p')}) as starts")
    one = (
        "h -> struct(get(starts, h.gs) + h.os as start, get(starts, -h.ge) - h.oe as end, h.value as raw_value, "
        f"h.payload as payload, {left} as left_ctx, {right} as right_ctx)"
    )
    return found.selectExpr("doc_id", "ord", f"inline(transform(h, {one}))").withColumnRenamed("payload", payload)


def replace_hits(docs: DataFrame, entries: DataFrame, payload: str, texts: str = "true", words: str = "true") -> DataFrame:
    """``docs`` with every hit replaced by its payload, plus ``n_hits``; ``texts`` and ``words`` as in ``chosen_hits``."""
    keep = [c for c in docs.columns if c not in ("text", "n_hits")]
    found = chosen_hits(docs, entries, payload, keep, "left", texts, words)
    # what stands between the end of the hit before (or the start) and this hit (or the end)
    gap = "array_join(slice(p, 2 * {g0} + 1, 2 * ({g1} - {g0}) + 1), '')"
    before = "get(h, i - 1)"
    g0, o0 = f"if(i = 0, 0, -{before}.ge)", f"if(i = 0, 0, -{before}.oe)"
    own = gap.format(g0=g0, g1="x.gs")
    head = f"transform(array({own}), m -> substring(m, {o0} + 1, length(m) - {o0} - length(get(p, 2 * x.gs)) + x.os))"
    last = "element_at(h, -1)"
    rest = f"substring({gap.format(g0=f'(-{last}.ge)', g1='(size(p) div 2)')}, 1 - {last}.oe)"
    pieces = f"transform(h, (x, i) -> concat(get({head}, 0), x.payload))"
    text = f"if(h is null or size(h) = 0, text, concat(array_join({pieces}, ''), {rest}))"
    hits = "if(h is null, 0L, cast(size(h) as bigint))"
    # made by a generator: a filter on the result stays above it, so nothing is worked out twice
    return found.selectExpr(*keep, f"inline(array(struct({text} as text, {hits} as n_hits)))")
