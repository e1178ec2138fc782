"""Span extraction and overlap resolution.

Extraction is a narrow job: every match of every rule is found and placed inside its row, and only valid
spans reach a shuffle. Overlaps are settled per cluster of touching spans (an island).
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import free_mark, in_list, marked_parts, q, running_max, value_ends
from ..rules import Rule

SPAN = "struct<rule:int,start:int,end:int,raw_value:string,left_ctx:string,right_ctx:string>"
# pieces that surely hold 50 characters: a match and the gap before it have one character at least
_CTX_PIECES = 100
_LEFT, _RIGHT = 50, 20


_LONG_RUN = "[A-Za-z0-9+/]{32}"
#: Overlapping spans up to which all are compared with all accepted ones.
_SMALL_ISLAND = 256


def _parts(rule: Rule, text: str, mark: str) -> str:
    """Marked parts, or null when the rule has no match."""
    new = f"concat({mark}, '$0', {mark})" if rule.plain else f"concat('$1', {mark}, '$2', {mark}, '$3')"
    marked = f"regexp_replace({text}, {q(rule.pattern)}, {new})"
    return f"get(transform(array({marked}), m -> if(contains(m, {mark}), split(m, {mark}), null)), 0)"


def _literals(column: str, groups: tuple[tuple[str, ...], ...]) -> list[str]:
    return [" or ".join(f"contains({column}, {q(s)})" for s in group) for group in groups if "" not in group]


def _found(rules: list[Rule], text: str, mark: str) -> str:
    """SQL array of the parts of every rule.

    The literals a rule needs are looked for first, so most texts never meet the pattern. Neighbouring rules that need
    the same literals share the test; ``_long`` is a column of the text row.
    """
    return _tested(rules, text, mark, [
        lambda r: _literals("_low", (r.all_need,)) if r.all_need else [],
        lambda r: _literals("_low", r.low_needs),
        lambda r: _literals(text, r.needs) + (["_long"] if r.long_run else []),
    ])


def _tested(rules: list[Rule], text: str, mark: str, tests: list) -> str:
    if not tests:
        return f"array({', '.join(_parts(r, text, mark) for r in rules)})"
    groups = []
    for checks, same in groupby(rules, key=tests[0]):
        same = list(same)
        found = _tested(same, text, mark, tests[1:])
        if checks:
            nothing = f"array({', '.join(['cast(null as array<string>)'] * len(same))})"
            found = f"if({' and '.join(f'({c})' for c in checks)}, {found}, {nothing})"
        groups.append(found)
    return groups[0] if len(groups) == 1 else f"flatten(array({', '.join(groups)}))"


def with_mark(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, the text and what the rules need next to it."""
    return docs.selectExpr(
        *keep,
        "text",
        f"{free_mark()} as _mark",
        f"replace(lower(text), {q(chr(0x17F))}, 's') as _low",
        f"text rlike {q(_LONG_RUN)} as _long",
    )


def span_at(parts: str, rule: str, context: bool | list[int] = True, i: str = "i", end: str = "get(ends, i - 1)") -> str:
    """The ``i``-th marked value of a text as a span; ``ends`` are those of ``value_ends``.

    ``context`` says which spans have the text around them: all, none (these have no value either) or those of a
    list of rules.
    """
    value = f"get({parts}, 2 * {i} - 1)"
    first = f"greatest(1, 2 * {i} - 1 - {_CTX_PIECES})"
    # mostly the gap next to the value is long enough
    left = (
        f"right(if(length(get({parts}, 2 * {i} - 2)) >= {_LEFT}, get({parts}, 2 * {i} - 2), "
        f"array_join(slice({parts}, {first}, 2 * {i} - {first}), '')), {_LEFT})"
    )
    right = (
        f"left(if(length(get({parts}, 2 * {i})) >= {_RIGHT}, get({parts}, 2 * {i}), "
        f"array_join(slice({parts}, 2 * {i} + 1, {_CTX_PIECES}), '')), {_RIGHT})"
    )
    if context is False:
        value_out, left, right = "cast(null as string)", "cast(null as string)", "cast(null as string)"
    else:
        value_out = value
        if context is not True:
            wanted = in_list(rule, context) if context else "false"
            left, right = f"if({wanted}, {left}, null)", f"if({wanted}, {right}, null)"
    return (
        f"named_struct('rule', cast({rule} as int), 'start', {end} - length({value}), 'end', {end}, "
        f"'raw_value', {value_out}, 'left_ctx', {left}, 'right_ctx', {right})"
    )


def placed_spans(parts: str, rule: str, context: bool | list[int] = True) -> str:
    """Array of spans of one marked text; ``context`` as in ``span_at``. Most texts hold one value of a rule."""
    one = span_at(parts, rule, context)
    spans = f"transform(sequence(1, cast(size({parts}) div 2 as int)), i -> {one})"
    only = span_at(parts, rule, context, "1", f"(length(get({parts}, 0)) + length(get({parts}, 1)))")
    return (
        f"case when size({parts}) = 3 then array({only}) "
        f"when size({parts}) > 1 then get(transform(array({value_ends(parts)}), ends -> {spans}), 0) "
        f"else cast(array() as array<{SPAN}>) end"
    )


def span_array(
    rules: list[Rule], text: str = "text", mark: str = "_mark", first_id: int = 0, context: bool | list[int] = True
) -> str:
    """All spans of ``rules`` in one array; ``rule`` is the place in the list plus ``first_id``."""
    found = _found(rules, text, mark)
    return f"flatten(transform({found}, (p, r) -> {placed_spans('p', f'r + {first_id}', context)}))"


def span_rows(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """One row per match: the ``keep`` columns of ``docs`` plus the span fields."""
    marked = with_mark(docs, keep)
    return marked.selectExpr(*keep, f"inline({span_array(rules)})")


def with_islands(spans: DataFrame, by: list[str], pii: str = "true") -> DataFrame:
    """Number clusters of overlapping spans inside each ``by`` group; rows that are not ``pii`` are left out."""
    order = Window.partitionBy(*by).orderBy("start")
    reach = F.max(F.expr(f"if({pii}, end, null)")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.select("*", reach.alias("_reach"))
        .where(pii)
        .select("*", F.sum(F.expr("if(_reach is null or start >= _reach, 1, 0)")).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_island"))
        .drop("_reach")
    )


def _greedy(spans: str, priority: list[str], clash: str) -> str:
    """SQL: the spans of an array accepted by ``priority`` unless they ``clash`` with an accepted one.

    A large array is laid out in about as many cells of text as the root of its size. Spans that clash overlap, so
    they share a cell, and a span is compared with the accepted spans of its own cells only.
    """
    key = ", ".join(f"'k{i}', {p}" for i, p in enumerate(priority))
    ranked = (
        f"transform(array_sort(transform({spans}, s -> named_struct('k', named_struct({key}), 's', s))), x -> x.s)"
    )
    fold = (
        "aggregate(r, filter(r, s -> false), "
        f"(acc, s) -> if(exists(acc, a -> {clash}), acc, concat(acc, array(s))))"
    )
    size = (
        "named_struct('lo', array_min(transform(r, s -> s.start)), 'n', cast(ceil(sqrt(size(r))) as int), 'w', "
        "greatest(1, cast(ceil((array_max(transform(r, s -> s.end)) - array_min(transform(r, s -> s.start))) / ceil(sqrt(size(r)))) as int)))"
    )
    first, last = "cast(({x}.start - z.lo) div z.w as int)", "cast((greatest({x}.end - 1, {x}.start) - z.lo) div z.w as int)"
    c0, c1 = first.format(x="s"), last.format(x="s")
    cells = (
        f"aggregate(r, transform(sequence(0, z.n), i -> filter(r, s -> false)), (acc, s) -> "
        f"if(exists(slice(acc, {c0} + 1, {c1} - {c0} + 1), b -> exists(b, a -> {clash})), acc, "
        f"transform(acc, (b, i) -> if(i between {c0} and {c1}, concat(b, array(s)), b))), "
        # a span of several cells comes out of its first
        f"acc -> flatten(transform(acc, (b, i) -> filter(b, a -> {first.format(x='a')} = i))))"
    )
    large = f"get(transform(array({size}), z -> {cells}), 0)"
    return f"get(transform(array({ranked}), r -> if(size(r) <= {_SMALL_ISLAND}, {fold}, {large})), 0)"


def keep_by_island(spans: DataFrame, by: list[str], *rounds: tuple[list[str], str]) -> DataFrame:
    """Accept spans greedily, one round after the other; ``spans`` carry ``_island``.

    A round is ``(priority, clash)``, SQL on ``s`` (the span) and ``a`` (an accepted span). Only
    overlapping spans can clash, so the greedy choice runs inside one island at a time.
    """
    cols = [c for c in spans.columns if c not in by and c != "_island"]
    grouped = spans.groupBy(*by, "_island").agg(F.collect_list(F.struct(*cols)).alias("_c"))
    chosen = "_c"
    for priority, clash in rounds:
        chosen = _greedy(chosen, priority, clash)
    return grouped.selectExpr(*by, f"inline(if(size(_c) = 1, _c, {chosen}))").select(
        *[c for c in spans.columns if c != "_island"]
    )


def chosen_in_row(spans: str, rounds: list[tuple[list[str], str]]) -> str:
    """SQL: the spans of one text that ``keep_by_island`` would accept, without a shuffle.

    ``spans`` is the name of an array of them in the order of their starts. It is cut into islands where all earlier
    spans have ended, so long arrays stay near linear.
    """
    reach = f"get(transform(array(transform({spans}, x -> cast(x.end as bigint))), e -> {running_max('e')}), 0)"
    cuts = f"filter(sequence(0, size({spans}) - 1), i -> i = 0 or get({spans}, i).start >= get(reach, i - 1))"
    chosen = "one"
    for priority, clash in rounds:
        chosen = _greedy(chosen, priority, clash)
    island = f"slice({spans}, c + 1, coalesce(get(cuts, j + 1), size({spans})) - c)"
    islands = f"flatten(transform(cuts, (c, j) -> get(transform(array({island}), one -> if(size(one) = 1, one, {chosen})), 0)))"
    whole = f"get(transform(array({reach}), reach -> get(transform(array({cuts}), cuts -> {islands}), 0)), 0)"
    apart = f"not exists(sequence(1, size({spans}) - 1), i -> get({spans}, i).start < get({spans}, i - 1).end)"
    return f"if(size({spans}) <= 1, {spans}, if({apart}, {spans}, {whole}))"


BEST_FIRST = (
    ["s.start - s.end", "-s.confidence", "s.start", "s.det_ord", "s.rule_ord"],
    "a.start < s.end and s.start < a.end",
)


def resolve_overlaps(spans: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Longer first, then higher confidence, earlier start and detector order; no shared character."""
    return keep_by_island(with_islands(spans, [doc_key]), [doc_key], BEST_FIRST)
