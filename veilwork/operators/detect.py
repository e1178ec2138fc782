"""Detection: documents to a span table."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import digit_count, iban_valid, in_list, q, running_max, shannon_entropy
from ..rules import DECLARED_TYPE, DETECTORS, PROTECTED_PIECE, PROTECTED_RULES, RULES, Rule
from .spans import BEST_FIRST, chosen_in_row, keep_by_island, span_array, with_islands, with_mark

PROTECTED_ID = 1000
_DET_ORD = {name: i for i, name in enumerate(DETECTORS)}

SPAN_COLUMNS = [
    "doc_id", "ord", "start", "end", "raw_value", "pii_type", "confidence", "det_ord", "rule_ord",
]


def pick_rules(
    detectors: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    compat: bool = False,
) -> list[Rule]:
    """Rules to run. Types outside the filter are pruned here, before any text is read.

    ``compat`` also drops whole detectors by their declared type.
    """
    rules = [r for r in RULES if detectors is None or r.detector in detectors]
    if compat:
        rules = [r for r in rules if not include or DECLARED_TYPE[r.detector] in include]
        rules = [r for r in rules if not exclude or DECLARED_TYPE[r.detector] not in exclude]
    rules = [r for r in rules if not include or r.pii_type in include]
    return [r for r in rules if not exclude or r.pii_type not in exclude]


def _ids(rules: list[Rule], detector: str) -> list[int]:
    return [i for i, r in enumerate(rules) if r.detector == detector]


def _trimmed(rules: list[Rule], compat: bool, at: str = "") -> dict[str, str]:
    """Start, end, value and context without stray blanks or separators in the value; ``at`` stands before each field."""
    right = [i for i, r in enumerate(rules) if r.trim == "right"]
    both = [i for i, r in enumerate(rules) if r.trim == "both"]
    rule, raw = f"{at}rule", f"{at}raw_value"
    start, end, value, left_ctx, right_ctx = f"{at}start", f"{at}end", raw, f"{at}left_ctx", f"{at}right_ctx"
    if both:
        lead, tail = (f"length(regexp_extract({raw}, {q(p)}, 0))" for p in (r"(?U)^\s+", r"(?U)\s+$"))
        cut = in_list(rule, both) if len(both) < len(rules) else "true"
        if not compat:
            end = f"if({cut}, greatest({start} + {lead}, {end} - {tail}), {end})"
            start = f"if({cut}, {start} + {lead}, {start})"
            left_ctx = f"if({cut}, concat({left_ctx}, left({raw}, {lead})), {left_ctx})"
            right_ctx = f"if({cut}, concat(right({raw}, {tail}), {right_ctx}), {right_ctx})"
        strip = q(r"(?U)^\s+|\s+$")
        value = f"if({cut}, regexp_replace({raw}, {strip}, ''), {raw})"
    if right and not compat:
        cut = in_list(rule, right) if len(right) < len(rules) else "true"
        tail = f"regexp_extract({raw}, {q(r'(?U)[\s.-]+$')}, 0)"
        right_ctx = f"if({cut}, concat({tail}, {at}right_ctx), {right_ctx})"
        end = f"if({cut}, {at}end - length({tail}), {end})"
        value = f"if({cut}, left({raw}, length({raw}) - length({tail})), {value})"
    return {"start": start, "end": end, "raw_value": value, "left_ctx": left_ctx, "right_ctx": right_ctx}


def _valid(rules: list[Rule], min_entropy: float, at: str = "") -> str:
    """Per-detector checks on the value and on the text before it."""
    rule, value, left_ctx = f"{at}rule", f"{at}raw_value", f"{at}left_ctx"
    low = f"lower({value})"
    handle = f"regexp_replace({low}, {q(r'^(?:@|u/)|#[0-9]{4}$')}, '')"
    suffix = f"substring({value}, instr({value}, '-') + 1)"
    all_digits = q(r"(?U)^\d+$")
    checks = {
        "phone": f"{digit_count(value)} between 7 and 15 "
        f"and not right({left_ctx}, 30) rlike {q(fixed.PHONE_STOP_CONTEXT)}",
        "iban": iban_valid(value),
        "apikey": f"length({value}) >= 20 and not {left_ctx} rlike {q(fixed.HASH_CONTEXT)} "
        f"and {shannon_entropy(value)} >= {float(min_entropy)}D",
        "filepath": f"not {in_list(low, fixed.SYSTEM_ACCOUNTS)}",
        "hostname": f"not ({value} rlike '(?i)^[A-Z]+-[A-Z0-9]{{6,}}$' and {suffix} rlike '^[A-Z0-9]{{7,}}$' "
        f"and {suffix} rlike '[A-Z]')",
        "username": f"not {in_list(low, fixed.USERNAME_STOP)} and {value} rlike '[._-]'",
        "social": f"not {in_list(handle, fixed.HANDLE_STOP)} and length({handle}) >= 2 "
        f"and not {handle} rlike {all_digits}",
        "fieldlabel": f"not {in_list(low, fixed.LABEL_STOP)} and length({value}) >= 3 "
        f"and not {value} rlike {all_digits}",
        "provider_export": f"not {in_list(low, fixed.EXPORT_STOP)}",
    }
    detectors = {r.detector for r in rules}
    if len(detectors) == 1:
        return checks.get(*detectors, "true")
    cases = " ".join(
        f"when {in_list(rule, _ids(rules, d))} then {check}" for d, check in checks.items() if _ids(rules, d)
    )
    return f"case {cases} else true end" if cases else "true"


def _per_rule(rules: list[Rule], values: list, rule: str = "rule") -> str:
    if len(set(values)) == 1:
        return q(values[0]) if isinstance(values[0], str) else f"{values[0]}D" if isinstance(values[0], float) else str(values[0])
    items = ", ".join(q(v) if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v) for v in values)
    return f"get(array({items}), {rule})"


def _confidence(rules: list[Rule], at: str = "") -> str:
    confidence = _per_rule(rules, [r.confidence for r in rules], f"{at}rule")
    keys = _ids(rules, "apikey")
    if keys:
        every = "true" if len(keys) == len(rules) else in_list(f"{at}rule", keys)
        confidence = f"if({every} and {at}left_ctx rlike {q(fixed.KEY_CONTEXT)}, 0.95D, {confidence})"
    return confidence


def _own(rules: list[Rule], context: bool) -> str:
    """All matches of the rules in one text; without ``context`` only the rules that look at the text around have it."""
    return span_array(rules, context=context or _ids(rules, "phone") + _ids(rules, "apikey"))


def _tech() -> str:
    """All technical patterns of one text, without values."""
    return span_array(PROTECTED_RULES, first_id=PROTECTED_ID, context=False)


def _arrays(rules: list[Rule], protect: bool, tech_everywhere: bool) -> str:
    """All matches of one text."""
    own, tech = _own(rules, True), _tech()
    if not protect:
        return own
    if tech_everywhere:
        return f"concat({own}, {tech})"
    return f"get(transform(array({own}), pii -> if(size(pii) = 0, pii, concat(pii, {tech}))), 0)"


def _matches(
    docs: DataFrame, rules: list[Rule], protect: bool, min_entropy: float, compat: bool, tech_everywhere: bool = False
) -> DataFrame:
    """Valid matches of all rules in one pass over the text.

    With ``protect`` there are also rows for technical patterns (``rule_ord`` from ``PROTECTED_ID``).
    They only matter in texts that hold a candidate, so other texts give none unless ``tech_everywhere``.
    """
    arrays = _arrays(rules, protect, tech_everywhere)
    marked = with_mark(docs, ["doc_id", "ord"])
    spans = marked.selectExpr("doc_id", "ord", f"inline({arrays})")
    trimmed = _trimmed(rules, compat)
    spans = spans.selectExpr(
        "doc_id", "ord", "rule", *(f"{sql} as {c}" for c, sql in trimmed.items())
    ).where(f"rule >= {PROTECTED_ID} or ({_valid(rules, min_entropy)})")
    return spans.selectExpr(
        "doc_id",
        "ord",
        "start",
        "end",
        "raw_value",
        f"{_per_rule(rules, [r.pii_type for r in rules])} as pii_type",
        f"{_confidence(rules)} as confidence",
        f"{_per_rule(rules, [_DET_ORD.get(r.detector, len(DETECTORS)) for r in rules])} as det_ord",
        "rule as rule_ord",
        "left_ctx",
        "right_ctx",
    )


def candidate_spans(
    docs: DataFrame, rules: list[Rule], *, min_entropy: float = 3.5, compat: bool = False
) -> DataFrame:
    """Valid matches of the given rules, before the detectors are weighed against each other."""
    phones = len(_ids(rules, "phone")) > 1
    if compat and _ids(rules, "social"):
        spans = _matches(docs, rules, False, min_entropy, compat)
        if phones:
            flagged = spans.withColumn("_phone", F.expr(f"det_ord = {_PHONE}"))
            islands = with_islands(flagged, ["doc_id", "_phone"])
            spans = keep_by_island(islands, ["doc_id", "_phone"], _PHONES_IN_ORDER).drop("_phone")
        return hide_seen_handles(spans, rules)
    if not phones:
        return _matches(docs, rules, False, min_entropy, compat)
    rows = _sorted_spans(docs, rules, False, min_entropy, compat, True)
    split = rows.selectExpr("*", f"filter(_v, x -> x.det_ord = {_PHONE}) as _c", f"filter(_v, x -> x.det_ord <> {_PHONE}) as _o")
    return _placed(split, rules, f"concat(_o, {chosen_in_row('_c', [_PHONES_IN_ORDER])})")


def _shaped(rules: list[Rule], compat: bool, first: int, det_ord: str) -> str:
    """SQL struct of one found span ``s`` of the rules, which start at number ``first``."""
    cut = _trimmed(rules, compat, "s.")
    number = f"s.rule + {first}" if first else "s.rule"
    return (
        f"named_struct('start', {cut['start']}, 'is_pii', {str(first < PROTECTED_ID).lower()}, 'end', {cut['end']}, 'rule', {number}, "
        f"'rule_ord', {number}, 'det_ord', {det_ord}, 'raw_value', {cut['raw_value']}, 'confidence', {_confidence(rules, 's.')}, "
        f"'left_ctx', {cut['left_ctx']}, 'right_ctx', {cut['right_ctx']}, 'reached', false)"
    )


def _valid_spans(rules: list[Rule], min_entropy: float, compat: bool, context: bool) -> str:
    """SQL array of the valid matches of one text, detector by detector: these share trimming, checks and context."""
    arrays, first = [], 0
    for detector, same in groupby(rules, key=lambda r: r.detector):
        same = list(same)
        spans = span_array(same, context=context or ([] if detector not in ("phone", "apikey") else True))
        shaped = f"transform({spans}, s -> {_shaped(same, compat, first, str(_DET_ORD.get(detector, len(DETECTORS))))})"
        check = _valid(same, min_entropy, "s.")
        arrays.append(shaped if check == "true" else f"filter({shaped}, s -> {check})")
        first += len(same)
    return f"flatten(array({', '.join(arrays)}))"


def _sorted_spans(
    docs: DataFrame, rules: list[Rule], protect: bool, min_entropy: float, compat: bool, context: bool
) -> DataFrame:
    """``doc_id, ord, _v``: the valid matches of each text in the order of their starts, technical ones first.

    Technical patterns are searched only in texts of which a valid value looks like a piece of one.
    """
    marked = with_mark(docs, ["doc_id", "ord"])
    valid = _valid_spans(rules, min_entropy, compat, context)
    if not protect:
        return marked.selectExpr("doc_id", "ord", f"sort_array({valid}) as _v")
    near = f"exists(p, s -> s.raw_value rlike {q(PROTECTED_PIECE)})"
    tech = span_array(PROTECTED_RULES, context=False)
    shaped = (
        f"transform({tech}, s -> named_struct('start', s.start, 'is_pii', false, 'end', s.end, 'rule', s.rule + {PROTECTED_ID}, "
        f"'rule_ord', s.rule + {PROTECTED_ID}, 'det_ord', {len(DETECTORS)}, 'raw_value', s.raw_value, 'confidence', 1.0D, "
        "'left_ctx', s.left_ctx, 'right_ctx', s.right_ctx, 'reached', false))"
    )
    both = f"get(transform(array({valid}), p -> sort_array(if({near}, concat(p, {shaped}), p))), 0)"
    return marked.selectExpr("doc_id", "ord", f"{both} as _v")


def _placed(rows: DataFrame, rules: list[Rule], chosen: str, more: list[str] | None = None) -> DataFrame:
    """One row for each span of an array, with the columns of a span table and ``more`` of the struct or row."""
    kept = more or []
    return rows.selectExpr("doc_id", "ord", *[c for c in kept if c in rows.columns], f"inline({chosen})").selectExpr(
        "doc_id", "ord", "start", "end", "raw_value", f"{_per_rule(rules, [r.pii_type for r in rules])} as pii_type",
        "confidence", "det_ord", "rule_ord", "left_ctx", "right_ctx", *kept,
    )


def _settled(
    docs: DataFrame, rules: list[Rule], protect: bool, min_entropy: float, compat: bool, context: bool
) -> DataFrame:
    """Non-overlapping spans of each text, settled next to the text without a shuffle; as ``detect`` gives them."""
    rounds = [_PHONES_IN_ORDER, BEST_FIRST] if len(_ids(rules, "phone")) > 1 else [BEST_FIRST]
    rows = _sorted_spans(docs, rules, protect, min_entropy, compat, context)
    if not protect:
        return _placed(rows, rules, chosen_in_row("_v", rounds))
    ends = "transform(_v, x -> if(x.is_pii, 0L, cast(x.end as bigint)))"
    kinds = f"aggregate(_v, 0, (a, x) -> if(x.is_pii, a, a | shiftleft(1, x.rule - {PROTECTED_ID})))"
    reach = f"get(transform(array({ends}), e -> {running_max('e')}), 0)"
    within = "coalesce(get(reach, i) > 0 and get(reach, i) >= x.end, false)"
    fields = ("start", "is_pii", "end", "rule", "rule_ord", "det_ord", "raw_value", "confidence", "left_ctx", "right_ctx")
    marked = f"transform(_v, (x, i) -> named_struct({', '.join(f"'{c}', x.{c}" for c in fields)}, 'reached', {within}))"
    pii = f"filter(get(transform(array({reach}), reach -> {marked}), 0), x -> x.is_pii)"
    # most texts have no technical span
    some = "exists(_v, x -> not x.is_pii)"
    rows = rows.selectExpr("doc_id", "ord", f"if({some}, {kinds}, 0) as kinds", f"if({some}, {pii}, _v) as _c")
    flat = _placed(rows, rules, chosen_in_row("_c", rounds), ["reached", "kinds"])
    return flat.where(f"not (reached or {_whole()})").drop("reached", "kinds")


def _whole() -> str:
    """A value that is a technical pattern as a whole, of a kind that occurs in the document."""
    return "(" + " or ".join(
        f"(kinds & {1 << i} <> 0 and raw_value rlike {q(rf'(?{r.flags})^(?:{r.value})$')})"
        for i, r in enumerate(PROTECTED_RULES)
    ) + ")"


# phone families in order: a match is skipped when its start or end lies in an accepted one
_PHONE = DETECTORS.index("phone")
_PHONES_IN_ORDER = (
    ["s.rule_ord", "s.start"],
    f"s.det_ord = {_PHONE} and a.det_ord = {_PHONE} and ((a.start <= s.start and s.start < a.end) "
    "or (a.start < s.end and s.end <= a.end))",
)


def with_cover(spans: DataFrame) -> DataFrame:
    """Mark spans inside a technical span: one running maximum per document instead of a range join.

    A span is inside some technical span exactly if the farthest end among technical spans that start
    no later reaches its own end. A value that is a technical pattern as a whole is covered too, if that
    pattern occurs in the document. Window frames by value take spans with an equal start together.
    """
    is_tech = f"rule_ord >= {PROTECTED_ID}"
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everywhere = doc.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        spans.withColumns(
            {
                "_reach": F.max(F.expr(f"if({is_tech}, end, null)")).over(upto),
                "kinds": F.bit_or(F.expr(f"if({is_tech}, shiftleft(1, rule_ord - {PROTECTED_ID}), 0)")).over(everywhere),
            }
        )
        .withColumn("covered", F.expr(f"not ({is_tech}) and (coalesce(_reach >= end, false) or {_whole()})"))
        .drop("_reach", "kinds")
    )


def hide_seen_handles(spans: DataFrame, rules: list[Rule]) -> DataFrame:
    """Compat: only ``@`` handles repeat; any other handle shows once and not if seen before."""
    social = f"det_ord = {DETECTORS.index('social')}"
    at_ids = [i for i, r in enumerate(rules) if r.detector == "social" and r.name == "at_handle"]
    seen = f"if({social}, regexp_replace(lower(raw_value), '^(?:@|u/)', ''), null)"
    order = Window.partitionBy("doc_id", "_seen").orderBy("rule_ord", "start")
    return (
        spans.withColumn("_seen", F.expr(seen))
        .withColumn("_rn", F.row_number().over(order))
        .where(f"not ({social}) or _rn = 1" + (f" or {in_list('rule_ord', at_ids)}" if at_ids else ""))
        .drop("_seen", "_rn")
    )


def detect(
    docs: DataFrame,
    *,
    detectors: list[str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    protect: bool = False,
    min_entropy: float = 3.5,
    extra_spans: DataFrame | None = None,
    compat: bool = False,
    context: bool = True,
) -> DataFrame:
    """Non-overlapping spans of ``docs(doc_id, ord, text)``.

    Without ``context`` the columns ``left_ctx`` and ``right_ctx`` are only filled where a rule looks at them.
    ``extra_spans`` are spans from dictionaries or from own rules; they join the overlap resolution.
    With ``protect`` the spans under built-in protection are dropped after overlaps are settled.
    """
    rules = pick_rules(detectors, include, exclude, compat)
    if rules and extra_spans is None and not (compat and _ids(rules, "social")):
        return _settled(docs, rules, protect, min_entropy, compat, context)
    spans = None
    if rules:
        spans = _matches(docs, rules, protect, min_entropy, compat, tech_everywhere=extra_spans is not None)
        if compat and _ids(rules, "social"):
            spans = hide_seen_handles(spans, rules)
    if extra_spans is not None:
        wanted = extra_spans
        if include:
            wanted = wanted.where(F.col("pii_type").isin(include))
        if exclude:
            wanted = wanted.where(~F.col("pii_type").isin(exclude))
        spans = wanted if spans is None else spans.unionByName(wanted, allowMissingColumns=True)
    if spans is None:
        raise ValueError("the type filter leaves no detector")
    # one shuffle and one sort by document serve the cover, the islands and the choice
    covered = with_cover(spans) if protect else spans
    islands = with_islands(covered, ["doc_id"], f"rule_ord < {PROTECTED_ID}")
    rounds = [_PHONES_IN_ORDER] if len(_ids(rules, "phone")) > 1 else []
    kept = keep_by_island(islands, ["doc_id"], *rounds, BEST_FIRST)
    return kept.where("not covered").drop("covered") if protect else kept


def custom_spans(docs: DataFrame, rules: list[Rule], keep: str = "true") -> DataFrame:
    """Spans of own rules, for ``extra_spans`` of ``detect``; ``keep`` is an SQL test on ``raw_value``.

    Own rules come after the built-in detectors when equal spans are compared.
    """
    return _matches(docs, rules, False, 3.5, False).where(keep)
