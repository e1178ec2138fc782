"""Expression fragments on text: marking of matches, offsets, checks and case forms.

Every function takes and returns SQL text for ``F.expr`` and ``selectExpr``. One parse in the JVM is much
cheaper to build than hundreds of nested column calls, and Catalyst sees the same built-in functions.
"""

from __future__ import annotations

# A control character keeps texts in one byte a character; Unicode noncharacters are never assigned, so a free one
# exists in any real text.
_MARKS = [chr(1), *(chr(0xFDD0 + i) for i in range(32))]
_BLOCK = 64


def q(s: str) -> str:
    """SQL literal of a Python string."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(x: str, values: list) -> str:
    items = ", ".join(q(v) if isinstance(v, str) else str(v) for v in values)
    return f"({x}) in ({items})"


def free_mark(text: str = "text") -> str:
    """A one-character mark that does not occur in ``text``; null for a null text."""
    cases = " ".join(f"when not contains({text}, {q(c)}) then {q(c)}" for c in _MARKS)
    return f"case when {text} is null then null {cases} else raise_error('text holds all marks, U+0001 and 32 noncharacters') end"


def marked_parts(text: str, pattern: str, mark: str) -> str:
    """Split ``text`` at the second group of ``(before)(value)(after)``; ``pattern`` is SQL.

    Result: gap, value, gap, value, …, gap. Joining the parts gives the text back.
    """
    return f"split(regexp_replace({text}, {pattern}, concat('$1', {mark}, '$2', {mark}, '$3')), {mark})"


def _running(values: str, kind: str = "int", step: str = "acc.s + x") -> str:
    return (
        f"aggregate({values}, named_struct('s', cast(0 as {kind}), 'a', cast(array() as array<{kind}>)), "
        f"(acc, x) -> named_struct('s', {step}, 'a', concat(acc.a, array({step})))).a"
    )


def _blockwise(arr: str, kind: str, step: str, join: str) -> str:
    """Running values of an array in blocks, so that long arrays stay near linear (an accumulated array is copied)."""
    blocks = (
        f"transform(sequence(0, cast(ceil(size({arr}) / {_BLOCK}) as int) - 1), "
        f"b -> {_running(f'slice({arr}, b * {_BLOCK} + 1, {_BLOCK})', kind, step)})"
    )
    offsets = _running("transform(bs, blk -> element_at(blk, -1))", kind, step)
    joined = f"flatten(transform(bs, (blk, b) -> transform(blk, x -> if(b = 0, x, {join.format(x='x', y='get(offs, b - 1)')}))))"
    blocked = f"get(transform(array({blocks}), bs -> get(transform(array({offsets}), offs -> {joined}), 0)), 0)"
    return f"if(size({arr}) <= {_BLOCK}, {_running(arr, kind, step)}, {blocked})"


def running_sum(arr: str) -> str:
    """Running sum of an int array."""
    return _blockwise(arr, "int", "acc.s + x", "{x} + {y}")


def running_max(arr: str) -> str:
    """Running maximum of an array of longs above 0."""
    return _blockwise(arr, "bigint", "greatest(acc.s, x)", "greatest({x}, {y})")


def value_ends(parts: str) -> str:
    """End offset of every marked value (the last entry is the end of the text)."""
    steps = (
        f"transform(sequence(1, size({parts}), 2), "
        f"i -> length(get({parts}, i - 1)) + coalesce(length(get({parts}, i)), 0))"
    )
    return f"get(transform(array({steps}), ls -> {running_sum('ls')}), 0)"


def capitalised(s: str) -> str:
    """First character upper, all others lower."""
    return f"concat(upper(left({s}, 1)), lower(substring({s}, 2)))"


def case_variant(s: str) -> str:
    """The second spelling under which a value is also replaced, or null."""
    first = f"left({s}, 1)"
    return (
        f"case when lower({first}) = upper({first}) then null "
        f"when {first} = lower({first}) then {capitalised(s)} "
        f"when not ({s} = upper({s}) and {s} <> lower({s})) then lower({s}) end"
    )


def regex_quote(s: str) -> str:
    """Escape the ASCII punctuation of ``s`` for use inside a pattern."""
    klass = q(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return f"regexp_replace({s}, {klass}, {q(chr(92) * 2 + '$0')})"


def digit_count(s: str) -> str:
    return f"length(regexp_replace({s}, {q('(?U)' + chr(92) + 'D')}, ''))"


def shannon_entropy(s: str) -> str:
    """Bits per character."""
    share = f"(length({s}) - length(replace({s}, c, ''))) / length({s})"
    return (
        f"aggregate(array_distinct(filter(split({s}, ''), c -> c <> '')), 0.0D, "
        f"(acc, c) -> acc - ({share}) * log2({share}))"
    )


def iban_valid(s: str) -> str:
    """Length 15 to 34 and checksum 1 modulo 97, blanks ignored."""
    clean = f"upper(replace({s}, ' ', ''))"
    turned = f"concat(substring({clean}, 5), left({clean}, 4))"
    rest = (
        f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (acc, c) -> "
        "if(c between '0' and '9', (acc * 10 + ascii(c) - 48) % 97, (acc * 100 + ascii(c) - 55) % 97))"
    )
    return f"(length({clean}) between 15 and 34 and {clean} rlike '^[0-9A-Z]+$' and {rest} = 1)"


def email_local(s: str) -> str:
    return f"split_part({s}, '@', 1)"


def after_first_at(s: str) -> str:
    """Text after the first ``@``, or null."""
    return f"if(contains({s}, '@'), substring({s}, instr({s}, '@') + 1), null)"


def name_parts(s: str) -> str:
    """Lower-cased parts of a user name."""
    return f"split(lower({s}), '[._-]')"


def normal_domain(s: str) -> str:
    """Domain as stored in the allowlist: lower case, no leading ``@``, trimmed."""
    return f"trim(regexp_replace(lower({s}), '^@+', ''))"


def shortened(s: str, limit: int = 40) -> str:
    return f"if(length({s}) > {limit}, concat(left({s}, {limit - 3}), '...'), {s})"
