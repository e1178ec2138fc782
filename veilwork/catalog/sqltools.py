"""Pieces of check SQL (DuckDB)."""

from __future__ import annotations

from .. import fixed


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return ", ".join(lit(v) for v in values)


def flagged(pattern: str) -> str:
    """A fixed pattern for this engine, whose classes need no flag."""
    return pattern.replace("(?iU)", "(?i)")


def raw_spans(source: str, patterns: list[tuple[str, str, float]], key: str = "doc_id") -> str:
    """All matches of ``(pattern with three groups, type, confidence)`` in ``source(key, text)``.

    Columns: doc_id, text, rule, pii_type, confidence, s, e, v.
    """
    marked = "\nunion all\n".join(
        f"select {key} as doc_id, text, {i} as rule, {lit(t)} as pii_type, cast({c} as double) as confidence, "
        f"string_split(regexp_replace(text, {lit(p)}, '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)) as p "
        f"from {source}"
        for i, (p, t, c) in enumerate(patterns)
    )
    return f"""
      select doc_id, text, rule, pii_type, confidence, v,
        cast(list_sum(list_transform(p[1:2*i-1], lambda z: length(z))) as bigint) as s,
        cast(list_sum(list_transform(p[1:2*i-1], lambda z: length(z))) as bigint) + length(v) as e
      from (select *, p[2*i] as v from (select *, unnest(range(1, len(p)//2 + 1)) as i from ({marked})))"""


SPAN_COLS = "doc_id, s as span_start, e as span_end, v as raw_value, pii_type, confidence"

# guards instead of Unicode word boundaries
OPEN, CLOSE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"

EMAIL = OPEN + "(" + fixed.EMAIL_PATTERN.removeprefix(r"\b").removesuffix(r"\b") + ")" + CLOSE


def emails(source: str, key: str = "doc_id") -> str:
    return raw_spans(source, [(EMAIL, "email", 0.95)], key)


def phones(source: str, key: str = "doc_id") -> str:
    families = [f"()({p})()" for _, p in fixed.PHONE_PATTERNS]
    base = raw_spans(source, [(p, "phone", 0.85) for p in families], key)
    return f"""
      select a.doc_id, a.text, a.rule, a.pii_type, a.confidence, regexp_replace(a.v, '[\\s.-]+$', '') as v, a.s,
        a.s + length(regexp_replace(a.v, '[\\s.-]+$', '')) as e
      from ({_phone_ok(base)}) a
      where not exists (select 1 from ({_phone_ok(base)}) b where b.doc_id = a.doc_id and b.rule < a.rule
        and ((b.s <= a.s and a.s < b.e) or (b.s < a.e and a.e <= b.e)))"""


def _phone_ok(base: str) -> str:
    return f"""select * from ({base}) where length(regexp_replace(v, '\\D', '', 'g')) between 7 and 15
      and not regexp_matches(substring(text, greatest(s - 30, 0) + 1, least(s, 30)),
        {lit(flagged(fixed.PHONE_STOP_CONTEXT))})"""


def apikeys(source: str, key: str = "doc_id", min_entropy: float = 3.5, per_family: bool = False) -> str:
    """Keys; with ``per_family`` a key that several families know is a row for each."""
    families = [
        f"({fixed.KEY_OPENING})({p})({fixed.KEY_CLOSING})" if between else f"()({p})()" for _, p, between in fixed.KEY_PATTERNS
    ]
    hex_rule = [name for name, _, _ in fixed.KEY_PATTERNS].index("lower_hex")
    base = raw_spans(source, [(p, "apikey", 0.7) for p in families], key)
    return f"""
      select {"" if per_family else "distinct"} doc_id, text, 'apikey' as pii_type, v, s, e,
        case when regexp_matches(ctx, {lit(flagged(fixed.KEY_CONTEXT))})
          then cast(0.95 as double) else cast(0.7 as double) end as confidence
      from (select *, substring(text, greatest(s - 50, 0) + 1, least(s, 50)) as ctx from ({base})
            where not (rule = {hex_rule} and regexp_matches(substring(text, e + 1), {lit("^" + fixed.HEX_IS_LABEL)}))) t
      where length(v) >= 20
        and not regexp_matches(ctx, {lit(flagged(fixed.HASH_CONTEXT))})
        and (select -sum(c / n * log2(c / n)) from (select count(*) * 1.0 as c, length(t.v) * 1.0 as n
             from (select unnest(string_split(t.v, '')) as ch) where ch <> '' group by ch)) >= {min_entropy}"""


def credentials(source: str, key: str = "doc_id") -> str:
    pattern = (
        r"(?i)((?:^|[^A-Za-z0-9])(?:password|passwd|pwd|pass|secret|token)(?:[_-][A-Za-z0-9]+)*["
        + '"' + r"']?\s*[=:]\s*[" + '"' + r"']?)([^\s" + '"' + r"',;]{4,})()"
    )
    return raw_spans(source, [(pattern, "password", 0.9)], key)


def usernames(source: str, key: str = "doc_id") -> str:
    value = f"({fixed.USERNAME_VALUE})"
    families = [
        rf"({fixed.USERNAME_WORDS}){value}(\b)",
        rf"(?i)({fixed.USERNAME_ASSIGNED}){value}(\b)",
        rf"( - ){value}( \[)",
        rf'(?i)((?:{fixed.USERNAME_KEYS})"\s*:\s*"){value}(")',
    ]
    base = raw_spans(source, [(p, "username", 0.85) for p in families], key)
    return f"""select * from ({base}) where lower(v) not in ({words(fixed.USERNAME_STOP)}) and regexp_matches(v, '[._-]')"""


def filepaths(source: str, key: str = "doc_id") -> str:
    patterns = [
        (rf"(?i)({fixed.DRIVE_PATH})({fixed.DRIVE_USER})(\\)", "filepath_user", 0.9),
        (rf"({fixed.HOME_PATH})({fixed.HOME_USER})(/)", "filepath_user", 0.9),
    ]
    return f"select * from ({raw_spans(source, patterns, key)}) where lower(v) not in ({words(fixed.SYSTEM_ACCOUNTS)})"


def hostnames(source: str, key: str = "doc_id") -> str:
    pattern = f"(?i)()({fixed.HOST_PATTERN})()"
    return f"""select * from ({raw_spans(source, [(pattern, 'hostname', 0.7)], key)})
      where not (regexp_matches(v, '(?i)^[A-Z]+-[A-Z0-9]{{6,}}$')
        and regexp_matches(substring(v, strpos(v, '-') + 1), '^[A-Z0-9]{{7,}}$')
        and regexp_matches(substring(v, strpos(v, '-') + 1), '[A-Z]'))"""


def ibans(source: str, key: str = "doc_id") -> str:
    pattern = f"()({fixed.IBAN_PATTERN})()"
    return f"""
      select * from (select *, replace(v, ' ', '') as c from ({raw_spans(source, [(pattern, 'iban', 0.98)], key)})) t
      where length(c) between 15 and 34 and regexp_full_match(c, '[0-9A-Z]+')
        and cast(list_aggregate(list_transform(string_split(substring(c, 5) || substring(c, 1, 4), ''),
              lambda x: case when x between '0' and '9' then x else cast(ascii(x) - 55 as varchar) end),
              'string_agg', '') as hugeint) % 97 = 1"""


PROTECTED = [("(?i)" if "i" in flags else "") + pattern for _, pattern, flags in fixed.PROTECTED_PATTERNS]


def protected(source: str, key: str = "doc_id") -> str:
    def grouped(p: str) -> str:
        return f"(?i)()({p[4:]})()" if p.startswith("(?i)") else f"()({p})()"

    return raw_spans(source, [(grouped(p), "protected", 1.0) for p in PROTECTED], key)


def best_spans(candidates: str) -> str:
    """Spans that no better overlapping candidate beats (exact where overlaps do not chain)."""
    return f"""
      select * from ({candidates}) a where not exists (
        select 1 from ({candidates}) b where b.doc_id = a.doc_id and b.s < a.e and a.s < b.e
          and (b.e - b.s, b.confidence, -b.s, -b.det) > (a.e - a.s, a.confidence, -a.s, -a.det))"""


def not_protected(spans: str, source: str, key: str = "doc_id") -> str:
    whole = " or ".join(f"(p.rule = {i} and regexp_full_match(a.v, {lit(p)}))" for i, p in enumerate(PROTECTED))
    return f"""
      select * from ({spans}) a where not exists (
        select 1 from ({protected(source, key)}) p where p.doc_id = a.doc_id
          and ((p.s <= a.s and a.e <= p.e) or {whole}))"""


def scanned_documents() -> str:
    """Settled and unprotected spans of the documents table (types that occur there)."""
    parts = [
        f"select distinct doc_id, s, e, v, pii_type, confidence, {det} as det from ({sql})"
        for det, sql in [
            (0, emails("documents")),
            (1, phones("documents")),
            (3, apikeys("documents")),
            (4, credentials("documents")),
            (7, usernames("documents")),
        ]
    ]
    return not_protected(best_spans("\nunion all\n".join(parts)), "documents")
