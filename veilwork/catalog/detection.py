"""Detection queries: one per detector, overlap resolution, protection, scans."""

from __future__ import annotations

from .. import fixed
from ..operators import wordlists
from ..operators.allowlist import drop_allowed
from ..operators.detect import candidate_spans, custom_spans, detect, pick_rules
from ..operators.reports import scan_report, scan_totals
from ..operators.spans import resolve_overlaps, span_rows
from ..rules import PROTECTED_RULES, Rule
from . import sqltools as S
from .registry import CASE, corpus, documents, query, span_output, table, view


def _spans(docs, detector, compat=False):
    rules = pick_rules([detector])
    return span_output(candidate_spans(docs, rules, compat=compat))


def _check(sql: str) -> str:
    return f"select {S.SPAN_COLS} from ({sql})"


@query("detect_email", _check(S.emails("documents")))
def detect_email(spark, sf):
    return _spans(documents(spark, sf), "email")


@query("detect_email_pages", _check(S.emails("(select page_id as doc_id, html as text from pages)")))
def detect_email_pages(spark, sf):
    pages = table(spark, sf, "pages").selectExpr("page_id as doc_id", "page_id as ord", "html as text")
    return _spans(pages, "email")


@query("detect_phone", _check(S.phones("documents")))
def detect_phone(spark, sf):
    return _spans(documents(spark, sf), "phone")


@query("detect_phone_log", _check(S.phones("ev_log")))
def detect_phone_log(spark, sf):
    return _spans(corpus(spark, sf, "ev_log"), "phone")


@query("detect_iban", _check(S.ibans("ev_accounts")))
def detect_iban(spark, sf):
    return _spans(corpus(spark, sf, "ev_accounts"), "iban")


@query("detect_apikey", _check(S.apikeys("documents", per_family=True)))
def detect_apikey(spark, sf):
    return _spans(documents(spark, sf), "apikey")


@query("detect_apikey_entropy", _check(S.apikeys("ev_secrets", min_entropy=4.0, per_family=True)))
def detect_apikey_entropy(spark, sf):
    """Keys above a higher entropy."""
    keys = candidate_spans(corpus(spark, sf, "ev_secrets"), pick_rules(["apikey"]), min_entropy=4.0)
    return span_output(keys)


@query("detect_credential", _check(S.credentials("documents")))
def detect_credential(spark, sf):
    return _spans(documents(spark, sf), "credential")


@query("detect_credential_log", _check(S.credentials("ev_log")))
def detect_credential_log(spark, sf):
    return _spans(corpus(spark, sf, "ev_log"), "credential")


@query("detect_filepath_user", _check(S.filepaths("ev_log")))
def detect_filepath_user(spark, sf):
    return _spans(corpus(spark, sf, "ev_log"), "filepath")


@query("detect_hostname", _check(S.hostnames("ev_log")))
def detect_hostname(spark, sf):
    return _spans(corpus(spark, sf, "ev_log"), "hostname")


@query("detect_username", _check(S.usernames("ev_log")))
def detect_username(spark, sf):
    return _spans(corpus(spark, sf, "ev_log"), "username")


@query("detect_own_rule", f"""
  select {S.SPAN_COLS} from ({S.raw_spans("documents", [(r"()(\b\d{16}\b)()", "card", 0.8)])}) where v not like '0%'""")
def detect_own_rule(spark, sf):
    """A rule of the caller's own: bare numbers of 16 digits, with a test on the value."""
    rule = Rule("card", "card", "card", 0.8, r"\b\d{16}\b")
    return span_output(custom_spans(documents(spark, sf), [rule], "not startswith(raw_value, '0')"))


@query("detect_apikey_families", _check(S.apikeys("ev_secrets", per_family=True)))
def detect_apikey_families(spark, sf):
    """All eight families of keys."""
    return _spans(corpus(spark, sf, "ev_secrets"), "apikey")


@query("detect_phone_families", _check(S.phones("ev_secrets")))
def detect_phone_families(spark, sf):
    """Numbers with a leading zero and numbers of three groups."""
    return _spans(corpus(spark, sf, "ev_secrets"), "phone")


@query("detect_username_contexts", _check(S.usernames("ev_secrets")))
def detect_username_contexts(spark, sf):
    """Names that are assigned, in an access log, and under a key."""
    return _spans(corpus(spark, sf, "ev_secrets"), "username")


_BEFORE = r"((?:^|[\s,;:(\[{" + '"' + r"']))"
_AT = f"{_BEFORE}({fixed.AT_HANDLE})([^A-Za-z0-9@]|$)"
_U = f"{_BEFORE}({fixed.U_HANDLE})([^A-Za-z0-9]|$)"
# the reserved paths are cut out afterwards, there is no lookahead here
_URLS = [
    (f"(?i)({path.split('(?!')[0]})({user})" + ("(/?)" if site == "instagram" else r"(\b)"), 0.9)
    for site, path, user, _ in fixed.PROFILE_URLS
]
_FIELD = rf"""(?i)("(?:{fixed.SOCIAL_KEYS})"\s*[:=]\s*["']?)({fixed.SOCIAL_VALUE})()"""
_TAG = f"()({fixed.TAG_PATTERN})()"
_SOCIAL = (
    "select * from ("
    + S.raw_spans(
        "ev_social",
        [(_AT, "social_handle", 0.88), (_U, "social_handle", 0.88)]
        + [(p, "social_handle", c) for p, c in _URLS]
        + [(_FIELD, "social_handle", 0.85), (_TAG, "social_handle", 0.9)],
    )
    + ") where lower(v) not in ('@everyone', 'stories') and not regexp_matches(v, '^@?\\d+$')"
)


@query("detect_social", _check(_SOCIAL))
def detect_social(spark, sf):
    return _spans(corpus(spark, sf, "ev_social"), "social")


@query(
    "detect_social_compat",
    f"""select {S.SPAN_COLS} from (
      select *, row_number() over (partition by doc_id, regexp_replace(lower(v), '^(?:@|u/)', '') order by rule, s) as rn
      from ({_SOCIAL})) where rule = 0 or rn = 1""",
)
def detect_social_compat(spark, sf):
    """Only the first mention of a handle, as long as it is no ``@`` handle."""
    return _spans(corpus(spark, sf, "ev_social"), "social", compat=True)


def _label_check() -> str:
    q = '"'
    patterns = []
    for labels, pii_type, conf in [
        (fixed.NAME_LABELS, "name", 0.92), (fixed.USERNAME_LABELS, "username", 0.9),
        (fixed.ADDRESS_LABELS, "address", 0.88), (fixed.CONTACT_LABELS, "phone", 0.88),
    ]:
        patterns += [
            (rf"(?i)((?:{labels})[{q}']?\s*:\s*{q})([^{q}]{{1,100}})({q})", pii_type, conf),
            (rf"(?i)((?:{labels})[{q}']?\s*:\s*')([^']{{1,100}})(')", pii_type, conf),
            (rf"(?i)((?:{labels})\s*=\s*{q})([^{q}]{{1,100}})({q})", pii_type, conf),
            (rf"(?i)((?:{labels})\s*=\s*)([^\s,;}}\]{q}']{{1,100}})()", pii_type, conf),
        ]
    base = S.raw_spans("ev_json", patterns)
    return f"""
      select distinct doc_id, s + length(v) - length(ltrim(v)) as span_start, e - length(v) + length(rtrim(v)) as span_end,
        trim(v) as raw_value, pii_type, confidence
      from ({base}) where length(trim(v)) >= 3 and lower(trim(v)) <> 'unknown' and not regexp_matches(trim(v), '^\\d+$')"""


@query("detect_field_label", _label_check())
def detect_field_label(spark, sf):
    return _spans(corpus(spark, sf, "ev_json"), "fieldlabel")


# the layout of the export is known, so the places follow from the lengths of its pieces
_EXPORT = """
  with parts as (
    select k as doc_id, username, email, phone, concat(first_name, ' ', last_name) as full_name, first_name,
      concat('old.', cast(k as varchar)) as old, string_split(t.text, chr(10)) as l, t.text
    from ev_people join ev_export t on t.doc_id = k),
  places as (
    select *, list_transform(range(1, 8), lambda i: cast(coalesce(list_sum(list_transform(l[1:i-1], lambda z: length(z) + 1)), 0) as bigint)) as o
    from parts),
  spans as (
    select doc_id, 17 as s, username as v, 'username' as t, 0.95 as c from places
    union all select doc_id, o[3], username, 'username', 0.93 from places
    union all select doc_id, o[3] + length(username) + 1, email, 'email', 0.93 from places
    union all select doc_id, o[3] + strpos(l[3], phone) - 1, phone, 'phone', 0.93 from places
    union all select doc_id, o[3] + strpos(l[3], full_name) - 1, full_name, 'name', 0.93 from places
    union all select doc_id, o[4] + 33, old, 'username', 0.92 from places
    union all select doc_id, o[4] + 34 + length(old), username, 'username', 0.92 from places
    union all select doc_id, o[5] + 37, first_name, 'name', 0.92 from places
    union all select doc_id, o[5] + 38 + length(first_name), full_name, 'name', 0.92 from places
    union all select doc_id, o[6], old, 'username', 0.9 from places
    union all select doc_id, o[6] + 1 + length(old), username, 'username', 0.9 from places)
  select doc_id, cast(s as bigint) as span_start, cast(s + length(v) as bigint) as span_end, v as raw_value, t as pii_type,
    cast(c as double) as confidence from spans"""


@query("detect_provider_export", _EXPORT)
def detect_provider_export(spark, sf):
    return _spans(corpus(spark, sf, "ev_export"), "provider_export")


def _terms(spark, sf):
    """Word lists from the benchmark texts: capitalised words are first names, the others last names."""
    words = table(spark, sf, "benchmark").selectExpr("explode(regexp_extract_all(text, '[A-Za-z]+', 0)) as term")
    first = wordlists.clean_terms(words.where("term rlike '^[A-Z]'"), "firstname")
    last = wordlists.clean_terms(words.where("not term rlike '^[A-Z]'"), "lastname")
    return first.unionByName(last)


_WORDS = """(select distinct term, regexp_matches(term, '^[A-Z]') as is_first
  from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as term from benchmark))"""
_LOOSE = f"""
  select w.doc_id, w.s as span_start, w.e as span_end, w.v as raw_value, t.kind as pii_type, cast(0.7 as double) as confidence
  from ({S.raw_spans('documents', [(r'()(\b[A-Za-z0-9_]+\b)()', 'word', 1.0)])}) w
  join (select distinct variant, kind from (
      select unnest([term, upper(term[1]) || lower(term[2:])]) as variant,
        case when is_first then 'firstname' else 'lastname' end as kind
      from {_WORDS} where length(term) >= 4)) t on t.variant = w.v"""


@query("detect_names_loose", _LOOSE)
def detect_names_loose(spark, sf):
    return span_output(wordlists.loose_names(documents(spark, sf), _terms(spark, sf)))


_STRICT = f"""
  with w as (select doc_id, s, e, v, lower(v) as low, row_number() over (partition by doc_id order by s) as n
             from ({S.raw_spans('documents', [(r'()([\p{L}\p{N}_]+)()', 'word', 1.0)])})
             where regexp_full_match(v, '[A-Za-zÀ-ÿ]{{2,}}')),
  f as (select distinct lower(term) as low from {_WORDS} where is_first),
  l as (select distinct lower(term) as low from {_WORDS} where not is_first),
  flagged as (select *, low in (select low from f) as is_f, low in (select low from l) as is_l from w),
  pairs as (
    select a.doc_id, a.s as s1, a.e as e1, a.v as v1, b.s as s2, b.e as e2, b.v as v2, a.is_f and b.is_l as fl
    from flagged a join flagged b on a.doc_id = b.doc_id and b.n = a.n + 1
    where (a.is_f and b.is_l) or (a.is_l and b.is_f))
  select distinct * from (
    select doc_id, s1 as span_start, e1 as span_end, v1 as raw_value, case when fl then 'firstname' else 'lastname' end as pii_type,
      cast(0.9 as double) as confidence from pairs
    union all
    select doc_id, s2, e2, v2, case when fl then 'lastname' else 'firstname' end, cast(0.9 as double) from pairs)"""


@query("detect_names_strict", _STRICT)
def detect_names_strict(spark, sf):
    return span_output(wordlists.strict_names(documents(spark, sf), _terms(spark, sf), context=False)).distinct()


_STREETS = f"""
  select w.doc_id, w.s as span_start, w.e as span_end, w.v as raw_value, 'address' as pii_type, cast(0.8 as double) as confidence
  from ({S.raw_spans('documents', [(r'()(\b[A-Za-z0-9_]+\b)()', 'word', 1.0)])}) w
  where w.v in (select unnest([term, upper(term[1]) || lower(term[2:])]) from {_WORDS} where length(term) >= 5)"""


@query("detect_streets", _STREETS)
def detect_streets(spark, sf):
    words = table(spark, sf, "benchmark").selectExpr("explode(regexp_extract_all(text, '[A-Za-z]+', 0)) as term")
    return span_output(wordlists.streets(documents(spark, sf), wordlists.clean_terms(words, "address")))


@query("protected_spans", f"""
  select doc_id, rule as kind, s as span_start, e as span_end, v as raw_value from ({S.protected('documents')})""")
def protected_spans(spark, sf):
    rows = span_rows(documents(spark, sf), PROTECTED_RULES, ["doc_id"])
    return rows.selectExpr(
        "doc_id", "rule as kind", "cast(start as bigint) as span_start", "cast(end as bigint) as span_end", "raw_value"
    )


@query("scan_documents", f"select {S.SPAN_COLS} from ({S.scanned_documents()})")
def scan_documents(spark, sf):
    """All detectors, overlaps settled, protected patterns dropped."""
    return span_output(detect(documents(spark, sf), protect=True))


def _log_scan(protect: bool) -> str:
    parts = "\nunion all\n".join(
        f"select distinct doc_id, s, e, v, pii_type, confidence, {det} as det from ({sql})"
        for det, sql in [
            (0, S.emails("ev_log")), (1, S.phones("ev_log")), (3, S.apikeys("ev_log")), (4, S.credentials("ev_log")),
            (5, S.filepaths("ev_log")), (6, S.hostnames("ev_log")), (7, S.usernames("ev_log")),
        ]
    )
    best = S.best_spans("select * from log_candidates")
    kept = S.not_protected(best, "ev_log") if protect else best
    return f"with log_candidates as materialized ({parts}) select * from ({kept})"


@query("resolve_overlaps_log", f"select {S.SPAN_COLS} from ({_log_scan(False)})")
def resolve_overlaps_log(spark, sf):
    names = ["email", "phone", "apikey", "credential", "filepath", "hostname", "username"]
    return span_output(resolve_overlaps(candidate_spans(corpus(spark, sf, "ev_log"), pick_rules(names))))


@query("scan_include_types", f"select {S.SPAN_COLS} from ({S.scanned_documents()}) where pii_type in ('email', 'apikey')")
def scan_include_types(spark, sf):
    return span_output(detect(documents(spark, sf), include=["email", "apikey"], protect=True))


@query("scan_exclude_types", f"select {S.SPAN_COLS} from ({S.scanned_documents()}) where pii_type not in ('email', 'apikey', 'password')")
def scan_exclude_types(spark, sf):
    return span_output(detect(documents(spark, sf), exclude=["email", "apikey", "password"], protect=True))


@query("scan_report", f"""
  select doc_id, s as span_start, pii_type, v as raw_value, confidence,
    translate(substring(text, greatest(s - 20, 0) + 1, e + 20 - greatest(s - 20, 0)), chr(10), ' ') as context
  from ({S.scanned_documents()}) join documents using (doc_id)""")
def report(spark, sf):
    return scan_report(detect(documents(spark, sf), protect=True)).selectExpr(
        "doc_id", "cast(start as bigint) as span_start", "pii_type", "raw_value", "confidence", "context"
    )


@query("scan_totals", f"""
  with m as materialized ({S.scanned_documents()})
  select cast(doc_id as varchar) as doc, pii_type, count(*) as n from m group by 1, 2
  union all select '(all)', '(matches)', count(*) from m
  union all select '(all)', '(documents)', count(*) from documents""")
def totals(spark, sf):
    docs = documents(spark, sf)
    return scan_totals(docs, detect(docs, protect=True))


def _host_mail() -> str:
    return f"select *, lower(v) as low from ({S.usernames('ev_log')} union all select * from ({S.emails('ev_log')}) union all select * from ({S.credentials('ev_log')}))"


@query("allowlist_filter", f"""
  select distinct doc_id, s as span_start, e as span_end, v as raw_value, pii_type from ({_host_mail()}) a
  where not exists (select 1 from ev_allow w where lower(w.value) = a.low)
    and not (pii_type = 'email' and split_part(a.low, '@', 2) in (select lower(value) from ev_allow where value_type = 'domain'))""")
def allowlist_filter(spark, sf):
    """Values, mail domains and host domains on the allowlist are dropped."""
    spans = candidate_spans(corpus(spark, sf, "ev_log"), pick_rules(["username", "email", "credential"]))
    kept = drop_allowed(spans, view(spark, sf, "ev_allow"), CASE)
    return kept.selectExpr(
        "doc_id", "cast(start as bigint) as span_start", "cast(end as bigint) as span_end", "raw_value", "pii_type"
    ).distinct()


@query("allowlist_host_domains", """
  select k as doc_id, h.v as raw_value from (
    select k, unnest([host || '.MAIL' || cast(k % 5 as varchar) || '.example.com', host]) as v from ev_people) h
  where not exists (select 1 from ev_allow w where w.value_type = 'domain'
    and (lower(h.v) = lower(w.value) or ends_with(lower(h.v), '.' || lower(w.value))))""")
def allowlist_host_domains(spark, sf):
    """Hosts equal to or below an allowed domain are dropped."""
    hosts = view(spark, sf, "ev_people").selectExpr(
        "k as doc_id", "explode(array(concat(host, '.MAIL', cast(k % 5 as string), '.example.com'), host)) as raw_value",
        "'hostname' as pii_type",
    )
    return drop_allowed(hosts, view(spark, sf, "ev_allow"), CASE).select("doc_id", "raw_value")


