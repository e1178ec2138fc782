"""Registration, dictionary match, rewriting, restoring and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import TOKEN_PREFIXES, UNKNOWN_PREFIX
from ..operators import audit
from ..operators.detect import detect
from ..operators.dictionary import hit_rows
from ..operators.registry import (
    by_entity,
    by_token,
    by_types,
    create_entities,
    empty_case,
    first_appearances,
    next_numbers,
    number_tokens,
    open_at_rest,
    protect_at_rest,
    register,
    replacement_entries,
)
from ..operators.rewrite import anonymize, anonymize_corpus, deanonymize
from ..plans import stage
from . import sqltools as S
from .registry import CASE, corpus, documents, first_empty, query, table, view

PREFIX_SQL = (
    "case pii_type "
    + " ".join(f"when {S.lit(t)} then {S.lit(p)}" for t, p in TOKEN_PREFIXES.items())
    + f" else {S.lit(UNKNOWN_PREFIX)} end"
)


def firsts_sql(spans: str) -> str:
    """First appearance of each value in spans(ord, s, v, pii_type)."""
    return f"select v, min(ord) as ord, arg_min(s, (ord, s)) as s, arg_min(pii_type, (ord, s)) as pii_type from ({spans}) group by v"


def numbered_sql(firsts: str) -> str:
    return f"""
      select *, prefix || format('{{:03d}}', num) as token from (
        select *, row_number() over (order by ord, s) as mapping_id,
          row_number() over (partition by prefix order by ord, s) as num
        from (select *, {PREFIX_SQL} as prefix from ({firsts})))"""


SCAN = f"select *, doc_id as ord from ({S.scanned_documents()})"
DOC_REGISTRY = numbered_sql(firsts_sql(SCAN))


def doc_spans(spark, sf):
    return detect(documents(spark, sf), protect=True, context=False).drop("left_ctx", "right_ctx")


def doc_registry(spark, sf):
    return register(doc_spans(spark, sf), first_empty(spark), CASE)


# the log lines are built from known values, so their settled spans are known too
LOG_FIRSTS = """
  select v, pii_type, o, pos from (
    select v, pii_type, o, pos, row_number() over (partition by v order by o, pos) as rn from (
      select o_orderkey as o, unnest([
        {'v': username, 'pii_type': 'username', 'pos': 1},
        {'v': 'Secret' || cast(k as varchar) || '!', 'pii_type': 'password', 'pos': 2},
        {'v': phone, 'pii_type': 'phone', 'pos': 3},
        {'v': case when k % 3 = 0 then null else host end, 'pii_type': 'hostname', 'pos': 4},
        {'v': email, 'pii_type': 'email', 'pos': 5}], recursive := true)
      from orders join ev_people on o_custkey = k) where v is not null) where rn = 1"""
LOG_REGISTRY = numbered_sql(f"select v, pii_type, o as ord, pos as s from ({LOG_FIRSTS})")


def log_spans(spark, sf):
    return detect(corpus(spark, sf, "ev_log"), protect=True, context=False).drop("left_ctx", "right_ctx")


def log_registry(spark, sf):
    return register(log_spans(spark, sf), first_empty(spark), CASE)


@query("first_appearances", f"select v as raw_value, cast(ord as bigint) as ord, s as span_start, pii_type from ({firsts_sql(SCAN)})")
def q_first_appearances(spark, sf):
    return first_appearances(doc_spans(spark, sf)).selectExpr(
        "raw_value", "ord", "cast(start as bigint) as span_start", "pii_type"
    )


@query("register_documents", f"select mapping_id, pii_type, v as raw_value, token, num from ({DOC_REGISTRY})")
def register_documents(spark, sf):
    return doc_registry(spark, sf).select("mapping_id", "pii_type", "raw_value", "token", "num")


@query("register_log", f"select mapping_id, pii_type, v as raw_value, token, num from ({LOG_REGISTRY})")
def register_log(spark, sf):
    return log_registry(spark, sf).select("mapping_id", "pii_type", "raw_value", "token", "num")


# a second run over the same log after a first one over the account holders' mails
_GROWN = f"""
  with old as (
    select k + 1 as mapping_id, email as v, k + 1 as num from (select row_number() over (order by k) - 1 as k, email from ev_people)),
  fresh as (select * from ({LOG_FIRSTS}) where v not in (select v from old)),
  n as (select *, {PREFIX_SQL} as prefix from fresh)
  select (select max(mapping_id) from old) + row_number() over (order by o, pos) as mapping_id, pii_type, v as raw_value,
    prefix || format('{{:03d}}', num) as token
  from (select *, row_number() over (partition by prefix order by o, pos)
          + case when prefix = 'ANONEMAIL' then (select max(num) from old) else 0 end as num from n)"""


@query("register_incremental", _GROWN)
def register_incremental(spark, sf):
    """Known values are skipped, new ones are numbered after the stored maximum."""
    people = view(spark, sf, "ev_people").selectExpr(
        "k as doc_id", "k as ord", "0 as start", "email as raw_value", "'email' as pii_type"
    )
    old = register(people, first_empty(spark), CASE)
    return register(log_spans(spark, sf), old, CASE).select("mapping_id", "pii_type", "raw_value", "token")


@query("number_tokens", """
  select c_name as raw_value, 'ANONUNK' || format('{:03d}', row_number() over (order by c_custkey)) as token
  from customer""")
def q_number_tokens(spark, sf):
    """Range-sorted global numbering; an unknown type has the unknown prefix."""
    values = table(spark, sf, "customer").selectExpr(
        "c_name as raw_value", "c_custkey as ord", "0 as start", "'segment' as pii_type"
    )
    return number_tokens(values, first_empty(spark), CASE).select("raw_value", "token")


@query("next_numbers", f"select prefix, cast(max(num) + 1 as bigint) as next_num from ({LOG_REGISTRY}) group by prefix")
def q_next_numbers(spark, sf):
    return next_numbers(log_registry(spark, sf)).select("prefix", "next_num")


@query("lookup_by_type", f"select v as raw_value, token from ({LOG_REGISTRY}) where pii_type in ('email', 'hostname')")
def lookup_by_type(spark, sf):
    return by_types(log_registry(spark, sf), CASE, ["email", "hostname"]).select("raw_value", "token")


@query("lookup_by_token", f"select v as raw_value, pii_type from ({LOG_REGISTRY}) where token = 'ANONUSER007'")
def lookup_by_token(spark, sf):
    return by_token(log_registry(spark, sf), CASE, "ANONUSER007").select("raw_value", "pii_type")


_VARIANTS = f"""
  with r as ({LOG_REGISTRY}), v as (
    select v as variant, token, 0 as second, mapping_id, pii_type from r
    union all
    select case when v[1] = lower(v[1]) then upper(v[1]) || lower(v[2:]) else lower(v) end, token, 1, mapping_id, pii_type
    from r where lower(v[1]) <> upper(v[1]) and not (v[1] = upper(v[1]) and v = upper(v)))
  select variant, arg_max(token, (mapping_id, second)) as token from v group by variant"""


@query("replacement_entries", _VARIANTS)
def q_replacement_entries(spark, sf):
    """Values with their second spelling."""
    return replacement_entries(log_registry(spark, sf), CASE).select("variant", "token")


def _sentences(spark, sf):
    """Dictionary of many-word entries: the sentences of the benchmark texts."""
    return table(spark, sf, "benchmark").selectExpr(
        "explode(split(text, '[.]\\\\s*')) as variant"
    ).where("variant <> ''").distinct().withColumn("name", F.expr("md5(variant)"))


_MATCH = """
  with recursive entries as (select distinct variant from (
      select unnest(regexp_split_to_array(text, '[.]\\s*')) as variant from benchmark) where variant <> ''),
  pieces as (select doc_id, text, variant, string_split(text, variant) as p from documents join entries on contains(text, variant)),
  spots as (select doc_id, text, variant, unnest(range(1, len(p))) as i, p from pieces),
  places as (select doc_id, text, variant, length(variant) as n,
      cast(list_sum(list_transform(p[1:i], lambda z: length(z))) as bigint) + (i - 1) * length(variant) as s from spots),
  hits as (select * from places
    where (s = 0 or not regexp_matches(text[s], '[A-Za-z0-9_]') or not regexp_matches(variant[1], '[A-Za-z0-9_]'))
      and not regexp_matches(text[s + n + 1], '[A-Za-z0-9_]')),
  ranked as (select doc_id, variant, s, s + n as e, row_number() over (partition by doc_id order by s, n desc) as rn from hits),
  walk as (
    select doc_id, rn, variant, s, e, true as kept, e as reach from ranked where rn = 1
    union all
    select r.doc_id, r.rn, r.variant, r.s, r.e, r.s >= w.reach, case when r.s >= w.reach then r.e else w.reach end
    from walk w join ranked r on r.doc_id = w.doc_id and r.rn = w.rn + 1)
  select doc_id, s as span_start, e as span_end, md5(variant) as name from walk where kept"""


@query("dictionary_match", _MATCH)
def dictionary_match(spark, sf):
    """Leftmost-longest whole-word hits of a dictionary in all documents."""
    return hit_rows(documents(spark, sf), _sentences(spark, sf), "name").selectExpr(
        "doc_id", "cast(start as bigint) as span_start", "cast(end as bigint) as span_end", "name"
    )


_ANON_DOCS = f"""
  with recursive r as materialized (select row_number() over (order by length(v) desc, mapping_id) as n, v, token from ({DOC_REGISTRY})),
  walk as (
    select doc_id, text, 0 as n from documents
    union all
    select w.doc_id, replace(w.text, r.v, r.token), r.n from walk w join r on r.n = w.n + 1)
  select doc_id, md5(text) as text_hash, length(text) as n_chars from walk where n = (select max(n) from r)"""


@query("anonymize_documents", _ANON_DOCS)
def anonymize_documents(spark, sf):
    """Detect, register, then replace over the whole corpus."""
    docs = documents(spark, sf)
    out, _ = anonymize_corpus(docs, detect(docs, protect=True, context=False).drop("left_ctx", "right_ctx"), first_empty(spark), CASE)
    return out.selectExpr("doc_id", "md5(text) as text_hash", "cast(length(text) as bigint) as n_chars")


_ANON_LOG = f"""
  with r as materialized (select v, token from ({LOG_REGISTRY})),
  m as (select o_orderkey as doc_id, username, 'Secret' || cast(k as varchar) || '!' as secret, phone, email,
          case when k % 3 = 0 then null else host end as host from orders join ev_people on o_custkey = k)
  select l.doc_id, md5(replace(replace(replace(replace(coalesce(replace(text, m.host, h.token), text), m.email, e.token), m.username, u.token),
     m.secret, s.token), m.phone, p.token)) as text_hash,
    cast(case when m.host is null then 7 else 8 end as bigint) as n_hits
  from ev_log l join m using (doc_id) join r u on u.v = m.username join r s on s.v = m.secret
    join r p on p.v = m.phone join r e on e.v = m.email left join r h on h.v = m.host"""


@query("anonymize_log", _ANON_LOG)
def anonymize_log(spark, sf):
    out = anonymize(corpus(spark, sf, "ev_log"), log_registry(spark, sf), CASE)
    return out.selectExpr("doc_id", "md5(text) as text_hash", "n_hits")


@query("restore_log", "select doc_id, md5(text) as text_hash from ev_log")
def restore_log(spark, sf):
    """Restoring gives the originals back."""
    docs, registry = corpus(spark, sf, "ev_log"), log_registry(spark, sf)
    back = deanonymize(stage(anonymize(docs, registry, CASE), "anonymized"), registry, CASE)
    return back.selectExpr("doc_id", "md5(text) as text_hash")



def _token_texts(registry):
    return registry.selectExpr(
        "mapping_id as doc_id",
        "concat('Report (', token, ') of **', token, '**, x', token, ' and ANONUSER999999 or ', token, '_1.') as text",
    )


@query("restore_selected_types", f"""
  select mapping_id as doc_id, 'Report (' || w || ') of **' || w || '**, x' || token || ' and ANONUSER999999 or ' || token || '_1.' as text
  from (select *, case when pii_type in ('email', 'phone') then v else token end as w from ({LOG_REGISTRY}))""")
def restore_selected_types(spark, sf):
    """Only mails and phones come back; glued and unknown tokens stay."""
    registry = log_registry(spark, sf)
    return deanonymize(_token_texts(registry), registry, CASE, ["email", "phone"]).select("doc_id", "text")


@query("restore_no_types", f"""
  select mapping_id as doc_id, 'Report (' || token || ') of **' || token || '**, x' || token || ' and ANONUSER999999 or ' || token || '_1.' as text
  from ({LOG_REGISTRY})""")
def restore_no_types(spark, sf):
    registry = log_registry(spark, sf)
    return deanonymize(_token_texts(registry), registry, CASE, []).select("doc_id", "text")


@query("leak_audit_documents", f"""
  select d.doc_id, r.v as raw_value, r.pii_type, r.token from documents d join ({DOC_REGISTRY}) r
    on length(r.v) >= 4 and contains(d.text, r.v)""")
def leak_audit_documents(spark, sf):
    """Values still in a text (here: the originals, so all of them)."""
    return audit.leaks(documents(spark, sf), doc_registry(spark, sf), CASE)


@query("leak_audit_words", """
  with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as v from benchmark)
  select d.doc_id, w.v as raw_value from documents d join w on contains(d.text, w.v)""")
def leak_audit_words(spark, sf):
    """Short values that also occur inside longer words."""
    words = table(spark, sf, "benchmark").selectExpr(
        "explode(regexp_extract_all(lower(text), '[a-z]{4,}', 0)) as raw_value"
    ).distinct()
    registry = words.selectExpr(f"'{CASE}' as case_id", "raw_value", "'name' as pii_type", "md5(raw_value) as token")
    return audit.leaks(documents(spark, sf), registry, CASE).select("doc_id", "raw_value")


@query("round_trip_audit", f"""
  with r as materialized (select v, token from ({DOC_REGISTRY}))
  select (select count(*) from documents) as n_docs, cast(0 as bigint) as n_changed,
    (select count(*) from documents d where exists (select 1 from r where contains(d.text, r.v))) as n_rewritten""")
def round_trip_audit(spark, sf):
    """Documents, those that differ after the round trip, and those that hold a token in between."""
    docs, registry = documents(spark, sf), doc_registry(spark, sf)
    out = stage(anonymize(docs, registry, CASE), "round-trip")
    changed = audit.round_trip_differences(docs, deanonymize(out, registry, CASE)).agg(F.count("*")).scalar()
    rewritten = out.where("n_hits > 0").agg(F.count("*")).scalar()
    return docs.agg(F.count("*").alias("n_docs"), changed.alias("n_changed"), rewritten.alias("n_rewritten"))


@query("consistency_audit", """
  with r as (select o_orderkey as n, c_mktsegment as v, 'T' || cast(o_orderkey % 7 as varchar) as t from orders join customer on o_custkey = c_custkey)
  select 'value' as kind, v as item, count(distinct t) as n from r group by v having count(distinct t) > 1
  union all select 'token', t, count(distinct v) from r group by t having count(distinct v) > 1""")
def consistency_audit(spark, sf):
    """Values with several tokens and tokens with several values (a deliberately bad mapping)."""
    bad = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        f"'{CASE}' as case_id", "c_mktsegment as raw_value", "concat('T', cast(o_orderkey % 7 as string)) as token"
    )
    return audit.inconsistent_mappings(bad).select("kind", "item", "n")


@query("protect_at_rest", f"select v as raw_value, sha256(v || 'pepper') as value_hash from ({LOG_REGISTRY})")
def q_protect_at_rest(spark, sf):
    """Encrypted at rest and opened again; the salted hash stays a join key."""
    key = spark.createDataFrame([(bytes(range(32)), "pepper")], "key binary, salt string")
    closed = protect_at_rest(log_registry(spark, sf), key)
    opened = open_at_rest(closed, key).select("mapping_id", "raw_value")
    return closed.select("mapping_id", "value_hash").join(opened, "mapping_id").select("raw_value", "value_hash")


@query("create_entities", """
  select 'PERSON' || format('{:03d}', k + 1) as entity_id, 'person' as entity_type
  from (select row_number() over (order by c_custkey) - 1 as k from customer)""")
def q_create_entities(spark, sf):
    people = view(spark, sf, "ev_people").selectExpr(
        "k as doc_id", "k as ord", "0 as start", "email as raw_value", "'email' as pii_type"
    )
    state = empty_case(spark)
    registry = register(people, state["registry"], CASE)
    once = create_entities(registry, state["entities"])
    return create_entities(registry, once).select("entity_id", "entity_type")


@query("lookup_by_entity", f"""
  select v as raw_value, pii_type from ({LOG_REGISTRY}) where mapping_id = 1
  union all select email, 'email' from ev_people where username = (select v from ({LOG_REGISTRY}) where mapping_id = 1)""")
def lookup_by_entity(spark, sf):
    return by_entity(log_registry(spark, sf), CASE, "PERSON001").select("raw_value", "pii_type")
