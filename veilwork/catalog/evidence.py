"""Further evidence for rules and decisions: own Python detectors, templates, conflicts, encodings, empty cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.columns import cells, target_columns, template_columns, templates
from ..operators.custom import batch_detector
from ..operators.detect import candidate_spans, pick_rules
from ..operators.entities import same_value
from ..operators.registry import empty_case, register, replacement_entries
from ..operators.reports import case_status
from ..operators.rewrite import find_spans
from ..sources.corpus import read_corpus
from .corpora import folder
from .registry import CASE, documents, query, span_output, table, view


def account_numbers(texts):
    """Runs of 16 digits whose last digit is the check digit of the others."""
    for n, text in enumerate(texts):
        for m in re.finditer("[0-9]+", text):
            digits = [int(c) for c in m[0]]
            doubled = [d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)]
            if len(digits) == 16 and sum(doubled) % 10 == 0:
                yield n, m.start(), m.end(), "account", 0.9


# sixteen digits made of the document's number, with a right check digit in two of three documents
_LUHN = f"""
  with d as (select doc_id, text || ' no ' || lpad(cast(doc_id * 7919 as varchar), 16, '4') || ', ' || lpad(cast(doc_id * 10 as varchar), 16, '4') as text
             from documents),
  p as (select doc_id, string_split(regexp_replace(text, '([0-9]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p from d),
  n as (select doc_id, p, unnest(range(2, len(p), 2)) as i from p),
  v as (select doc_id, p[i] as v, cast(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) as bigint) as s from n where length(p[i]) = 16)
  select doc_id, s as span_start, s + 16 as span_end, v as raw_value, 'account' as pii_type, cast(0.9 as double) as confidence
  from v where list_sum(list_transform(range(1, 17), lambda k: case when k % 2 = 0 then cast(v[k] as int)
    else 2 * cast(v[k] as int) - case when cast(v[k] as int) > 4 then 9 else 0 end end)) % 10 = 0"""


def _with_numbers(spark, sf):
    return documents(spark, sf).selectExpr(
        "doc_id", "ord",
        "concat(text, ' no ', lpad(cast(doc_id * 7919 as string), 16, '4'), ', ', lpad(cast(doc_id * 10 as string), 16, '4')) as text",
    )


@query("detect_batch_function", _LUHN)
def detect_batch_function(spark, sf):
    """A detector in Python, with a check digit that no pattern can test."""
    return span_output(batch_detector(account_numbers, ["account"])(_with_numbers(spark, sf)))


@query("scan_batch_function", f"select doc_id, raw_value from ({_LUHN})")
def scan_batch_function(spark, sf):
    """The same detector inside a scan of one type."""
    spans = find_spans(_with_numbers(spark, sf), CASE, extra=batch_detector(account_numbers, ["account"]), include=["account"])
    return spans.select("doc_id", "raw_value")


# a table with columns of all templates; which of its cells each template works on
_CELLS = {
    "UserPrincipalName": "email", "UserId": "username", "subscriber_name": "last_name", "full_name": "last_name", "phone": "phone",
    "recovery_email": "email", "bio": "first_name", "vanity_name": "username", "device_id": "host",
}


@query("template_cells", """
  select t as template, k as row_id, c as "column", v as value from (
    select k, unnest([
      {'t': 'microsoft-signin', 'c': 'UserPrincipalName', 'v': email}, {'t': 'microsoft-audit', 'c': 'UserId', 'v': username},
      {'t': 'isp-connection', 'c': 'subscriber_name', 'v': last_name}, {'t': 'crypto-kyc', 'c': 'full_name', 'v': last_name},
      {'t': 'crypto-kyc', 'c': 'phone', 'v': phone}, {'t': 'google-account', 'c': 'phone', 'v': phone},
      {'t': 'google-account', 'c': 'recovery_email', 'v': email}, {'t': 'telegram-user', 'c': 'bio', 'v': first_name}, {'t': 'telegram-user', 'c': 'phone', 'v': phone},
      {'t': 'meta-records', 'c': 'phone', 'v': phone}, {'t': 'meta-records', 'c': 'vanity_name', 'v': username}], recursive := true)
    from ev_people)""")
def template_cells(spark, sf):
    """The target cells of each of the seven templates."""
    wide = view(spark, sf, "ev_people").selectExpr("k", *[f"{v} as `{c}`" for c, v in _CELLS.items()])
    out = None
    for row in templates(spark).orderBy("name").collect():
        targets = target_columns([c for c in wide.columns if c != "k"], *template_columns(row["name"]))
        own = cells(wide, "k", targets).selectExpr(f"'{row['name']}' as template", "row_id", "column", "value")
        out = own if out is None else out.unionByName(own)
    return out


@query("link_same_value", "select distinct email as raw_value, 'PERSON' || format('{:03d}', c_custkey) as entity_id from ev_people join customer on k = c_custkey join orders on o_custkey = c_custkey")
def link_same_value(spark, sf):
    """Values of the orders that are registered in exactly this spelling belong to that person."""
    people = view(spark, sf, "ev_people").selectExpr(
        f"'{CASE}' as case_id", "k as mapping_id", "format_string('PERSON%03d', k) as entity_id", "email as raw_value"
    )
    asked = table(spark, sf, "orders").join(people, F.expr("o_custkey = mapping_id")).selectExpr(
        "explode(array(raw_value, upper(raw_value))) as raw_value"
    )
    return same_value(asked, people).select("raw_value", "entity_id")


# two registered spellings that are each other's second spelling; who is registered last depends on the customer
_BOTH = """
  select 'case-1' as case_id, 2 * k + (case when k % 2 = 0 then 0 else 1 end) as mapping_id, concat('PERSON', cast(k % 3 as varchar(20))) as entity_id,
    'username' as pii_type, concat('Kim', cast(k as varchar(20))) as raw_value, concat('ANONUSER', cast(2 * k as varchar(20))) as token from ev_people
  union all
  select 'case-1', 2 * k + (case when k % 2 = 0 then 1 else 0 end), concat('PERSON', cast(k % 2 as varchar(20))),
    'username', concat('kim', cast(k as varchar(20))), concat('ANONUSER', cast(2 * k + 1 as varchar(20))) from ev_people"""


@query("replacement_conflicts", f"""
  with r as ({_BOTH}), v as (
    select raw_value as variant, token, entity_id, pii_type, mapping_id, 0 as second from r
    union all select case when raw_value[1] = 'K' then lower(raw_value) else 'K' || raw_value[2:] end, token, entity_id, pii_type, mapping_id, 1 from r)
  select variant, arg_max(token, (entity_id, pii_type, mapping_id, second)) as token from v group by variant""")
def replacement_conflicts(spark, sf):
    """Both spellings are registered: the later one by entity, type and number wins both."""
    view(spark, sf, "ev_people").createOrReplaceTempView("ev_people")
    return replacement_entries(spark.sql(_BOTH), CASE).select("variant", "token")


@query("empty_case_status", """
  select 'case-1' as case_id, count(*) as total_mappings, count(*) as total_entities, cast(0 as bigint) as processed_files,
    cast(0 as bigint) as allowlist_entries from ev_people
  union all select 'case-2', 0, 0, 0, 0""")
def empty_case_status(spark, sf):
    """A new case beside one that holds the account holders' mails."""
    state = empty_case(spark)
    people = view(spark, sf, "ev_people").selectExpr(
        "k as doc_id", "k as ord", "0 as start", "email as raw_value", "'email' as pii_type"
    )
    registry = state["registry"].unionByName(register(people, state["registry"], CASE))
    rows = [case_status(registry, state["ledger"], state["allowlist"], c).withColumn("case_id", F.lit(c)) for c in (CASE, "case-2")]
    return rows[0].unionByName(rows[1])


_STOPPED = "concat(case k % 4 when 0 then 'version ' when 1 then 'sha1 of ' when 2 then 'port ' else 'call ' end, phone, ' now')"


@query("detect_phone_context", """
  select k as doc_id, cast(5 as bigint) as span_start, cast(5 + length(phone) as bigint) as span_end, phone as raw_value, 'phone' as pii_type,
    cast(0.85 as double) as confidence
  from ev_people where k % 4 = 3""")
def detect_phone_context(spark, sf):
    """Numbers after words such as version, hash and port are no phone numbers."""
    docs = view(spark, sf, "ev_people").selectExpr("k as doc_id", "k as ord", f"{_STOPPED} as text")
    return span_output(candidate_spans(docs, pick_rules(["phone"])))


_LINE = "concat('caf', chr(233), ' {k} ', first_name, ' f', chr(252), 'r ', last_name, ' ', chr(176), ' ', email)"


@query("read_corpus_latin1", f"select cast(k as bigint) as k, md5({_LINE.format(k="' || cast(k as varchar(20)) || '")}) as text_hash from ev_people")
def read_corpus_latin1(spark, sf):
    """Files whose bytes aren't UTF-8 are read as Latin-1."""
    root = folder(spark, "latin1")
    line = _LINE.replace("'caf'", "'caf'").replace("' {k} '", "concat(' ', cast(k as string), ' ')")
    rows = view(spark, sf, "ev_people").selectExpr("k % 16 as n", f"{line} as line")
    rows.write.partitionBy("n").option("encoding", "ISO-8859-1").text(root)
    lines = read_corpus(spark, root).selectExpr("explode(split(text, '\\n')) as line").where("line <> ''")
    return lines.selectExpr("cast(regexp_extract(line, ' ([0-9]+) ', 1) as bigint) as k", "md5(line) as text_hash")
