"""Whole-folder jobs and jobs with an allowlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wordlists
from ..operators.columns import anonymize_table
from ..operators.dictionary import hit_rows
from ..operators.registry import empty_case
from ..sources.corpus import list_files, read_corpus
from ..sources.files import write_files
from ..sources.jobs import anonymize_files, anonymize_folder, restore_files, restore_folder
from .corpora import folder, talk_files
from .registry import CASE, documents, query, table, view


_MAIL = "concat('mail c.', cast({k} as varchar(20)), '@talk.example.org')"


def _files(spark, sf):
    """One text file per conversation, a line per turn, and a last line with a mail address of its own."""
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    last = talks.select("conv_id").distinct().selectExpr("conv_id", "1L << 40 as turn", f"{_MAIL.format(k='conv_id')} as text")
    return talk_files(spark, talks.unionByName(last))


def _texts(spark, out):
    return read_corpus(spark, out).selectExpr(
        "cast(regexp_extract(path, 'conv_id(?:=|%3D|%253D)([0-9]+)', 1) as bigint) as conv_id", "md5(text) as text_hash"
    )


def _rewritten(masked: str) -> str:
    """SQL: the files after the job; conversations with ``masked`` lose their address, numbered in path order."""
    return f"""
      with t as (select conv_id, string_agg(text || chr(10), '' order by turn) as body, {_MAIL.format(k='conv_id')} as mail
                 from conversations group by conv_id),
      r as (select conv_id, 'ANONEMAIL' || format('{{:03d}}', row_number() over (order by 'conv_id=' || cast(conv_id as varchar) || '/')) as token
            from t where {masked})
      select conv_id, md5(body || coalesce('mail ' || token, mail) || chr(10)) as text_hash from t left join r using (conv_id)"""


def _job(spark, sf, allowlist=None):
    state = empty_case(spark)
    if allowlist is not None:
        state["allowlist"] = allowlist
    root, out = _files(spark, sf), folder(spark, "anonymized")
    state, summary = anonymize_files(spark, root, out, state, CASE)
    return root, out, state, summary


@query("corpus_job", _rewritten("true"))
def corpus_job(spark, sf):
    """Files in, rewritten files out: list, detect, register, replace, write, mark."""
    return _texts(spark, _job(spark, sf)[1])


@query("corpus_job_summary", """
  select 'processed' as status, count(*) as n, count(*) as n_hits from (select distinct conv_id from conversations)
  union all select 'done before', count(*), 0 from (select distinct conv_id from conversations)""")
def corpus_job_summary(spark, sf):
    """A row per file; a second run finds every file in the ledger."""
    root, _, state, first = _job(spark, sf)
    _, second = anonymize_files(spark, root, folder(spark, "again"), state, CASE)
    rows = first.unionByName(second).groupBy("status")
    return rows.agg(F.count("*").alias("n"), F.sum("n_hits").cast("bigint").alias("n_hits"))


@query("corpus_restore_job", f"""
  select conv_id, md5(string_agg(text || chr(10), '' order by turn) || {_MAIL.format(k='conv_id')} || chr(10)) as text_hash
  from conversations group by conv_id""")
def corpus_restore_job(spark, sf):
    """The rewritten files restored."""
    _, out, state, _ = _job(spark, sf)
    back = folder(spark, "restored")
    restore_files(spark, out, back, state, CASE)
    return _texts(spark, back)


@query("corpus_job_allowlist", _rewritten("conv_id % 2 = 1"))
def corpus_job_allowlist(spark, sf):
    """The addresses of every second conversation are on the allowlist, in other case."""
    even = table(spark, sf, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct()
    listed = even.selectExpr(
        f"'{CASE}' as case_id", f"upper(substring({_MAIL.format(k='conv_id')}, 6)) as value", "'ioc' as value_type", "'' as reason"
    )
    return _texts(spark, _job(spark, sf, listed)[1])


# a path of every kind (hidden file, hidden folder, key=value folder, blank and sign in a name), texts with and without
# a last line break, and empty ones
_PATH = """concat(case conv_id % 5 when 0 then 'k=v/_' when 1 then '.' when 2 then '_d/.e/' when 3 then 'a b%20/' else '' end,
  'c', cast(conv_id as varchar(20)), '.', case conv_id % 3 when 0 then 'txt' when 1 then 'log' else 'csv' end)"""
_BODY = "case when conv_id % 7 = 0 then '' else concat({body}, {mail}, case conv_id % 2 when 0 then chr(10) else '' end) end"
_NAMED = f"""
  select {_PATH} as path, conv_id, {_BODY.format(body="string_agg(text || chr(10), '' order by turn)", mail=_MAIL.format(k='conv_id'))} as text
  from conversations group by conv_id"""


def _named_files(spark, sf):
    """One file per conversation, under names of all kinds."""
    body = "concat(array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), '\n'), '\n')"
    talks = table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr(body).alias("body"))
    text = _BODY.format(body="body", mail=_MAIL.format(k="conv_id"))
    root = folder(spark, "named")
    write_files(talks.selectExpr(f"{_PATH} as path", f"{text} as text"), root)
    return root


@query("read_corpus_all_names", f"""
  select path, sha256(text) as file_hash, md5(text) as text_hash, row_number() over (order by string_split(path, '/')) as ord
  from ({_NAMED})""")
def read_corpus_all_names(spark, sf):
    """Empty files, and names that start with a dot or an underscore, are files like others."""
    return read_corpus(spark, _named_files(spark, sf)).selectExpr("path", "file_hash", "md5(text) as text_hash", "ord")


@query("corpus_restore_bytes", f"select path, sha256(text) as file_hash, strlen(text) as length from ({_NAMED})")
def corpus_restore_bytes(spark, sf):
    """Anonymized and restored by two runs on one state folder: the same paths and the same bytes."""
    root, out, back, state = _named_files(spark, sf), folder(spark, "out"), folder(spark, "back"), folder(spark, "case")
    anonymize_folder(spark, root, out, state, CASE)
    restore_folder(spark, out, back, state, CASE)
    found = list_files(spark, back).join(read_corpus(spark, back).select("path", "file_hash"), "path")
    return found.select("path", "file_hash", "length")


@query("corpus_job_files", f"""
  with t as ({_NAMED}), r as (
    select conv_id, 'ANONEMAIL' || format('{{:03d}}', row_number() over (order by string_split(path, '/'))) as token from t where text <> '')
  select path, md5(replace(text, {_MAIL.format(k='conv_id')}, 'mail ' || token)) as text_hash, 'processed' as status
  from t join r using (conv_id) union all select path, md5(''), 'processed' from t where text = ''""")
def corpus_job_files(spark, sf):
    """Rewritten files stand under the paths of the originals, and each has a row in the summary."""
    out = folder(spark, "out")
    summary = anonymize_folder(spark, _named_files(spark, sf), out, folder(spark, "case"), CASE)
    return read_corpus(spark, out).join(summary, "path").selectExpr("path", "md5(text) as text_hash", "status")


_VISIT = "concat('visit ', cast(k as varchar(20)), ': met ', {name}, ' at noon')"


@query("corpus_job_names", f"""
  with f as (select first_name, min(struct_pack(folder := 'n=' || cast(k % 7 as varchar), k := k)) as first from ev_people
             where length(first_name) >= 4 group by first_name),
  t as (select first_name, 'ANONFIRST' || format('{{:03d}}', row_number() over (order by first)) as token from f)
  select {_VISIT.format(name='coalesce(token, first_name)')} as line from ev_people left join t using (first_name)""")
def corpus_job_names(spark, sf):
    """A folder job with the names of a word list as further spans."""
    people = view(spark, sf, "ev_people")
    root, out = folder(spark, "visits"), folder(spark, "anonymized")
    lines = people.selectExpr("k % 7 as n", "k", f"{_VISIT.format(name='first_name')} as line")
    lines.repartition("n").sortWithinPartitions("n", "k").select("n", "line").write.partitionBy("n").text(root)
    terms = wordlists.clean_terms(people.selectExpr("first_name as term"), "firstname")
    anonymize_files(
        spark, root, out, empty_case(spark), CASE, include=["firstname"], extra=lambda docs: wordlists.loose_names(docs, terms)
    )
    return read_corpus(spark, out).selectExpr("explode(split(text, '\\n')) as line").where("line <> ''")


@query("column_aware_allowlist", """
  select row_id, UserPrincipalName, DisplayName, coalesce(token, DeviceName) as DeviceName
  from ev_table t left join (
    select host, 'ANONHOST' || format('{:03d}', row_number() over (order by min(row_id))) as token
    from ev_table t2 join ev_people on email = t2.UserPrincipalName where k % 2 = 1 and host like 'LAPTOP-%' group by host) n
  on n.host = t.DeviceName""")
def column_aware_allowlist(spark, sf):
    """Only hosts are wanted, and those of every second customer are listed."""
    people = view(spark, sf, "ev_people")
    listed = people.where("k % 2 = 0").selectExpr(
        f"'{CASE}' as case_id", "lower(host) as value", "'hostname' as value_type", "'' as reason"
    )
    out, _ = anonymize_table(
        view(spark, sf, "ev_table"), "row_id", empty_case(spark)["registry"], CASE, template="microsoft-signin", allowlist=listed, include=["hostname"]
    )
    return out.select("row_id", "UserPrincipalName", "DisplayName", "DeviceName")


@query("column_aware_typed", """
  select c_custkey, c_name, 'ANONPHONE' || format('{:03d}', row_number() over (order by c_custkey)) as gsm from customer""")
def column_aware_typed(spark, sf):
    """A target column of numbers is rewritten as text."""
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "cast(c_custkey + 1000 as bigint) as gsm")
    out, _ = anonymize_table(rows, "c_custkey", empty_case(spark)["registry"], CASE, pii_columns=["GSM"])
    return out.select("c_custkey", "c_name", "gsm")


_MEETINGS = "concat('met ', first_name, ' at ', substr(first_name, 1, 3), ' noon')"


@query("column_aware_names", f"""
  with t as (select first_name, 'ANONFIRST' || format('{{:03d}}', row_number() over (order by min(k))) as token
             from ev_people where length(first_name) >= 4 group by first_name)
  select k, case when token is null then {_MEETINGS} else replace({_MEETINGS}, 'met ' || first_name || ' ', 'met ' || token || ' ') end as note
  from ev_people left join t using (first_name)""")
def column_aware_names(spark, sf):
    """Names of a word list inside the cells of a table; names under four letters are too short."""
    people = view(spark, sf, "ev_people")
    terms = wordlists.clean_terms(people.selectExpr("first_name as term"), "firstname")
    out, _ = anonymize_table(
        people.selectExpr("k", f"{_MEETINGS} as note"), "k", empty_case(spark)["registry"], CASE, pii_columns=["note"],
        extra=lambda docs: wordlists.loose_names(docs, terms), include=["firstname"],
    )
    return out


_GUARDED = "case o_orderkey % 4 when 0 then null when 1 then '' when 2 then ' ' else o_orderstatus end"


@query("cell_guards", f"select o_orderkey, {_GUARDED} as mark from orders")
def cell_guards(spark, sf):
    """Cells without a value, blank cells and cells of one character stay as they are."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_GUARDED} as mark")
    out, _ = anonymize_table(rows, "o_orderkey", empty_case(spark)["registry"], CASE, pii_columns=["mark"])
    return out


@query("load_word_list", """
  select distinct 'firstname' as kind, first_name as term from ev_people
  union all select distinct 'lastname', last_name from ev_people
  union all select distinct 'address', last_name || ' street ' || cast(k % 90 + 1 as varchar) from ev_people""")
def load_word_list(spark, sf):
    """Lists in files with differently named columns; blank terms are left out, the others trimmed."""
    people = view(spark, sf, "ev_people")
    columns = {
        "firstname": ("voornaam", "concat('  ', first_name)"),
        "lastname": ("name", "concat(last_name, ' ')"),
        "address": ("street", "concat(last_name, ' street ', cast(k % 90 + 1 as string))"),
    }
    lists = []
    for kind, (name, value) in columns.items():
        path = folder(spark, kind)
        blank = people.selectExpr("k", f"'  ' as {name}")
        people.selectExpr("k", f"{value} as {name}").unionByName(blank).write.csv(path, header=True)
        lists.append(wordlists.load_word_list(spark, path, kind))
    out = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return out.selectExpr("pii_type as kind", "term")


@query("read_corpus_top_level", "select c_name as line from customer")
def read_corpus_top_level(spark, sf):
    """Only files right under a folder, which also has subfolders like ``k=v``."""
    root = _files(spark, sf)
    table(spark, sf, "customer").select("c_name").write.mode("append").text(root)
    lines = read_corpus(spark, root, recursive=False).selectExpr("explode(split(text, '\\n')) as line")
    return lines.where("line <> ''")


@query("dictionary_match_any_script", """
  with d as (select doc_id, '«' || chr(cast(1072 + doc_id % 32 as int)) || chr(cast(1072 + doc_id % 31 as int)) || chr(cast(1072 + doc_id % 29 as int)) || '» 李' as text
             from documents)
  select doc_id, cast(1 as bigint) as span_start, cast(4 as bigint) as span_end, substr(text, 2, 3) as raw_value from d
  union all select doc_id, 6, 7, '李' from d""")
def dictionary_match_any_script(spark, sf):
    """Entries without a Latin letter: one character, and three of another alphabet."""
    alphabet = "".join(chr(1072 + i) for i in range(32))
    letters = [f"substring('{alphabet}', cast(doc_id % {n} as int) + 1, 1)" for n in (32, 31, 29)]
    word = f"concat({', '.join(letters)})"
    docs = documents(spark, sf).selectExpr("doc_id", "ord", f"concat('«', {word}, '» 李') as text")
    entries = docs.selectExpr("substring(text, 2, 3) as variant").distinct().union(docs.selectExpr("'李' as variant").distinct())
    return hit_rows(docs, entries.withColumn("name", F.lit("x")), "name").selectExpr(
        "doc_id", "cast(start as bigint) as span_start", "cast(end as bigint) as span_end", "raw_value"
    )
