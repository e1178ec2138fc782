"""Column-aware jobs and table sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import COLUMN_TYPE_DEFAULT, COLUMN_TYPE_HINTS
from ..operators.columns import (
    all_text_cells,
    anonymize_table,
    column_type,
    replace_cells,
    replace_database,
    restore_table,
    rewrite_cells,
)
from ..operators.registry import register
from ..plans import stage
from .registry import CASE, first_empty, query, table, view
from .sqltools import lit

# first appearance of everything an account table registers: mails of the rows, then whole cells
_TABLE_REGISTRY = """
  mails as (select email as v, row_number() over (order by min(row_id)) as num
            from ev_table t join (select distinct email from ev_people) on UserPrincipalName = email group by email),
  cell as (
    select v, min((row_id, pos)) as o from (
      select row_id, 0 as pos, DisplayName as v from ev_table union all select row_id, 1, DeviceName from ev_table) group by v),
  hosts as (select distinct DeviceName as v from ev_table where DeviceName like 'LAPTOP-%'),
  host_first as (select DeviceName as v, min(row_id) as o from ev_table where DeviceName like 'LAPTOP-%' group by 1),
  reg as materialized (
    select v, 'ANONEMAIL' || format('{:03d}', num) as token from mails
    union all
    select v, 'ANONHOST' || format('{:03d}', row_number() over (order by o)) from host_first
    union all
    select v, 'ANONNAME' || format('{:03d}', row_number() over (order by o)) from cell where v not in (select v from hosts))"""


def _anonymized(spark, sf):
    return anonymize_table(view(spark, sf, "ev_table"), "row_id", first_empty(spark), CASE, template="microsoft-signin")


@query("column_aware_table", f"""
  with {_TABLE_REGISTRY.strip()}
  select row_id, Timestamp, u.token as UserPrincipalName, n.token as DisplayName, IPAddress, Status, d.token as DeviceName, Amount
  from ev_table t join reg u on u.v = t.UserPrincipalName join reg n on n.v = t.DisplayName join reg d on d.v = t.DeviceName""")
def column_aware_table(spark, sf):
    """Template columns: known value, detected value, or the whole cell by column type."""
    out, _ = _anonymized(spark, sf)
    return out


@query("column_aware_registry", f"with {_TABLE_REGISTRY.strip()} select v as raw_value, token from reg")
def column_aware_registry(spark, sf):
    _, registry = _anonymized(spark, sf)
    return registry.select("raw_value", "token")


@query("column_aware_restore", "select row_id, UserPrincipalName, DisplayName, DeviceName from ev_table")
def column_aware_restore(spark, sf):
    out, registry = _anonymized(spark, sf)
    columns = ["UserPrincipalName", "DisplayName", "DeviceName"]
    return restore_table(stage(out, "table"), "row_id", registry, CASE, columns).select("row_id", *columns)


@query("column_aware_restore_types", f"""
  with {_TABLE_REGISTRY.strip()}
  select row_id, t.UserPrincipalName, n.token as DisplayName, d.token as DeviceName
  from ev_table t join reg n on n.v = t.DisplayName join reg d on d.v = t.DeviceName""")
def column_aware_restore_types(spark, sf):
    """Only mails come back."""
    out, registry = _anonymized(spark, sf)
    columns = ["UserPrincipalName", "DisplayName", "DeviceName"]
    return restore_table(stage(out, "table"), "row_id", registry, CASE, columns, ["email"]).select("row_id", *columns)


def _mail_registry(spark, sf):
    people = view(spark, sf, "ev_people").selectExpr(
        "k as doc_id", "k as ord", "0 as start", "email as raw_value", "'email' as pii_type"
    )
    return register(people, first_empty(spark), CASE)


@query("replace_only_table", """
  with r as (select email, 'ANONEMAIL' || format('{:03d}', row_number() over (order by k)) as token from ev_people)
  select row_id, token as UserPrincipalName, DisplayName, DeviceName, Status from ev_table join r on email = UserPrincipalName""")
def replace_only_table(spark, sf):
    """Registered values are replaced in the kept columns' complement; nothing new is registered."""
    out = replace_cells(
        view(spark, sf, "ev_table"), "row_id", ["UserPrincipalName", "DisplayName", "DeviceName"],
        _mail_registry(spark, sf), CASE,
    )
    return out.select("row_id", "UserPrincipalName", "DisplayName", "DeviceName", "Status")


def _tables(spark, sf):
    names = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "orders": "o_orderkey"}
    return {n: table(spark, sf, n) for n in names}, names


@query("all_text_cells", """
  select 'customer' as "table", cast(c_custkey as varchar) as row_id, unnest(['c_name', 'c_mktsegment']) as "column", unnest([c_name, c_mktsegment]) as value from customer
  union all select 'supplier', cast(s_suppkey as varchar), 's_name', s_name from supplier
  union all select 'nation', cast(n_nationkey as varchar), 'n_name', n_name from nation
  union all select 'orders', cast(o_orderkey as varchar), unnest(['o_orderstatus', 'o_orderpriority']), unnest([o_orderstatus, o_orderpriority]) from orders""")
def q_all_text_cells(spark, sf):
    """Every string column of every table as cells."""
    return all_text_cells(*_tables(spark, sf))


@query("column_types", """
  select col as "column", 'name' as pii_type, n from (
    select 'c_name' as col, count(*) as n from customer union all select 'c_mktsegment', count(*) from customer
    union all select 's_name', count(*) from supplier union all select 'n_name', count(*) from nation
    union all select 'o_orderstatus', count(*) from orders union all select 'o_orderpriority', count(*) from orders)""")
def q_column_types(spark, sf):
    """Type of each column by its name, with its number of cells."""
    cells = all_text_cells(*_tables(spark, sf))
    return cells.groupBy("column").agg(F.count("*").alias("n")).selectExpr("column", f"{column_type()} as pii_type", "n")


def _type_case(name: str) -> str:
    whens = " ".join(
        "when " + " or ".join(f"contains(lower({name}), {lit(w)})" for w in words) + f" then {lit(t)}" for words, t in COLUMN_TYPE_HINTS
    )
    return f"case {whens} else {lit(COLUMN_TYPE_DEFAULT)} end"


@query("column_type_hints", f"""
  select {_type_case('word')} as pii_type, count(*) as n_names, min(word) as first_name
  from (select distinct unnest(string_split(text, ' ')) as word from documents) group by 1""")
def column_type_hints(spark, sf):
    """All words of the documents as if they were column names."""
    words = table(spark, sf, "documents").selectExpr("explode(split(text, ' ')) as word").distinct()
    return words.groupBy(F.expr(column_type("word")).alias("pii_type")).agg(
        F.count("*").alias("n_names"), F.min("word").alias("first_name")
    )


@query("rewrite_cells", """
  select o_orderkey, 'o_orderstatus:' || lower(o_orderstatus) as o_orderstatus, 'o_orderpriority:' || lower(o_orderpriority) as o_orderpriority
  from orders""")
def q_rewrite_cells(spark, sf):
    """Cells rewritten by an own function of cell and column name."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return rewrite_cells(
        orders, ["O_ORDERSTATUS", "o_orderpriority"], lambda cell, name: F.concat(F.lit(name + ":"), F.lower(cell))
    )


def _segments(spark, sf):
    """A registry of all segment and supplier names."""
    segments = table(spark, sf, "customer").selectExpr("c_mktsegment as v").distinct()
    suppliers = table(spark, sf, "supplier").selectExpr("s_name as v")
    return segments.union(suppliers).selectExpr(
        f"'{CASE}' as case_id", "v as entity_id", "'name' as pii_type", "v as raw_value",
        "concat('TOK', substr(md5(v), 1, 8)) as token", "1L as mapping_id", "1L as num", "'' as source_doc",
    )


@query("replace_database", """
  select 'customer' as "table", c_custkey as row_id, c_name as a, 'TOK' || substr(md5(c_mktsegment), 1, 8) as b, c_acctbal as num from customer
  union all select 'supplier', s_suppkey, 'TOK' || substr(md5(s_name), 1, 8), '', s_acctbal from supplier
  union all select 'orders', o_orderkey, o_orderstatus, o_orderpriority, o_totalprice from orders
  union all select 'nation', n_nationkey, n_name, '', n_regionkey from nation""")
def q_replace_database(spark, sf):
    """String columns of all tables rewritten, other types untouched."""
    tables, ids = _tables(spark, sf)
    out = replace_database(tables, ids, _segments(spark, sf), CASE)
    shown = {
        "customer": ("c_name", "c_mktsegment", "c_acctbal"), "supplier": ("s_name", "''", "s_acctbal"),
        "orders": ("o_orderstatus", "o_orderpriority", "o_totalprice"), "nation": ("n_name", "''", "cast(n_regionkey as double)"),
    }
    parts = [
        out[name].selectExpr(f"'{name}' as table", f"cast({ids[name]} as bigint) as row_id", f"{a} as a", f"{b} as b", f"{n} as num")
        for name, (a, b, n) in shown.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
