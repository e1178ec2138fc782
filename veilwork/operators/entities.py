"""Entity linking: values of one person share an entity.

Each new value points to at most one earlier value, chosen by rule order and then by the earliest value.
The pointers form a forest; a value takes the entity of its root. Two known persons are never merged
automatically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import email_local, in_list, name_parts
from ..plans import lookup_join, stage, with_group_number

_USER_TYPES = ["username", "filepath_user"]
_NAME_TYPES = ["firstname", "lastname"]


def _earliest(rows: DataFrame, key: str) -> DataFrame:
    """``(k, parent)``: the earliest value under each key; ``min`` combines map-side."""
    return rows.selectExpr(f"{key} as k", "mapping_id").groupBy("k").agg(F.min("mapping_id").alias("parent"))


def parent_candidates(values: DataFrame, known: DataFrame) -> DataFrame:
    """``(mapping_id, parent, rule, place)`` for new ``values``, all rules.

    A parent must be earlier than its child. The lookup keeps only the earliest value per key: if that
    one is not earlier, none is. So every rule is a join against a table with one row per key.
    """
    pool = known.select("mapping_id", "pii_type", "raw_value").unionByName(
        values.select("mapping_id", "pii_type", "raw_value")
    )
    emails = pool.where("pii_type = 'email'")
    users = pool.where(in_list("pii_type", _USER_TYPES))
    names = pool.where(in_list("pii_type", _NAME_TYPES))
    user_parts = users.selectExpr("mapping_id", f"explode({name_parts('raw_value')}) as part")

    # child side: one row per key a child asks for, with the rule and the place of the key in the value
    local = email_local("raw_value")
    asks = values.selectExpr(
        "mapping_id",
        f"""inline(case
              when pii_type = 'email' and {local} <> '' then array(
                named_struct('rule', 1, 'place', 0, 'table', 'raw', 'k', {local}),
                named_struct('rule', 2, 'place', 0, 'table', 'email', 'k', lower({local})))
              when {in_list('pii_type', _USER_TYPES)} then concat(
                array(named_struct('rule', 3, 'place', 0, 'table', 'email', 'k', lower(raw_value))),
                if(size({name_parts('raw_value')}) >= 2,
                   transform({name_parts('raw_value')},
                             (p, i) -> named_struct('rule', 4, 'place', i, 'table', 'name', 'k', p)),
                   array()))
              when {in_list('pii_type', _NAME_TYPES)} then array(
                named_struct('rule', 5, 'place', 0, 'table', 'part', 'k', lower(raw_value)))
            end)""",
    )
    lookups = (
        _earliest(pool, "raw_value").withColumn("table", F.lit("raw"))
        .unionByName(_earliest(emails, f"lower({local})").withColumn("table", F.lit("email")))
        .unionByName(_earliest(names, "lower(raw_value)").withColumn("table", F.lit("name")))
        .unionByName(_earliest(user_parts, "part").withColumn("table", F.lit("part")))
    )
    asks = asks.selectExpr("mapping_id", "rule", "place", "concat(`table`, ':', k) as k")
    lookups = lookups.selectExpr("concat(`table`, ':', k) as k", "parent")
    return (
        lookup_join(asks, lookups, "k")
        .where("parent < mapping_id")
        .select("mapping_id", "rule", "place", "parent")
    )


def same_value(values: DataFrame, known: DataFrame) -> DataFrame:
    """``(raw_value, entity_id, mapping_id)`` of the values that the case holds already, in exactly this spelling.

    Registration skips such values before any linking; this is the direct look-up.
    """
    asked = values.select("raw_value").distinct()
    return asked.join(known.select("raw_value", "entity_id", "mapping_id"), "raw_value")


def choose_parent(candidates: DataFrame) -> DataFrame:
    """One parent per value: first rule, first place in the value, earliest parent."""
    best = F.min(F.struct("rule", "place", "parent")).alias("b")
    return candidates.groupBy("mapping_id").agg(best).selectExpr("mapping_id", "b.parent as parent", "b.rule as rule")


def forest_roots(parents: DataFrame, stage_every: int = 3) -> DataFrame:
    """``(mapping_id, root_id)`` by pointer jumping: the distance to the root halves in every round."""
    links = stage(parents.select("mapping_id", F.col("parent").alias("root_id")), "links")
    rounds = 0
    while True:
        step = links.select(F.col("mapping_id").alias("root_id"), F.col("root_id").alias("_next"))
        jumped = lookup_join(links, step, "root_id").selectExpr(
            "mapping_id", "coalesce(_next, root_id) as root_id", "_next is not null as _moved"
        )
        rounds += 1
        if rounds % stage_every and rounds > 1:
            links = jumped.drop("_moved")
            continue
        jumped = stage(jumped, "links")
        links = jumped.drop("_moved")
        if jumped.where("_moved").limit(1).isEmpty():
            break
    return links


def new_person_ids(values: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """``values`` with the entity of their root: that of a known root, or the next free person.

    ``values`` carry their place in the order (``part``, ``loc``), so new persons are numbered in the
    order of their first value without another sort.
    """
    # rows without a value only carry the highest numbers
    known_roots = known.where("raw_value is not null").selectExpr("mapping_id as root_id", "entity_id as _known")
    rooted = values.join(roots, "mapping_id", "left").withColumn("root_id", F.coalesce("root_id", "mapping_id"))
    rooted = rooted.join(known_roots, "root_id", "left")
    last = known.agg(
        F.coalesce(
            F.max(F.expr("try_cast(regexp_extract(entity_id, '^PERSON([0-9]+)$', 1) as bigint)")), F.lit(0)
        )
    ).scalar()
    heads = rooted.where("root_id = mapping_id").selectExpr("mapping_id", "part", "loc", "true as is_root")
    persons = (
        with_group_number(heads, "is_root", "_n")
        .withColumn("_n", F.col("_n") + last)
        .selectExpr("mapping_id as root_id", "format_string('PERSON%03d', _n) as _fresh")
    )
    return (
        lookup_join(rooted, persons, "root_id")
        .withColumn("entity_id", F.coalesce("_known", "_fresh"))
        .drop("_known", "_fresh", "root_id")
    )


def link_entities(values: DataFrame, known: DataFrame) -> DataFrame:
    """``values`` with ``entity_id``."""
    parents = choose_parent(parent_candidates(values, known))
    return new_person_ids(values, forest_roots(parents), known)


def merge_entities(registry: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual links ``(case_id, keep, merge)``: all values of ``merge`` move to ``keep``.

    Chains of links are followed to their end first. A link of a person to itself does nothing. Of several links
    for one person the last given counts: the one with the largest ``n`` if ``links`` has that column, else the
    largest ``keep``. Links that form a cycle have no end and raise ``ValueError``.
    """
    given = links if "n" in links.columns else links.withColumn("n", F.lit(0))
    one = (
        given.where("merge <> keep").groupBy("case_id", "merge").agg(F.max(F.struct("n", "keep")).alias("last"))
    )
    final = stage(one.selectExpr("case_id", "merge", "last.keep as keep", "false as _moved"), "merges")
    reach, longest = 1, final.count()
    while True:
        if reach > 2 * longest + 2 or not final.where("merge = keep").limit(1).isEmpty():
            raise ValueError("the links form a cycle")
        reach *= 2
        step = final.selectExpr("case_id", "merge as keep", "keep as _next")
        jumped = final.drop("_moved").join(step, ["case_id", "keep"], "left").selectExpr(
            "case_id", "merge", "coalesce(_next, keep) as keep", "_next is not null as _moved"
        )
        final = stage(jumped, "merges")
        if final.where("_moved").limit(1).isEmpty():
            break
    target = final.selectExpr("case_id", "merge as entity_id", "keep")
    moved = registry.join(target, ["case_id", "entity_id"], "left").withColumn(
        "entity_id", F.coalesce("keep", "entity_id")
    )
    left = entities.join(target, ["case_id", "entity_id"], "left_anti")
    return moved.select(*registry.columns), left
