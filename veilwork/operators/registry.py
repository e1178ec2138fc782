"""Token registry: one row per distinct value of a case.

``registry(case_id, mapping_id, entity_id, pii_type, raw_value, token, num, source_doc)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import TOKEN_PREFIXES, UNKNOWN_PREFIX
from ..functions.text import case_variant, q
from ..plans import sequence_table, stage, with_dense_number, with_group_number
from .entities import link_entities

REGISTRY_SCHEMA = (
    "case_id string, mapping_id bigint, entity_id string, pii_type string, raw_value string, "
    "token string, num bigint, source_doc string"
)
ENTITY_SCHEMA = "case_id string, entity_id string, entity_type string, notes string"
ALLOWLIST_SCHEMA = "case_id string, value string, value_type string, reason string"
LEDGER_SCHEMA = "case_id string, path string, direction string, file_hash string, processed_at timestamp"


def empty_case(spark: SparkSession) -> dict[str, DataFrame]:
    """State tables of a new case."""
    schemas = {
        "registry": REGISTRY_SCHEMA,
        "entities": ENTITY_SCHEMA,
        "allowlist": ALLOWLIST_SCHEMA,
        "ledger": LEDGER_SCHEMA,
    }
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}


def token_prefix(pii_type: str = "pii_type") -> str:
    cases = " ".join(f"when {q(t)} then {q(p)}" for t, p in TOKEN_PREFIXES.items())
    return f"case {pii_type} {cases} else {q(UNKNOWN_PREFIX)} end"


def token_text(prefix: str = "prefix", num: str = "num") -> str:
    return f"format_string('%s%03d', {prefix}, {num})"


def first_appearances(spans: DataFrame) -> DataFrame:
    """Distinct values with the type and place of their first appearance.

    ``min`` over a struct combines map-side, so a value that fills a third of all rows costs one row per
    task in the shuffle.
    """
    first = F.min(F.struct("ord", "start", "pii_type", F.col("doc_id").cast("string").alias("doc")))
    return (
        spans.groupBy("raw_value")
        .agg(first.alias("f"))
        .selectExpr("raw_value", "f.ord as ord", "f.start as start", "f.pii_type as pii_type", "f.doc as source_doc")
    )


def next_numbers(registry: DataFrame) -> DataFrame:
    """Next free number per case and token prefix."""
    return (
        registry.groupBy("case_id", F.expr(token_prefix()).alias("prefix"))
        .agg((F.max("num") + 1).alias("next_num"))
    )


def number_tokens(values: DataFrame, registry: DataFrame, case_id: str, name: str = "values") -> DataFrame:
    """Number new values per prefix in first-appearance order, after the stored maximum.

    ``username`` and ``filepath_user`` share a prefix and therefore one counter. ``part`` and ``loc`` are
    the place in the order, for further numbering.
    """
    seq = sequence_table(
        values.withColumn("prefix", F.expr(token_prefix())), ["ord", "start", "raw_value"], name
    )
    known = registry.where(F.col("case_id") == case_id)
    last = known.agg(F.coalesce(F.max("mapping_id"), F.lit(0))).scalar()
    taken = next_numbers(known).select("prefix", (F.col("next_num") - 1).alias("_taken"))
    numbered = with_group_number(with_dense_number(seq, "seq"), "prefix", "num")
    return (
        numbered.join(F.broadcast(taken), "prefix", "left")
        .withColumn("num", F.col("num") + F.coalesce("_taken", F.lit(0)))
        .withColumn("mapping_id", F.col("seq") + last)
        .withColumn("token", F.expr(token_text()))
        .drop("_taken", "seq", "prefix")
    )


def register(
    spans: DataFrame,
    registry: DataFrame,
    case_id: str,
) -> DataFrame:
    """New registry rows for the values in ``spans`` that the case does not hold yet (staged)."""
    known = registry.where(F.col("case_id") == case_id)
    fresh = first_appearances(spans).join(known.select("raw_value"), "raw_value", "left_anti")
    values = stage(number_tokens(fresh, registry, case_id), "new-values")
    rows = link_entities(values, known).selectExpr(
        f"{q(case_id)} as case_id", "mapping_id", "entity_id", "pii_type", "raw_value", "token", "num", "source_doc"
    )
    return stage(rows, "registered")


def create_entities(registry: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities`` plus a person row for each entity of the registry that has none."""
    fresh = (
        registry.select("case_id", "entity_id")
        .distinct()
        .join(entities, ["case_id", "entity_id"], "left_anti")
        .selectExpr("case_id", "entity_id", "'person' as entity_type", "'' as notes")
    )
    return entities.unionByName(fresh)


def spellings(registry: DataFrame, case_id: str) -> DataFrame:
    """``(token, entity_id, pii_type, mapping_id, variant, is_second)``: each value and its second spelling."""
    known = registry.where(F.col("case_id") == case_id)
    return known.selectExpr(
        "token", "entity_id", "pii_type", "mapping_id",
        f"inline(array(struct(raw_value as variant, 0 as is_second), "
        f"struct({case_variant('raw_value')} as variant, 1 as is_second)))",
    ).where("variant is not null")


def replacement_entries(registry: DataFrame, case_id: str) -> DataFrame:
    """``(variant, token)``: each value and its second spelling; a later mapping wins a shared spelling."""
    return last_spellings(spellings(registry, case_id))


def last_spellings(variants: DataFrame) -> DataFrame:
    last = F.max(F.struct("entity_id", "pii_type", "mapping_id", "is_second", "token")).alias("w")
    return variants.groupBy("variant").agg(last).selectExpr("variant", "w.token as token")


def by_token(registry: DataFrame, case_id: str, token: str) -> DataFrame:
    return registry.where((F.col("case_id") == case_id) & (F.col("token") == token))


def by_entity(registry: DataFrame, case_id: str, entity_id: str) -> DataFrame:
    return registry.where((F.col("case_id") == case_id) & (F.col("entity_id") == entity_id))


def by_types(registry: DataFrame, case_id: str, pii_types: list[str]) -> DataFrame:
    """Mappings of the given types; no types, no rows."""
    return registry.where((F.col("case_id") == case_id) & F.col("pii_type").isin(pii_types))


def protect_at_rest(registry: DataFrame, key: DataFrame) -> DataFrame:
    """Encrypt raw values; ``value_hash`` (salted) stays usable as a join key.

    ``key`` is a one-row table ``(key binary, salt string)``, so the key is data and not plan text.
    """
    secret, salt = key.select("key").scalar(), key.select("salt").scalar()
    return (
        registry.withColumn("raw_cipher", F.base64(F.aes_encrypt("raw_value", secret)))
        .withColumn("value_hash", F.sha2(F.concat("raw_value", salt), 256))
        .drop("raw_value")
    )


def open_at_rest(protected: DataFrame, key: DataFrame) -> DataFrame:
    """Decrypt; a wrong key gives null values, not an error."""
    secret = key.select("key").scalar()
    opened = F.try_aes_decrypt(F.unbase64("raw_cipher"), secret).cast("string")
    return protected.withColumn("raw_value", opened).drop("raw_cipher", "value_hash")
