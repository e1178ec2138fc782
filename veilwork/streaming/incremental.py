"""Documents that arrive over time.

Each micro-batch registers its new values and is then rewritten; known values keep their tokens. Registry, ledger
and output are written per batch; a batch that is run again replaces its own folders. Known values, entries and paths
are looked up by key in tables under ``lookup``, of which a batch sees the state after the batch before, so a retry
gives the same tokens. One query per case writes the state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import email_local, name_parts, q
from ..operators.dictionary import entry_keys, replace_hits, text_keys, wordless_sizes
from ..operators.registry import REGISTRY_SCHEMA, first_appearances, last_spellings, register, spellings
from ..operators.rewrite import deanonymize, find_spans
from ..plans.staging import stage
from .lookup import BatchState, KeyTable, hashed

DOC_SCHEMA = "doc_id string, ord bigint, path string, text string"


def read_state(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows of a state folder, or those of batches before ``before``."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.drop("batch")


def _write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


_VALUE = REGISTRY_SCHEMA
_ENTRY = "token string, entity_id string, pii_type string, mapping_id bigint, variant string, is_second int"
_PATH = "path string"
_USERS, _NAMES = "('username', 'filepath_user')", "('firstname', 'lastname')"


def _own_keys(value: str = "raw_value") -> str:
    """SQL: the keys under which a registered value is looked up: itself, and by the rules of entity linking."""
    return (
        f"concat(array(concat('raw:', {value})), case when pii_type = 'email' then array(concat('email:', lower({email_local(value)}))) "
        f"when pii_type in {_USERS} then transform({name_parts(value)}, p -> concat('part:', p)) "
        f"when pii_type in {_NAMES} then array(concat('name:', lower({value}))) else array() end)"
    )


def _asked_keys(value: str = "raw_value") -> str:
    """SQL: the keys of known values that a new value may meet."""
    local = email_local(value)
    return (
        f"concat({_own_keys(value)}, case when pii_type = 'email' then array(concat('raw:', {local})) "
        f"when pii_type in {_USERS} then concat(array(concat('email:', lower({value}))), transform({name_parts(value)}, p -> concat('name:', p))) "
        f"when pii_type in {_NAMES} then array(concat('part:', lower({value}))) else array() end)"
    )


def _counters(rows: DataFrame, known: list[dict], case_id: str) -> list[dict]:
    """The highest numbers per type after the new rows; one entry per type."""
    person = F.max(F.expr("try_cast(regexp_extract(entity_id, '^PERSON([0-9]+)$', 1) as bigint)")).alias("person")
    new = rows.groupBy("pii_type").agg(F.max("num").alias("num"), F.max("mapping_id").alias("mapping"), person).collect()
    out = {c["type"]: dict(c) for c in known}
    for r in new:
        old = out.setdefault(r["pii_type"], {"type": r["pii_type"], "num": 0, "mapping": 0, "person": 0})
        for k in ("num", "mapping", "person"):
            old[k] = max(old[k], r[k] or 0)
    return [out[t] for t in sorted(out)]


def anonymize_batch(batch: DataFrame, batch_id: int, state_dir: str, out: str, case_id: str, **options) -> None:
    """One batch of ``docs(doc_id, ord, path, text)``: register its new values, rewrite it, and commit the state.

    A batch doesn't read the registry: it looks up its own values, the values that these may be linked with, the
    entries whose key stands in its texts, and its paths. What it reads and writes follows the batch, not the case.
    """
    spark = batch.sparkSession
    state = BatchState(spark, f"{state_dir}/lookup")
    last = state.before(batch_id)
    live = last.get("live", {})
    values, entries, paths = (
        KeyTable(state, n, schema, live.get(n, [])) for n, schema in (("values", _VALUE), ("entries", _ENTRY), ("paths", _PATH))
    )

    one = batch.groupBy("path").agg(F.min(F.struct("ord", "doc_id", "text")).alias("d"))
    one = stage(one.select("d.doc_id", "d.ord", "path", "d.text").withColumn("h", hashed("path", case_id, "path")), "arrived")
    done = paths.find(one.select("h")).select("path")
    fresh = stage(one.join(done, "path", "left_anti"), "fresh")
    spans = stage(find_spans(fresh.drop("h"), case_id, **options), "spans")

    asked = first_appearances(spans).selectExpr("raw_value", "pii_type", f"explode_outer({_asked_keys()}) as k")
    asked = stage(asked.select(hashed("value", case_id, "k").alias("h")).distinct(), "asked")
    met = stage(values.find(asked), "met")
    numbers = last.get("numbers", [])
    highest = [(case_id, c["mapping"], f"PERSON{c['person']:03d}", c["type"], None, None, c["num"], None) for c in numbers]
    known = met.drop("h").distinct().unionByName(spark.createDataFrame(highest, REGISTRY_SCHEMA))
    new = register(spans, known, case_id)
    _write_batch(new, f"{state_dir}/registry", batch_id)

    own = stage(spellings(new, case_id), "spellings")
    keys = entry_keys(own.select("variant").distinct())
    keyed = own.join(keys, "variant").withColumn("h", hashed("entry", case_id, "_key")).drop("_key")
    sizes = sorted({*last.get("sizes", []), *wordless_sizes(own)})
    there = text_keys(fresh, sizes).select(hashed("entry", case_id, "_key").alias("h"))
    older = entries.find(stage(there, "text-keys") if entries.live else there).drop("h")
    use = stage(last_spellings(older.unionByName(own.select(older.columns))), "entries")
    _write_batch(replace_hits(fresh.drop("h"), use, "token"), out, batch_id)

    # the time is that of the data, so a retry writes the same rows
    marks = fresh.selectExpr(
        f"{q(case_id)} as case_id", "path", "'anonymize' as direction", "sha2(text, 256) as file_hash",
        "cast(null as timestamp) as processed_at",
    )
    _write_batch(marks, f"{state_dir}/ledger", batch_id)

    # of the values under one key only the earliest is ever asked for
    mine = new.selectExpr("*", f"explode({_own_keys()}) as k").withColumn("h", hashed("value", case_id, "k")).drop("k")
    first = mine.join(met.select("h").distinct(), "h", "left_anti").groupBy("h")
    row = F.struct("mapping_id", *[c for c in new.columns if c != "mapping_id"])
    first = first.agg(F.min(row).alias("r")).select("h", "r.*").select("h", *new.columns)
    now = {
        "values": values.add(first, batch_id),
        "entries": entries.add(keyed.select("h", *older.columns), batch_id),
        "paths": paths.add(fresh.select("h", "path"), batch_id),
    }
    # generations that were merged are kept for a retry of this batch and dropped by the next one
    names = lambda x: {g["name"] for own in x.values() for g in own}
    spare = sorted(names(live) - names(now))
    state.commit(batch_id, {"live": now, "numbers": _counters(new, numbers, case_id), "sizes": sizes, "spare": spare})
    state.drop(last.get("spare", []))


def anonymize_stream(docs: DataFrame, state_dir: str, out: str, case_id: str, **options) -> DataStreamWriter:
    """Writer that anonymizes a stream of documents; start it with a checkpoint location.

    Documents whose path the case has seen are skipped. Of several documents with one path in a batch
    the one with the smallest ``(ord, doc_id, text)`` counts, so a retry makes the same choice. ``options`` are
    those of ``find_spans`` (allowlist, further spans, types, entropy).
    """
    return docs.writeStream.foreachBatch(lambda batch, n: anonymize_batch(batch, n, state_dir, out, case_id, **options))


def deanonymize_stream(docs: DataFrame, registry: DataFrame, out: str, case_id: str) -> DataStreamWriter:
    """Writer that restores a stream of documents from a fixed registry."""

    def run(batch: DataFrame, batch_id: int) -> None:
        _write_batch(deanonymize(batch, registry, case_id), out, batch_id)

    return docs.writeStream.foreachBatch(run)


def without_replays(docs: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """Drop documents seen before with the same path and content, within the watermark ``horizon``."""
    return (
        docs.withColumn("file_hash", F.expr("sha2(text, 256)"))
        .withWatermark(event_time, horizon)
        .dropDuplicatesWithinWatermark(["path", "file_hash"])
    )
