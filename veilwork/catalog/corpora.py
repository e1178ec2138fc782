"""Files as corpora and tables, and documents that arrive over time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.audit import inconsistent_mappings
from ..operators.detect import detect
from ..operators.registry import REGISTRY_SCHEMA, register
from ..operators.rewrite import anonymize, deanonymize
from ..plans import stage, stage_root
from ..plans.spread import spread
from ..sources.corpus import list_files, read_corpus, read_table, read_values, write_corpus
from ..sources.files import write_files
from ..sources.tables import read_delimited
from ..streaming.incremental import anonymize_stream, deanonymize_stream, read_state, without_replays
from .registry import CASE, documents, first_empty, query, table
from .rewriting import DOC_REGISTRY


def folder(spark, name):
    return f"{stage_root(spark)}/veilwork/{name}-{uuid.uuid4().hex}"


def talk_files(spark, lines):
    """One folder ``conv_id=…`` with one text file per conversation of ``lines(conv_id, turn, text)``, a line break after each turn.

    Tasks write the files under their final names: a partitioned write would have the driver move every folder by itself.
    """
    root = folder(spark, "talks")
    body = "concat(array_join(transform(array_sort(collect_list(struct(turn, text))), x -> coalesce(x.text, '')), '\n'), '\n')"
    talks = lines.groupBy("conv_id").agg(F.expr(body).alias("text"))
    name = "concat('conv_id=', coalesce(cast(conv_id as string), '__HIVE_DEFAULT_PARTITION__'), '/part-00000.txt')"
    write_files(talks.selectExpr(f"{name} as path", "text"), root)
    return root


def _talks(spark, sf):
    return talk_files(spark, table(spark, sf, "conversations").select("conv_id", "turn", "text"))


_TALKS = "select conv_id, string_agg(text || chr(10), '' order by turn) as text from conversations group by conv_id"


@query("read_corpus", f"""
  select 'conv_id=' || cast(conv_id as varchar) as folder, md5(text) as text_hash, sha256(text) as file_hash,
    row_number() over (order by 'conv_id=' || cast(conv_id as varchar) || '/') as ord
  from ({_TALKS})""")
def q_read_corpus(spark, sf):
    """Text files in path order, decoded, with their content hash."""
    docs = read_corpus(spark, _talks(spark, sf))
    return docs.selectExpr("split_part(path, '/', 1) as folder", "md5(text) as text_hash", "file_hash", "ord")


@query("list_files", f"select 'conv_id=' || cast(conv_id as varchar) as folder, cast(strlen(text) as bigint) as length from ({_TALKS})")
def q_list_files(spark, sf):
    return list_files(spark, _talks(spark, sf)).selectExpr("split_part(path, '/', 1) as folder", "length")


@query("read_table", """
  select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, c_mktsegment from customer""")
def q_read_table(spark, sf):
    """A delimited file with header, all columns as strings."""
    path = folder(spark, "customer") + ".tsv"
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows.write.csv(path, header=True, sep="\t")
    return read_table(spark, path).drop("row_id")


@query("read_table_blocks", """
  select cast(row_number() over (order by doc_id) - 1 as bigint) as row_id, cast(doc_id as varchar) as doc_id, lang, md5(text) as text_hash
  from documents""")
def read_table_blocks(spark, sf):
    """Whole texts as quoted cells with line breaks and quotes, in one file that is read in small blocks."""
    quoted = "concat(doc_id, ',', lang, ',\"', replace(text, '\"', '\"\"'), '\"')"
    rows = table(spark, sf, "documents").orderBy("doc_id").selectExpr(f"{quoted} as line", "doc_id")
    body = rows.selectExpr("doc_id div 500 as n", "doc_id", "line").groupBy("n").agg(
        F.expr("concat('doc_id,lang,text\n', array_join(transform(array_sort(collect_list(struct(doc_id, line))), x -> x.line), '\n'))").alias("text")
    )
    path = folder(spark, "texts") + ".csv"
    write_files(body.selectExpr("concat('part-', lpad(n, 9, '0'), '.csv') as path", "text"), path)
    out = read_delimited(spark, path, ",", block_bytes=1 << 16)
    return out.selectExpr("row_id", "doc_id", "lang", "md5(text) as text_hash")


@query("read_values", "select distinct trim(c_mktsegment) as value from customer")
def q_read_values(spark, sf):
    """One column of a CSV file as a list of protected values."""
    path = folder(spark, "values") + ".csv"
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment").write.csv(path)
    return read_values(spark, path, 1).select("value")


@query("write_corpus", "select 'case-1' as case_id, doc_id, md5(text) as text_hash from documents")
def q_write_corpus(spark, sf):
    """Documents written as a new table partitioned by case."""
    out = folder(spark, "corpus")
    write_corpus(documents(spark, sf), out, CASE)
    return spark.read.parquet(out).selectExpr("case_id", "doc_id", "md5(text) as text_hash")


def _arrivals(spark, sf):
    """The documents in three parts that a stream reads one at a time, each in as many files as the table has splits."""
    arrived = folder(spark, "arrivals")
    docs = spread(table(spark, sf, "documents"))
    files = docs.rdd.getNumPartitions()
    for i in range(3):
        part = docs.where(F.col("doc_id") % 3 == i).selectExpr(
            "cast(doc_id as string) as doc_id", "doc_id as ord", "concat('d/', doc_id) as path", "text"
        )
        part.repartition(files).write.mode("append").parquet(arrived)
    return spark.readStream.schema("doc_id string, ord bigint, path string, text string").option(
        "maxFilesPerTrigger", files
    ).parquet(arrived)


def _run(writer, spark):
    writer.option("checkpointLocation", folder(spark, "query")).trigger(availableNow=True).start().awaitTermination()


@query("stream_anonymize", f"""
  with r as materialized (select v, token from ({DOC_REGISTRY}))
  select cast(doc_id as varchar) as doc_id, md5(text) as restored_hash,
    coalesce((select count(*) from r where contains(d.text, r.v)), 0) = 0 as untouched, true as one_token
  from documents d""")
def stream_anonymize(spark, sf):
    """Arriving documents: each batch registers its values and is rewritten with all known ones.

    Token numbers depend on the order of arrival, so the check is on what doesn't: every text comes back
    unchanged, texts without a value stay as they are, and every value has one token.
    """
    state, out = folder(spark, "state"), folder(spark, "out")
    _run(anonymize_stream(_arrivals(spark, sf), state, out, CASE), spark)
    registry = read_state(spark, f"{state}/registry", REGISTRY_SCHEMA)
    rewritten = spark.read.parquet(out).select("doc_id", "ord", "text", "n_hits")
    back = deanonymize(rewritten, registry, CASE).selectExpr("doc_id", "md5(text) as restored_hash")
    unclear = inconsistent_mappings(registry).agg((F.count("*") == 0).alias("ok")).scalar()
    return rewritten.join(back, "doc_id").select(
        "doc_id", "restored_hash", F.expr("n_hits = 0").alias("untouched"), unclear.alias("one_token")
    )


@query("stream_restore", "select cast(doc_id as varchar) as doc_id, md5(text) as text_hash from documents")
def stream_restore(spark, sf):
    """A stream of rewritten documents restored from a fixed registry."""
    docs = documents(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    registry = register(detect(docs, protect=True).drop("left_ctx", "right_ctx"), first_empty(spark), CASE)
    source, out = folder(spark, "rewritten"), folder(spark, "out")
    anonymize(docs, registry, CASE).select("doc_id", "text").write.parquet(source)
    rewritten = spark.readStream.schema("doc_id string, text string").parquet(source)
    _run(deanonymize_stream(rewritten, registry, out, CASE), spark)
    return spark.read.parquet(out).selectExpr("doc_id", "md5(text) as text_hash")


@query("stream_without_replays", "select doc_id, md5(text) as text_hash from documents")
def stream_without_replays(spark, sf):
    """Every document is sent twice and kept once."""
    sent = stage(
        table(spark, sf, "documents").selectExpr(
            "doc_id", "concat('d/', doc_id) as path", "text",
            "explode(array(timestamp'2026-01-01 00:00:00', timestamp'2026-01-01 00:05:00')) as sent_at",
        ),
        "sent",
    )
    stream = spark.readStream.schema(sent.schema).parquet(sent.inputFiles()[0].rsplit("/", 1)[0])
    out = folder(spark, "out")
    writer = without_replays(stream, "sent_at", "1 hour").writeStream.format("parquet").option("path", out)
    _run(writer, spark)
    return spark.read.parquet(out).selectExpr("doc_id", "md5(text) as text_hash")
