"""Registered queries of the operators, with their SQL checks (DuckDB)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage, stage_root
from . import langid, prefixes, quality, toxicity
from .chat import format_paths, read_turns
from .divergence import divergence
from .exact import exact_groups, new_index
from .mixing import mix
from .simhash import near_groups
from .substring import substring_dedup
from .tiling import COVERAGE, contaminated
from .tokens import count_tokens
from .urls import canonical, judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Window of substring dedup, in words.
PHRASE_WORDS = 20
#: Grade (0 toxic, 1 poor, 2 good) to be reached, and the least probability of that, for a document to be kept.
GOOD_GRADE, GOOD_PROB = 2, 0.5
#: Words of a shingle and most differing bits of linked fingerprints.
SHINGLE_WORDS, LINK_BITS = 3, 3
#: Tokens over which a document is too long.
TOKEN_LIMIT = 1024
#: Mixing weights of the sources in their order, share of all words, most copies of a source.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3.0, 1.0, 2.0], 1.5, 2.0
#: Host and path rules of the URL filter.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Host labels whose pages make up the list of URLs to block.
SPAM_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: The conversation that is formatted beside those of the table.
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
    places as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20),
    windows as (select doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) as h from places),
    later as (select doc_id, i from (
      select doc_id, i, row_number() over (partition by h order by doc_id, i) as rn from windows) where rn > 1),
    gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from later),
    kept as (select k.doc_id, string_agg(word, ' ' order by k.j) as text, count(*) as n
      from words k left join gone g on g.doc_id = k.doc_id and g.j = k.j where g.j is null group by k.doc_id)
    select w.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
    from w left join kept using (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), PHRASE_WORDS, with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op2_quality_grade")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")))
    out = quality.grade_documents(docs, model, GOOD_GRADE, GOOD_PROB)
    return out.withColumnRenamed("id", "doc_id")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(docs))
    return out.select(
        F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query(
    "op4_exact_dedup",
    """
    with d as (select doc_id, coalesce(text, '') as text from documents),
    g as (select text, max(doc_id) as keep_id, count(*) as group_size from d group by text)
    select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(text) as text_sha256
    from d join g using (text)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = new_index(spark)
    out = exact_groups(table(spark, sf_dir, "documents"), index)
    index.forget()
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        definition = f.read()
    cache = f"{stage_root(spark)}/veilwork/llm-token-cache-{uuid.uuid4().hex}"
    out = count_tokens(table(spark, sf_dir, "documents"), definition, cache)
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


@query("op6_source_mix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return out.withColumnRenamed("id", "doc_id")


def reply_nodes(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as trees in which each turn answers the one before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


@query(
    "op7_chat_format",
    r"""
    with c as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e as (select *, length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
        + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + 20 as size from c)
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
      cast(sum(size) as bigint) as formatted_chars
    from e group by conv_id
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    done = format_paths(reply_nodes(turns.unionByName(extra)), per_tree=1)
    read = done.select("tree", "formatted", "loss", read_turns(F.col("formatted")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    trained = F.filter(F.transform("turns", lambda t, i: F.when(F.get("loss", i), t["text"])), lambda x: x.isNotNull())
    return read.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.array_join(trained, "").alias("trained"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), COVERAGE)
    return hits.select(
        F.col("id").alias("doc_id"), "item_id", "coverage", "tiles", "words", F.lit(True).alias("contaminated")
    )


def spam_list(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on hosts with a spam label."""
    host = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    marked = F.arrays_overlap(F.split(F.lower(host), r"\."), F.array(*[F.lit(x) for x in SPAM_LABELS]))
    return pages.where(marked).select(canonical(F.col("url").cast("string")).alias("curl"))


@query(
    "op9_url_filter",
    r"""
    with p as (
      select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') as path,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') as query
      from pages),
    q as (select *, regexp_replace(regexp_replace(regexp_replace(query, '([?&])utm_[^&]*', '\1', 'g'), '&+', '&', 'g'),
        '^\?&?(.*?)&?$', '\1') as rest from p),
    c as (select *, case when host = '' then '' else regexp_replace(host, '^(?:www|m)\.', '')
        || regexp_replace(path, '/+$', '') || case when rest <> '' then '?' || rest else '' end end as curl from q),
    listed as (select distinct curl from c where curl <> '' and list_has_any(string_split(host, '.'),
        ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
    rules(rhost, rpath, rverdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    best as (select host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
        arg_max(rverdict, length(rhost || rpath)) as rverdict
      from (select distinct host, path from c) join rules
        on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by host, path)
    select page_id, host, path, rule,
      coalesce(rverdict, case when curl in (select curl from listed) then 'block' else 'allow' end) as verdict
    from c left join best using (host, path)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
    rules = spark.createDataFrame(URL_RULES, schema)
    out = judge(pages, rules, spam_list(pages), "page_id", "url")
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op10_simhash_groups")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), SHINGLE_WORDS, LINK_BITS)
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Conversations of a block begin like its first; the largest number of turns they take over.
HEAD_BLOCK, HEAD_TURNS = 100, 6


@query(
    "op11_prefix_trie",
    r"""
    with crc_table as (
      select list(list_reduce(list_concat([i], range(8)), lambda c, k: case when (c & 1) = 1
        then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
    ids as (select distinct conv_id as c from conversations where conv_id is not null),
    heads as (select c, c - c % 100 as base, xor(list_reduce(list_concat([4294967295],
        list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 as h from ids, crc_table),
    turns as (select conv_id as c, coalesce(text, '') as text, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as said,
      row_number() over (partition by conv_id order by turn nulls first,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i from conversations),
    built as (
      select h.c, 1 as part, i, text, said from heads h join turns t on t.c = h.base where i <= h
      union all select h.c, 2, i, text, said from heads h join turns t on t.c = h.c where i > h),
    seqs as (select c, list(md5(said) order by part, i) as path, list(length(text) order by part, i) as sizes from built group by c),
    convs as (select c, coalesce(path, []) as path, coalesce(sizes, []) as sizes from ids left join seqs using (c)),
    passed as (select c, d, md5(array_to_string(path[1:d], ',')) as node, md5(array_to_string(path[1:d - 1], ',')) as up,
        case when d > 0 then sizes[d] else 0 end as size, d = len(path) as ends, path[1:d] as path
      from (select *, unnest(range(len(path) + 1)) as d from convs)),
    nodes as (select node, d, any_value(up) as up, any_value(size) as size, any_value(path) as path, min(c) as conv_id, count(*) as n,
        sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256
      from passed group by node, d),
    kids as (select up, d - 1 as d, count(*) as kids from nodes where d > 0 group by all),
    own as (select n.*, coalesce(kids, 0) as kids from nodes n left join kids k on k.up = n.node and k.d = n.d),
    sums as (select above, sum(case when kids = 0 then 1 else 0 end) as leaves, sum((n - 1) * size) as saved
      from (select *, md5(array_to_string(path[1:unnest(range(d + 1))], ',')) as above from own) group by above)
    select o.conv_id, cast(o.d as bigint) as depth, p.conv_id as parent_conv_id, o.n as n_convs, o.kids as n_children,
      cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, o.ends_sha256
    from own o join sums s on s.above = o.node left join nodes p on o.d > 0 and p.node = o.up and p.d = o.d - 1
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(prefixes.numbered(prefixes.turn_digests(table(spark, sf_dir, "conversations"))), "llm-trie-turns")
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD_TURNS))
    rebuilt = prefixes.shared_heads(turns, F.col("conv_id") - F.col("conv_id") % HEAD_BLOCK, heads, HEAD_TURNS - 1)
    nodes, ends = prefixes.prefix_trie(rebuilt, ["part", "place"])
    ended = prefixes.end_digests(ends).select("d1", "d2", "ends_sha256")
    return nodes.join(ended, ["d1", "d2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: Ranked terms of a source.
TOP_TERMS = 200


@query(
    "op12_source_divergence",
    r"""
    with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
    w as (select r, lang, source, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
    kept as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 3),
    langs as (select lang, count(*) as v, sum(total) as m from kept group by lang),
    counts as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
    groups as (select g.lang, g.source, coalesce(n, 0) as n, coalesce(v, 0) as v, coalesce(m, 0) as m
      from (select distinct lang, source from d) g left join langs using (lang)
      left join (select lang, source, sum(c) as n from counts group by all) using (lang, source)),
    p as (select g.lang, g.source, term, coalesce(c, 0) as c, total, n, v, m,
        1 + cast(1000000000 as hugeint) * (coalesce(c, 0) + 1) // (n + v) as p
      from groups g join kept using (lang) left join counts using (lang, source, term)),
    sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
      from p a join p b using (lang, term) where a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
      from groups a join groups b on a.lang = b.lang and a.source <> b.source
      left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    q as (select *, 1 + cast(1000000000 as hugeint) * (total + 1) // (m + v) as q from p where c > 0),
    items as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from q where p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
      from (select * from pairs union all select * from items))
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
    from ranked where part = 'pair' or rank <= 200
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"), TOP_TERMS)


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    return out.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
