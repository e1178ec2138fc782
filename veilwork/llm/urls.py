"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

Rules are looked up by equi-joins: each URL gives the suffixes of its host and the prefixes of its path that
have the length of some rule's path. The longest fitting rule wins; without one the list decides. The list is
hashed into a blocked Bloom filter (one 512-bit block per URL, eight bits inside it). The filter has at most
``MAX_BLOCKS`` blocks, whatever the list, so it can be sent to all executors; URLs that hit all eight bits pass
to an exact hash join with the list, which removes the false hits. A longer list makes the filter pass more,
never less. Only column functions are used.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is not listed.
Rows with equal ids stay rows of their own. Of rules of equal length the one that is smaller as text wins.
An empty table gives an empty result; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

#: 2**17 blocks of 64 bytes: the filter is at most 8 MiB.
MAX_BLOCKS = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and ``m.``, path without a last ``/``, query without ``utm_`` parts, no scheme or
    fragment; empty if the URL has no host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, _URL, 3), F.lit("")), r"([?&])utm_[^&]*", "$1")
    query = F.regexp_replace(F.regexp_replace(query, r"&+", "&"), r"^\?&?(.*?)&?$", "$1")
    query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(host != "", F.concat(host, path, query)).otherwise("")


def _place(url: Column, blocks: int) -> list[Column]:
    """Block of a URL and its bit in each of the eight words of that block."""
    h, g = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    bits = [F.shiftrightunsigned(g, 6 * i).bitwiseAND(63).cast("int") for i in range(8)]
    return [F.pmod(h, F.lit(blocks)).cast("int"), *bits]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 … w7`` of the filter of ``listed(curl)``; at most ``blocks`` rows."""
    block, *bits = _place(F.col("curl"), blocks)
    rows = listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(8)])


def listed_urls(urls: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of ``urls`` whose ``curl`` is in ``listed(curl)``."""
    own = stage(listed.select("curl").where("curl <> ''").distinct(), "llm-listed")
    blocks = max(1, min(max_blocks, 1 << max(0, (own.count() * 16 // 512)).bit_length()))
    bloom = F.broadcast(bloom_blocks(own, blocks))  # at most ``max_blocks`` rows of 68 bytes
    block, *bits = _place(F.col("curl"), blocks)
    placed = urls.withColumn("__block", block)
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.expr(f"w{i}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    possible = placed.join(bloom, F.col("__block") == F.col("block")).where(hit).select(*urls.columns)
    return possible.join(own.hint("shuffle_hash"), "curl", "left_semi")


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """``id, host, path, rule, verdict, listed`` of each row.

    ``rules``: host, path, verdict (``allow`` or ``block``). ``listed``: canonical URLs ``curl`` to block.
    """
    url = F.col(url_col).cast("string")
    rows = urls.select(
        F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("curl")
    )
    places = stage(rows.select("host", "path", "curl").distinct(), "llm-urls")

    fixed = rules.select(F.translate("host", _UPPER, _LOWER).alias("rhost"), F.col("path").alias("rpath"), F.col("verdict").alias("rverdict"))
    fixed = fixed.withColumn("rule", F.concat("rhost", "rpath"))
    lengths = [r.n for r in fixed.select(F.length("rpath").alias("n")).distinct().collect()]  # one per path length
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    asked = places.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rhost")).distinct()
    prefixes = F.explode(F.array(*[F.lit(n) for n in lengths] or [F.lit(0)])).alias("n")
    asked = asked.select("host", "path", "rhost", prefixes).where(F.length("path") >= F.col("n"))
    asked = asked.withColumn("rpath", F.expr("substring(path, 1, n)"))
    best = (
        asked.join(fixed, ["rhost", "rpath"])
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("size"), "rule", "rverdict")).alias("best"))
        .select("host", "path", "best.rule", "best.rverdict")
    )
    blocked = listed_urls(places.select("curl").where("curl <> ''").distinct(), listed).withColumn("hit", F.lit(True))
    judged = places.join(best, ["host", "path"], "left").join(blocked, "curl", "left")
    judged = stage(
        judged.select(
            "host", "path", "curl", "rule", F.col("hit").isNotNull().alias("listed"),
            F.coalesce("rverdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"),
        ),
        "llm-judged",
    )
    return rows.join(judged, ["host", "path", "curl"]).select("id", "host", "path", "rule", "verdict", "listed")
