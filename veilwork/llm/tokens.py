"""Token counts through a digest cache.

The cache is a Parquet table ``tokenizer, digest, n_tokens``: the digest of the normalised content and the
digest of the tokenizer (file and library version) lead to the stored count. Documents are reduced to
distinct digests, the cache's digests are taken off by an anti-join, and only one text per missing digest is
encoded; its count is appended. Texts stay where they are read: a bitmap of the rows to encode (bounded in
size, see ``common.MAX_FILTER_BITS``) goes to the scan. More misses than it can hold are joined to the texts.

Defined cases: null text is empty and has 0 tokens. Rows with equal ids are counted each for itself. A rerun
that appends a digest twice does no harm, the table is read by the largest count of a digest (all are equal).
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import MAX_FILTER_BITS, BitFilter, batch_of, bit_filter, shared, utf8
from .words import batches

#: Bytes of text that are encoded at once.
ENCODE_BYTES = 256 << 10

#: Pieces whose counts a task remembers.
KNOWN_PIECES = 500_000

# Fixed value: the pattern by which byte-level tokenizers cut a text before any merge.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are the same in all Unicode versions that the libraries may use, with the letters
#: and numbers among them; ``re`` is twice as fast with these as ``regex`` with the classes of all Unicode.
_SETTLED = r"[\t\n\r\x20-\x7e\u00a1-\u024f]*"
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"

_COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_digest(definition: bytes) -> str:
    """Digest of a tokenizer: its file and the library version."""
    return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + definition).hexdigest()


def _added_strings(definition: bytes) -> list[str] | None:
    """Strings of added tokens, if the tokenizer cuts texts by the byte-level pattern and does nothing else
    before its merges; else None."""
    spec = json.loads(definition)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return [t["content"] for t in spec.get("added_tokens") or []] if plain and not spec.get("normalizer") else None


def _counter(definition: bytes) -> Callable[[list[bytes]], list[int]]:
    """Token counts of whole texts as the library gives them.

    Where a tokenizer merges inside the pieces of a fixed pattern, a text has as many tokens as its pieces have
    together, so each distinct piece is encoded once and remembered. Texts with special strings or with
    characters of unsettled classes, and other tokenizers, are encoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    own = tokenizers.Tokenizer.from_str(definition.decode())
    own.no_truncation()
    own.no_padding()
    added = _added_strings(definition)
    settled = re.compile(_SETTLED).fullmatch
    pieces_of = re.compile(
        _PIECES.replace(r"\s\p{L}\p{N}", rf"\s{_LETTERS}{_NUMBERS}").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
    ).findall
    known: dict[str, int] = {}

    def encoded(texts: list[str]) -> list[int]:
        return [len(e) for e in own.encode_batch(texts, add_special_tokens=False)]

    def count(raw: list[bytes]) -> list[int]:
        texts = [t.decode() for t in raw]
        if added is None:
            return encoded(texts)
        cut = [pieces_of(t) if settled(t) and not any(a in t for a in added) else None for t in texts]
        if len(known) > KNOWN_PIECES:
            known.clear()
        new = [p for p in {p for c in cut if c is not None for p in c} if p not in known]
        known.update(zip(new, encoded(new), strict=True))
        whole = iter(encoded([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(whole) if c is None else sum(map(known.__getitem__, c)) for c in cut]

    return count


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    try:
        rows = spark.read.schema("tokenizer string, digest binary, n_tokens long").parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, definition: bytes, cache: str, id_col: str = "doc_id", text_col: str = "text",
    max_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """``id, n_bytes, n_tokens, digest`` of every document; ``cache`` is a folder all executors share.

    ``definition`` holds the bytes of a ``tokenizers`` JSON file (its size is fixed; executors get a copy).
    """
    spark = docs.sparkSession
    version = tokenizer_digest(definition)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256))
    )
    tagged = rows.withColumn("tag", F.xxhash64("id", "digest"))
    missing = tagged.groupBy("digest").agg(F.min("tag").alias("tag"))
    stored = _cached(spark, cache, version)
    if stored is not None:
        missing = missing.join(stored, "digest", "left_anti")
    missing = stage(missing, "llm-token-misses")

    found = bit_filter(missing, "tag", max_bits)
    bits, source = (shared(spark, found.bits) if found else None), shared(spark, definition)
    chosen = tagged if found else tagged.join(missing.select("tag"), "tag", "left_semi")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(source.value)

        def wanted():
            for p in parts:
                if bits:
                    tags = p.column(0).to_numpy(zero_copy_only=False).view("uint64")
                    p = p.filter(pa.array(BitFilter(bits.value).passes(tags)))
                yield from zip(p.column(1).to_pylist(), utf8(p.column(2)), strict=True)

        for digests, texts in batches(wanted(), ENCODE_BYTES):
            yield batch_of(_COUNTS, digest=digests, n_tokens=count(texts))

    counted = chosen.select("tag", "digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)

    known = _cached(spark, cache, version)
    sizes = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(known, "digest").select("id", "n_bytes", "n_tokens", "digest")
