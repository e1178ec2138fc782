"""Own detectors in Python, for what a pattern can't say (check digits, models, look-ups).

A detector is a function that takes a list of texts and yields ``(text number, start, end, type, confidence)``. It gets
Arrow batches in Spark tasks; its spans are checked and join the overlap resolution as ``extra`` spans of any job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..rules import DETECTORS

Find = Callable[[list[str]], Iterable[tuple[int, int, int, str, float]]]

#: Characters of text that a detector is given at once (a longer text comes alone).
BATCH_CHARS = 1 << 20
_LEFT, _RIGHT = 50, 20

_FIELDS = [
    ("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("raw_value", pa.string(), "string"), ("pii_type", pa.string(), "string"),
    ("confidence", pa.float64(), "double"), ("left_ctx", pa.string(), "string"), ("right_ctx", pa.string(), "string"),
]


def _checked(find: Find, texts: list[str], types: frozenset[str]) -> list[tuple]:
    """Rows ``(text number, start, end, value, type, confidence, left, right)``; a span that can't be is an error."""
    out = []
    for i, start, end, pii_type, confidence in find(texts):
        if not 0 <= i < len(texts) or not 0 <= start < end <= len(texts[i]):
            raise ValueError(f"span {start}..{end} of text {i} of {len(texts)} isn't inside a text")
        if pii_type not in types:
            raise ValueError(f"type {pii_type!r} isn't one of {', '.join(sorted(types))}")
        if not 0.0 <= confidence <= 1.0:
            raise ValueError(f"confidence {confidence} isn't between 0 and 1")
        t = texts[i]
        out.append((i, int(start), int(end), t[start:end], pii_type, float(confidence), t[max(0, start - _LEFT) : start], t[end : end + _RIGHT]))
    return out


def batch_detector(find: Find, types: Iterable[str]) -> Callable[[DataFrame], DataFrame]:
    """A job ``docs(doc_id, ord, text) -> spans`` that runs ``find``; ``types`` are all types that it may give.

    Use it as ``extra`` of ``find_spans`` and of the folder, table and stream jobs. Offsets are in code points. Own
    detectors come after the built-in ones when equal spans are compared. Null texts have no spans.
    """
    allowed = frozenset(types)
    # the detector may come from a script or notebook that the executors don't have
    carried = cloudpickle.dumps(find)

    def spans(docs: DataFrame) -> DataFrame:
        rows = docs.select("doc_id", "ord", "text").where("text is not null")
        kinds = dict(rows.dtypes)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = cloudpickle.loads(carried)
            for p in parts:
                texts = p.column(2).to_pylist()
                lo = 0
                while lo < len(texts):
                    hi, size = lo + 1, len(texts[lo])
                    while hi < len(texts) and size + len(texts[hi]) <= BATCH_CHARS:
                        size += len(texts[hi])
                        hi += 1
                    if found := _checked(own, texts[lo:hi], allowed):
                        cols = list(zip(*found, strict=True))
                        at = pa.array([lo + i for i in cols[0]])
                        arrays = [pa.array(c, kind) for c, (_, kind, _) in zip(cols[1:], _FIELDS, strict=True)]
                        yield pa.RecordBatch.from_arrays([p.column(0).take(at), p.column(1).take(at), *arrays], ["doc_id", "ord", *[f[0] for f in _FIELDS]])
                    lo = hi

        ddl = f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, " + ", ".join(f"{n} {t}" for n, _, t in _FIELDS)
        order = f"cast({len(DETECTORS)} as int) as det_ord"
        return rows.mapInArrow(run, ddl).selectExpr(
            "doc_id", "ord", "start", "end", "raw_value", "pii_type", "confidence", order, "0 as rule_ord", "left_ctx", "right_ctx"
        )

    return spans
