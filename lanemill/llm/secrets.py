"""Secret scans: one minimal automaton finds the spans of all rules in one pass over the bytes.

Defined cases: null text counts as empty and has no span; very long texts are scanned whole;
repeated rows give repeated results; an empty table gives an empty result; other columns are
neither used nor needed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .automata import Rule, Scanner, compiled
from .common import documents, frugal, text_bytes

# The base rules.
BASE = [
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", ignore_case=True),
    Rule("access", "AKIA[A-Z0-9]+", min_length=16),
    Rule("hex", "[0-9a-f]{32,}"),
]
#: Further kinds of credentials with a published, fixed form.
MORE = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", min_length=24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", min_length=40),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
]
RULES = BASE + MORE
#: Code points that the value of an assignment needs, and its place in the span.
MIN_VALUE = 8
_ASSIGN = re.compile(BASE[0].pattern.encode(), re.I)


def spans(scanner: Scanner, text: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points of all spans that pass their rule's checks."""
    found = []
    at = points = 0
    for start, k, end in scanner.spans(text):
        if scanner.rules[k].kind == "assign" and len(_ASSIGN.fullmatch(text, start, end)[2]) < MIN_VALUE:
            continue
        points += len(text[at:start].decode("utf-8", "replace"))
        at = start
        found.append((points, k, points + end - start))  # spans are ASCII
    return found


def scan(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id and the ``spans`` (start, kind, end in code points) of each row's whole text."""
    arrays = compiled(tuple(rules or RULES))  # on the driver, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*arrays)
        for batch in batches:
            rows = [[{"start": a, "kind": scanner.rules[k].kind, "end": b} for a, k, b in spans(scanner, t)] for t in text_bytes(batch.column("text"))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return df.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            own = [[s for s in x if s[0] in base] for x in rows]
            counts = [pa.array([sum(s[0] == kind for s in x) for x in own], pa.int64()) for kind in base]
            shas = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in own], pa.string())
            texts = pa.array([joined(x) for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, texts], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return scan(documents(spark, sf_dir)).mapInArrow(frugal(run), schema)


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op3_secret_scan`` that SQL can express; it has no places of matches."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_BASE_SQL = """
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''),
    '(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM documents
"""
