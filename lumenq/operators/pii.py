"""Scans of JSON columns for personal data: a walk over values, eight detectors, tracked keys, masking, previews."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_DEPTH = 6
MASK = "****"


def walk(doc: Any, depth: int = 0, path: str = "") -> Iterator[tuple[str, str, Any]]:
    """(path, lower-case key, value) below an object; array elements share one path that ends with []. A root that isn't
    an object or array has none."""
    if depth >= MAX_DEPTH:
        return
    if isinstance(doc, dict):
        for k, v in doc.items():
            at = f"{path}.{k}" if path else k
            yield at, k.lower(), v
            yield from walk(v, depth + 1, at)
    elif isinstance(doc, list):
        for v in doc:
            if isinstance(v, (dict, list)):
                yield from walk(v, depth + 1, path + "[]")
            else:
                yield path + "[]", path.rpartition(".")[2].lower(), v


def luhn(s: str) -> bool:
    digits = re.sub("[ -]", "", s)
    if not re.fullmatch("[0-9]{13,19}", digits):
        return False
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def octets(s: str) -> bool:
    """Four numbers of one to three digits, none above 255, between full stops."""
    parts = s.strip().split(".")
    return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)


# What each detector accepts, in the order in which the first wins.
DETECTORS = {
    "email": lambda s: 6 <= len(t := s.strip()) <= 254 and bool(re.fullmatch(r"[^\s@]+@(?=[^\s@]{4,})[^\s@]+\.[A-Za-z]{2,}", t)),
    "phone_e164": lambda s: bool(re.fullmatch(r"\+?[1-9][0-9]{7,14}", s.strip())),
    "ipv4": octets,
    "ipv6": lambda s: len(t := s.strip()) >= 3 and bool(re.fullmatch(r"(?:[0-9A-Fa-f]{0,4}:){2,}[0-9A-Fa-f]{0,4}", t)),
    "jwt": lambda s: bool(re.fullmatch(r"[\w=-]{8,}\.[\w=-]{8,}\.[\w=-]+", s.strip(), re.A)),
    "iban": lambda s: bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Za-z0-9]{11,30}", re.sub(r"\s", "", s))),
    "ssn_us": lambda s: bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", s.strip())),
    "credit_card": luhn,
}


def detect(value: Any, enabled: Iterable[str] = tuple(DETECTORS)) -> str | None:
    on = set(enabled)
    return next((n for n, f in DETECTORS.items() if n in on and f(value)), None) if isinstance(value, str) else None


def preview(value: Any) -> str:
    """Enough to recognise a value by, and no more."""
    kind = {type(None): "null", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}.get(type(value))
    if kind:
        return f"<{kind}>"
    return f"{value[0]}…{value[-1]}" if len(value) >= 4 else "<short string>"


def mask_path(doc: Any, path: list[str]) -> int:
    """Put the mask at a path of a parsed document; ``*`` first goes into each array element. Returns how many."""
    if path and path[0] == "*":
        return sum(mask_path(x, path[1:]) for x in doc) if isinstance(doc, list) else 0
    for k in path[:-1]:
        doc = doc.get(k) if isinstance(doc, dict) else None
    if isinstance(doc, dict) and path and path[-1] in doc:
        doc[path[-1]] = MASK
        return 1
    return 0


def _parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def scan(df: DataFrame, key: str, columns: list[str], tracked: Iterable[str] = (), enabled: Iterable[str] = tuple(DETECTORS)) -> DataFrame:
    """(key, column, path, finding, preview): what detectors or tracked keys find in JSON string columns.

    Null, empty and malformed documents have no findings. Rows go through in Arrow batches.
    """
    tracked, enabled = frozenset(k.strip().lower() for k in tracked), tuple(enabled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for j, c in enumerate(columns):
                for i, text in enumerate(b.column(j + 1).to_pylist()):
                    for path, k, v in walk(_parsed(text)):
                        hit = f"key:{k}" if k in tracked else detect(v, enabled)
                        if hit:
                            out.append((i, c, path, hit, preview(v)))
            at = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array([x[k] for x in out], pa.string()) for k in range(1, 5)]], names=["key", "column", "path", "finding", "preview"])

    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("string") for c in columns])
    found = rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, column string, path string, finding string, preview string")
    return found.withColumnRenamed("key", key)


def findings(scanned: DataFrame) -> DataFrame:
    """(column, path, finding, n)."""
    return scanned.groupBy("column", "path", "finding").agg(F.count(F.lit(1)).alias("n"))


def mask_column(df: DataFrame, column: str, path: list[str]) -> DataFrame:
    """``df`` with the path of a JSON column masked; documents without it stay as they are, byte for byte."""

    @F.arrow_udf("string")
    def masked(v: pa.Array) -> pa.Array:
        out = []
        for t in v.to_pylist():
            doc = _parsed(t)
            out.append(json.dumps(doc, separators=(",", ":"), ensure_ascii=False) if doc is not None and mask_path(doc, path) else t)
        return pa.array(out, pa.string())

    return df.withColumn(column, masked(F.col(column)))
