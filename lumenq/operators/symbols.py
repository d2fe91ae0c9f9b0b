"""Symbolication of minified frames by source maps of version 3.

Positions are made distinct before anything else, so a crash that fills a third of the rows is resolved once; each map
is parsed once, beside the positions that need it.
"""

from __future__ import annotations

import bisect
import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def vlq(text: str) -> list[int]:
    """The numbers of a base64 VLQ segment: six bits a character, the top one continues, the lowest of all is the sign."""
    out, n, shift = [], 0, 0
    for c in text:
        d = _DIGITS[c]
        n |= (d & 31) << shift
        shift += 5
        if not d & 32:
            out.append(-(n >> 1) if n & 1 else n >> 1)
            n = shift = 0
    if shift:
        raise ValueError("a segment ends within a number")
    return out


class SourceMap:
    def __init__(self, text: str):
        doc = json.loads(text)
        if doc.get("version") != 3 or not isinstance(doc.get("mappings"), str):
            raise ValueError("not a source map of version 3")
        root = (doc.get("sourceRoot") or "").rstrip("/")
        self.sources = [s if not root or "://" in s else f"{root}/{s.lstrip('/')}" for s in (x or "" for x in doc.get("sources", []))]
        self.names = [x or "" for x in doc.get("names", [])]
        self.lines: list[tuple[list[int], list[tuple[int, ...] | None]]] = []
        at = [0, 0, 0, 0]  # source, line, column, name run on over the whole map
        for line in doc["mappings"].split(";"):
            column, cols, refs = 0, [], []
            for seg in filter(None, line.split(",")):
                head, *rest = vlq(seg)
                column += head
                for i, x in enumerate(rest[:4]):
                    at[i] += x
                cols.append(column)
                refs.append((at[0], at[1], at[2], at[3] if len(rest) > 3 else -1) if len(rest) >= 3 else None)
            self.lines.append((cols, refs))

    def resolve(self, line: int, column: int) -> tuple[str, int, int, str | None] | None:
        """(source, line, column, name) of a generated position, both counted from 1; None if the map has none."""
        if not 1 <= line <= len(self.lines) or column < 1:
            return None
        cols, refs = self.lines[line - 1]
        i = bisect.bisect_right(cols, column - 1) - 1
        ref = refs[i] if i >= 0 else None
        if ref is None or not 0 <= ref[0] < len(self.sources):
            return None
        name = self.names[ref[3]] if 0 <= ref[3] < len(self.names) else ""
        return self.sources[ref[0]], ref[1] + 1, ref[2] + 1, name or None


_OUT = pa.schema([("artifact", pa.string()), ("lineno", pa.int32()), ("colno", pa.int32()), ("source", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("name", pa.string())])


def _resolve(key: tuple[pa.Scalar, ...], positions: pa.Table, maps: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    try:
        m = SourceMap(maps.column("map")[0].as_py()) if maps.num_rows else None
    except (ValueError, KeyError, TypeError):
        m = None
    for line, col in zip(positions.column("lineno").to_pylist(), positions.column("colno").to_pylist()):
        found = m.resolve(line, col) if m else None
        rows.append((key[0].as_py(), line, col, *(found or (None,) * 4)))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)


def symbolicate(frames: DataFrame, maps: DataFrame) -> DataFrame:
    """``frames`` (artifact, lineno, colno, ...) with source, line, column and name; null where no map resolves them.

    ``maps``: artifact, map (JSON text). A broken map resolves nothing; of several maps of an artifact the greatest counts.
    """
    key = ["artifact", "lineno", "colno"]
    wanted = frames.select(*key).filter("artifact is not null and lineno is not null and colno is not null").distinct()
    one = maps.groupBy("artifact").agg(F.max("map").alias("map"))
    found = wanted.groupBy("artifact").cogroup(one.groupBy("artifact")).applyInArrow(_resolve, "artifact string, lineno int, colno int, source string, line int, column int, name string")
    return frames.join(found, key, "left")


def pool(rows: DataFrame, column: str = "stacktrace") -> tuple[DataFrame, DataFrame]:
    """(rows with stack_sha instead of the stack, one stack per hash): equal stacks are stored once."""
    keyed = rows.withColumn("stack_sha", F.sha2(F.to_json(column), 256))
    return keyed.drop(column), keyed.filter(F.col(column).isNotNull()).groupBy("stack_sha").agg(F.any_value(column).alias(column))


def hydrate(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    return rows.join(blobs, "stack_sha", "left").drop("stack_sha")
