"""Problem 3: sessions by inactivity gap.

Rows are range-partitioned by (keys, time) and sorted within partitions (a secondary sort), then one linear scan per
partition emits sessions with constant memory. Because time is part of the range, a key with a third of all rows is
spread over many partitions; only the first and last session of a partition can continue in a neighbour, and these,
two a partition at most, are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

MINUTE = 60_000_000


def _changes(a: pa.Array, last) -> np.ndarray:
    """True where a value differs from the one before it (nulls equal each other); at 0 compared with ``last``."""
    n = len(a)
    out = np.zeros(n, bool)
    if n > 1:
        x, y = a.slice(1), a.slice(0, n - 1)
        d = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
        out[1:] = d | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
    out[0] = a[0].as_py() != last
    return out


def _scanner(n_keys: int, gap_us: int, schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, True  # the open session: keys, start, end, rows

        def rows(keys: list[pa.Array], start, end, n, edge) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*keys, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64()), pa.array(edge, pa.bool_())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i) for i in range(n_keys)]
            keys = [k.cast(pa.string()) if k.type != pa.string() else k for k in keys]
            us = b.column(n_keys).to_numpy(zero_copy_only=False)
            new = np.zeros(len(us), bool)
            for i, k in enumerate(keys):
                new |= _changes(k, held[0][i] if held else None)
            new[1:] |= np.diff(us) > gap_us
            new[0] |= held is None or us[0] - held[2] > gap_us
            at = np.flatnonzero(new)
            if not len(at):
                held = (held[0], held[1], int(us[-1]), held[3] + len(us))
                continue
            if held:  # rows before the first cut belong to the open session
                end, n = (int(us[at[0] - 1]), held[3] + int(at[0])) if at[0] else (held[2], held[3])
                yield rows([pa.array([k], pa.string()) for k in held[0]], [held[1]], [end], [n], [head])
                head = False
            ends = np.append(at[1:], len(us))
            if len(at) > 1:
                edge = np.zeros(len(at) - 1, bool)
                edge[0], head = head, False
                yield rows([k.take(pa.array(at[:-1])) for k in keys], us[at[:-1]], us[ends[:-1] - 1], (ends - at)[:-1], edge)
            held = ([k[int(at[-1])].as_py() for k in keys], int(us[at[-1]]), int(us[-1]), int(len(us) - at[-1]))
        if held:
            yield rows([pa.array([k], pa.string()) for k in held[0]], [held[1]], [held[2]], [held[3]], [True])

    return scan


def sessionize(df: DataFrame, keys: list[str], time: str = "timestamp", gap_us: int = 30 * MINUTE, valid: Column | None = None) -> DataFrame:
    """(*keys, start_us, end_us, n): sessions of each key, divided where neighbours are more than ``gap_us`` apart.

    Rows with a null time are left out, as are those where ``valid`` isn't true. Null keys form a key of their own.
    Ties in time and repeated rows fall in one session and all count; an empty table gives no session. Other columns
    are not read. Keys are returned as strings.
    """
    rows = df.filter(F.col(time).isNotNull()) if valid is None else df.filter(F.col(time).isNotNull() & valid)
    rows = rows.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.unix_micros(time).alias("us"))
    ks = [f"k{i}" for i in range(len(keys))]
    sort = rows.repartitionByRange(*ks, "us").sortWithinPartitions(*ks, "us")
    out = ", ".join([*(f"{k} string" for k in ks), "start_us bigint", "end_us bigint", "n bigint", "edge boolean"])
    schema = pa.schema([*((k, pa.string()) for k in ks), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())])
    found = sort.mapInArrow(_scanner(len(ks), gap_us, schema), out)
    # edges of one key share slot -1; every other session is alone in its slot
    found = found.withColumn("slot", F.when(F.col("edge"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    w = Window.partitionBy(*ks, "slot").orderBy("start_us", "end_us")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("cut", F.when(F.col("start_us") - before <= gap_us, 0).otherwise(1))
    part = cut.withColumn("part", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = part.groupBy(*ks, "slot", "part").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
    return merged.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "start_us", "end_us", "n")
