"""Problem 5: one feature row per entity, by two-stage salted aggregation.

Stage one aggregates by (entity, type, salt), where only heavy (entity, type) groups have more than one salt; stage
two brings the partial statistics of an entity together, merges them, and expands the complete list of types.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenq.functions.ids import packed_key, packed_order, packed_us
from lumenq.operators.skew import estimate_loads
from lumenq.session import written

MAX_TYPES = 20_000


def heavy_groups(df: DataFrame, key: list[str], parts: int) -> dict[int, int]:
    """Salts by the hash of each (entity, type) group with more than half a task's share; at most a few a task."""
    bins, keys = estimate_loads(df, [F.col(k) for k in key], parts)
    share = max(1.0, sum(bins) / parts)
    return {h: min(parts, int(n / share) + 1 + 1) for h, n in keys.items() if n > share / 2}


def typed_stats(df: DataFrame, entity: list[str], kind: str, time: str = "timestamp", row: str = "delivery_id", parts: int | None = None) -> DataFrame:
    """(*entity, kind, n, last_us, last_row) per entity and type, partitioned by entity.

    last: the row with the greatest (time, row); a null ``time`` must be filtered out before. A null type is a type
    of its own; ``row`` is a non-null bigint. Ties in time go by ``row``, repeated rows count. Empty gives empty.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*entity, kind, F.col(row).alias("_row"), packed_order(F.unix_micros(time), F.col(row)).alias("_o"))
    key = [*entity, kind]
    salts = heavy_groups(rows, key, parts)
    table = pa.table({"_h": pa.array(list(salts), pa.int64()), "_salts": pa.array(list(salts.values()), pa.int64())})
    rows = rows.withColumn("_h", F.xxhash64(*key)).join(F.broadcast(spark.createDataFrame(table)), "_h", "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_row", F.lit(1)), F.col("_salts")), F.lit(0)))
    one = rows.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("n"), F.max("_o").alias("o"))
    two = one.repartition(*entity).groupBy(*key).agg(F.sum("n").alias("n"), F.max("o").alias("o"))
    return two.select(*key, "n", packed_us(F.col("o")).alias("last_us"), packed_key(F.col("o")).alias("last_row"))


def type_list(df: DataFrame, kind: str, limit: int = MAX_TYPES) -> list[str]:
    """All types that occur, sorted; more than ``limit`` are an error, not cut off."""
    found = [r[0] for r in df.select(kind).filter(F.col(kind).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} types: use typed_stats, which has a row for each")
    return sorted(found)


def feature_table(df: DataFrame, entity: list[str], kind: str, types: list[str] | None = None, **kw) -> DataFrame:
    """(*entity, n_events, last_us, counts, last_by_type): one row per entity.

    ``counts[i]`` is the number of rows of the i-th type of the complete sorted list (0 if none), ``last_by_type[i]``
    its latest time in microseconds (null if none). Rows with a null type count in n_events and last_us only.
    """
    stats = typed_stats(df, entity, kind, **kw)
    if types is None:
        stats = written(stats, "typed-stats")  # read twice: for its types and for its rows
        types = type_list(stats, kind)
    index = df.sparkSession.createDataFrame(pa.table({kind: pa.array(types, pa.string()), "_i": pa.array(range(len(types)), pa.int32())}))
    slot = F.when(F.col("_i").isNotNull(), F.struct("_i", "n", "last_us"))
    have = F.sort_array(F.collect_list(slot)).alias("have")  # at most one a type
    rows = stats.join(F.broadcast(index), kind, "left").groupBy(*entity).agg(F.sum("n").alias("n_events"), F.max("last_us").alias("last_us"), have)
    return rows.select(*entity, "n_events", "last_us", _dense("n", F.lit(0).cast("bigint"), len(types)).alias("counts"), _dense("last_us", F.lit(None).cast("bigint"), len(types)).alias("last_by_type"))


def _dense(field: str, missing: Column, width: int) -> Column:
    """The slots of ``have`` spread out: before each one as many ``missing`` as types lie between, in one pass."""
    before = lambda j: F.coalesce(F.get(F.col("have"), j - 1)["_i"], F.lit(-1))
    parts = F.flatten(F.transform("have", lambda x, j: F.concat(F.array_repeat(missing, x["_i"] - before(j) - 1), F.array(x[field]))))
    return F.concat(parts, F.array_repeat(missing, F.lit(width - 1) - before(F.size("have"))))
