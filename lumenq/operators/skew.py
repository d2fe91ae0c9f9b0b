"""Problem 4: a few keys hold most records. Fragment-replicate by estimated load.

The load of every key is counted first; keys above a task's share are split into shards in proportion to their load,
all others are gathered in a fixed number of hash bins, and shards and bins are packed onto tasks, largest first. The
plan that reaches the driver holds at most ``BINS_PER_TASK + HEAVY_PER_TASK`` entries a task, whatever the data.
A matching side is replicated to the shards of the heavy keys only.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenq.functions.ids import packed_key, packed_order

BINS_PER_TASK = 16
HEAVY_PER_TASK = 4


@dataclass(frozen=True)
class LoadPlan:
    """bins: the task of each hash bin. heavy: the tasks of the shards of each heavy key, by the key's 64-bit hash."""

    tasks: int
    total: int
    bins: list[int]
    heavy: dict[int, list[int]]
    loads: list[float]


def pack_loads(tasks: int, bins: list[int], keys: dict[int, int]) -> LoadPlan:
    """Shard the keys above half a task's share and pack shards and bins onto tasks, largest first.

    ``bins``: rows by hash bin, without those of ``keys``. Every key of ``keys`` gets at least one shard.
    """
    total = sum(bins) + sum(keys.values())
    share = max(1.0, total / tasks)
    units = [(n, "bin", i, 0) for i, n in enumerate(bins)]
    for h, n in keys.items():
        shards = min(tasks, max(1, math.ceil(n / share)))
        units += [(n / shards, "key", h, s) for s in range(shards)]
    heap = [(0.0, t) for t in range(tasks)]
    of_bin, of_key, loads = [0] * len(bins), {h: [] for h in keys}, [0.0] * tasks
    for n, kind, x, _ in sorted(units, key=lambda u: (-u[0], u[1], u[2], u[3])):
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        loads[t] = load + n
        if kind == "bin":
            of_bin[x] = t
        else:
            of_key[x].append(t)
    return LoadPlan(tasks, total, of_bin, of_key, loads)


def estimate_loads(df: DataFrame, key: list[Column], tasks: int) -> tuple[list[int], dict[int, int]]:
    """Rows by hash bin and the rows of the heaviest keys (by hash), from all rows, combined on the map side."""
    n_bins, top = tasks * BINS_PER_TASK, tasks * HEAVY_PER_TASK
    per_key = df.select(F.xxhash64(*key).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    by_bin = per_key.groupBy(F.pmod("h", F.lit(n_bins)).alias("h")).agg(F.sum("n").alias("n")).select(F.lit("bin").alias("kind"), "h", "n")
    heavy = per_key.orderBy(F.desc("n"), "h").limit(top).select(F.lit("key").alias("kind"), "h", "n")
    bins, keys = [0] * n_bins, {}
    for r in by_bin.unionByName(heavy).toArrow().to_pylist():
        if r["kind"] == "bin":
            bins[r["h"]] = r["n"]
        else:
            keys[r["h"]] = r["n"]
    return bins, keys


def plan_loads(df: DataFrame, key: list[Column], tasks: int | None = None) -> LoadPlan:
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins, keys = estimate_loads(df, key, tasks)
    share = sum(bins) / tasks
    keys = {h: n for h, n in keys.items() if n > share / 2}
    for h, n in keys.items():
        bins[h % len(bins)] -= n
    return pack_loads(tasks, bins, keys)


def _with_task(df: DataFrame, plan: LoadPlan, key: list[Column], spread: Column | None) -> DataFrame:
    """``df`` with _task: one shard of a heavy key by ``spread``, or, without it, a copy of the row for every shard."""
    spark = df.sparkSession
    table = pa.table({"_h": pa.array(list(plan.heavy), pa.int64()), "_shards": pa.array(list(plan.heavy.values()), pa.list_(pa.int32()))})
    heavy = F.broadcast(spark.createDataFrame(table))  # at most HEAVY_PER_TASK keys a task
    # one literal, whatever the number of tasks; an array of literals would be as many expressions
    bins = F.from_json(F.lit(str(plan.bins)), "array<int>")
    rows = df.withColumn("_h", F.xxhash64(*key)).join(heavy, "_h", "left")
    light = F.element_at(bins, (F.pmod("_h", F.lit(len(plan.bins))) + 1).cast("int"))
    if spread is not None:
        shard = F.element_at("_shards", (F.pmod(F.xxhash64(spread, F.lit(1)), F.size("_shards").cast("bigint")) + 1).cast("int"))
        return rows.withColumn("_task", F.coalesce(shard, light)).drop("_h", "_shards")
    return rows.withColumn("_task", F.explode(F.coalesce(F.array_distinct("_shards"), F.array(light)))).drop("_h", "_shards")


def fragment(df: DataFrame, key: list[str], spread: str, plan: LoadPlan | None = None) -> DataFrame:
    """``df`` with _task, each row in the partition its task names; rows of a heavy key are spread over its shards."""
    cols = [F.col(k) for k in key]
    plan = plan or plan_loads(df, cols)
    return _with_task(df, plan, cols, F.col(spread)).repartitionById(plan.tasks, F.col("_task"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """``left`` joined with ``right`` on equal, non-null ``on``; heavy keys of ``left`` are sharded by ``spread`` and only
    their rows of ``right`` replicated. how: inner, left, left_semi or left_anti (those keep one match set per left row).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: a replicated side can't be outer")
    cols = [F.col(k) for k in on]
    plan = plan or plan_loads(left, cols)
    a = _with_task(left, plan, cols, F.col(spread)).repartitionById(plan.tasks, F.col("_task"))
    b = _with_task(right, plan, cols, None).repartitionById(plan.tasks, F.col("_task"))
    # the plan places both sides: neither is hashed again, and neither is sent to all tasks
    return a.join(b.hint("merge"), ["_task", *on], how).drop("_task")


def first_last_by_key(df: DataFrame, key: list[str], time: str = "timestamp", row: str = "delivery_id") -> DataFrame:
    """(*key, n, first_row, last_row): per key the number of rows and the first and last by (time, row).

    Each task aggregates its bins and shards where they lie; only one partial result per key and shard is merged.
    Null key values are values of their own; rows with a null ``time`` must be filtered out before, or sort last.
    ``row`` is a non-null bigint. Other columns are not read; an empty table gives no row.
    """
    rows = df.select(*key, F.col(row).alias("_row"), packed_order(F.unix_micros(time), F.col(row)).alias("_o"))
    part = fragment(rows, key, "_row").groupBy("_task", *key).agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("a"), F.max("_o").alias("z"))
    done = part.groupBy(*key).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    return done.select(*key, "n", packed_key(F.col("a")).alias("first_row"), packed_key(F.col("z")).alias("last_row"))
