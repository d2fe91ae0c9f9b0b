"""Deletion by scope, and the rollups that must be rebuilt after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def split(rows: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): rows outside and inside of the scope; a scope that is null for a row keeps it."""
    inside = F.coalesce(scope, F.lit(False))
    return rows.filter(~inside), rows.filter(inside)


def touched(purged: DataFrame, keys: list[str]) -> DataFrame:
    """(app_id, kind, key): every entity that lost a row, as one long table."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])
    return purged.select("app_id", F.explode(pairs).alias("x")).select("app_id", "x.kind", "x.key").filter("key <> ''").distinct()


def recompute(rollup: DataFrame, kept: DataFrame, lost: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """The rollup with the entities that lost rows recounted from what is kept (gone if nothing is), others as they were."""
    hit = lost.filter(F.col("kind") == key).select("app_id", F.col("key").alias(key))
    same = rollup.join(hit, ["app_id", key], "left_anti")
    new = kept.join(hit, ["app_id", key], "left_semi").groupBy("app_id", key).agg(*[c.alias(n) for n, c in aggs.items()])
    return same.unionByName(new.select(*same.columns))


def merge_tiers(hot: DataFrame, cold: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Rollups of both tiers as one: sums added, first_seen and last_seen extended."""
    both = hot.unionByName(cold)
    return both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
