"""Aliases of identities: claims, read-time overlay, and persisted rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def claim(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (app_id, alias_id, distinct_id, seq) with an outcome: fresh, repeat, conflict or chain.

    An alias is claimed once: the first request wins, the same again is a repeat, another target a conflict. A target
    that is an alias, an alias that is a target, or an alias of itself would chain, and is refused.
    """
    known = existing.select("app_id", "alias_id", F.col("distinct_id").alias("_now"))
    aliases = existing.select("app_id", F.col("alias_id").alias("distinct_id"), F.lit(True).alias("_to_alias")).distinct()
    targets = existing.select("app_id", F.col("distinct_id").alias("alias_id"), F.lit(True).alias("_is_target")).distinct()
    w = Window.partitionBy("app_id", "alias_id").orderBy("seq")
    r = requests.withColumns({"_first": F.first("distinct_id").over(w), "_n": F.row_number().over(w)})
    r = r.join(known, ["app_id", "alias_id"], "left").join(aliases, ["app_id", "distinct_id"], "left").join(targets, ["app_id", "alias_id"], "left")
    bad = F.coalesce(F.col("_to_alias"), F.lit(False)) | F.coalesce(F.col("_is_target"), F.lit(False)) | (F.col("alias_id") == F.col("distinct_id"))
    r = r.withColumn("_bad", bad)
    good = r.filter("not _bad")  # of this batch, an earlier request counts as well
    as_alias = good.groupBy("app_id", F.col("alias_id").alias("distinct_id")).agg(F.min("seq").alias("_alias_seq"))
    as_target = good.groupBy("app_id", F.col("distinct_id").alias("alias_id")).agg(F.min("seq").alias("_target_seq"))
    r = r.join(as_alias, ["app_id", "distinct_id"], "left").join(as_target, ["app_id", "alias_id"], "left")
    chain = F.col("_bad") | (F.col("_alias_seq") < F.col("seq")) | (F.col("_target_seq") < F.col("seq"))
    outcome = F.when(chain, "chain").when(F.col("distinct_id") != F.coalesce("_now", "_first"), "conflict").when(F.col("_now").isNotNull() | (F.col("_n") > 1), "repeat").otherwise("fresh")
    return r.select("app_id", "alias_id", "distinct_id", "seq", outcome.alias("outcome"))


def overlay(rows: DataFrame, aliases: DataFrame, id_column: str = "distinct_id") -> DataFrame:
    """``rows`` with aliased ids replaced by their person, one level deep; Spark broadcasts the aliases if they are small."""
    a = aliases.select(F.col("app_id").alias("_app"), F.col("alias_id").alias("_alias"), F.col("distinct_id").alias("_person"))
    j = rows.join(a, (rows["app_id"] == a["_app"]) & (rows[id_column] == a["_alias"]), "left")
    return j.withColumn(id_column, F.coalesce("_person", id_column)).select(*rows.columns)


def without_chains(aliases: DataFrame) -> DataFrame:
    """Aliases whose target is no alias itself."""
    again = aliases.select("app_id", F.col("alias_id").alias("distinct_id"))
    return aliases.join(again, ["app_id", "distinct_id"], "left_anti").select(*aliases.columns)


def move_rollup(rollup: DataFrame, aliases: DataFrame, sums: list[str]) -> DataFrame:
    """A per-person rollup after its aliases are folded into their persons: sums added, first and last seen extended."""
    key = [c for c in ("app_id", "distinct_id", "environment_id") if c in rollup.columns]
    aggs = [F.sum(c).alias(c) for c in sums] + [f(c).alias(c) for f, c in ((F.min, "first_seen"), (F.max, "last_seen")) if c in rollup.columns]
    return overlay(rollup, aliases).groupBy(*key).agg(*aggs)


def rewrite(frames: dict[str, DataFrame], aliases: DataFrame) -> dict[str, DataFrame]:
    """Every table that names a person, with aliased ids replaced for good: what a merge writes back.

    One join per table; rows of apps without an alias pass through it unchanged. Tables are those given, by name
    (events, errors, transactions, sessions, persons' environments), each with app_id and distinct_id.
    """
    flat = without_chains(aliases)
    return {name: overlay(f, flat) for name, f in frames.items()}
