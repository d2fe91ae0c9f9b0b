"""Problem 6: percentiles of very large numeric columns, by randomised compactor hierarchies (KLL).

A sketch keeps levels of at most about k values; a full level is sorted and, from a random offset, every other value
moves one level up with twice the weight. Sketches merge level by level, so partial sketches of partitions and days
combine into those of any union, within one bound: a reported percentile's rank is off by at most ``bound(k)`` of the
rows, which is twice the published error at 99 % probability, and not at all up to k rows. The sketches are Spark's own aggregates (JVM-side,
combined on the map side).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

K = 1600
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """The published bound of a single percentile's rank for KLL sketches at 99 % probability."""
    return 2.296 / k**0.9723


def bound(k: int = K) -> float:
    """The stated error of a rank: twice ``rank_error``, which, the error being near normal, one percentile in more than
    a million exceeds. 0.35 % for K."""
    return 2 * rank_error(k)


def partial_sketches(df: DataFrame, value: str, groups: Mapping[str, Column], k: int = K) -> DataFrame:
    """(*groups, sketch): one mergeable partial result per group.

    Null, NaN and infinite values are left out; repeated rows and ties count. A group without values has no row.
    Null group values are values of their own.
    """
    v = F.col(value).cast("double")
    rows = df.select(*[c.alias(g) for g, c in groups.items()], v.alias("_v")).filter((F.abs("_v") < float("inf")) & ~F.isnan("_v"))
    return rows.groupBy(*groups).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merged(partials: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """(*by, sketch): partial sketches combined level by level."""
    return partials.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def answers(sketches: DataFrame, by: Sequence[str], at: Sequence[float] = PERCENTILES) -> DataFrame:
    """(*by, n, p25, p50, ...): rows and percentiles of each sketch."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in at]))
    rows = sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), q.alias("_q"))
    return rows.select(*by, "n", *[F.col("_q")[i].alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(at)])


def grouping_sets(partials: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], k: int = K, at: Sequence[float] = PERCENTILES) -> DataFrame:
    """(grp, *groups, n, percentiles) of every group of every set, all from the partial sketches, not from the rows."""
    sample = {f.name: f.dataType for f in partials.schema}
    one = lambda s: F.struct(F.lit(",".join(s) or "all").alias("grp"), *[(F.col(g) if g in s else F.lit(None).cast(sample[g])).alias(g) for g in groups])
    rows = partials.select("sketch", F.explode(F.array(*map(one, sets))).alias("_v")).select("sketch", "_v.*")
    return answers(merged(rows, ["grp", *groups], k), ["grp", *groups], at)
