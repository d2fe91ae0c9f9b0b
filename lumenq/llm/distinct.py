"""Problem 1: distinct counts over huge identifier sets, by hash-range decomposition.

Every identifier belongs to one of ``buckets`` disjoint hash ranges. (identifier, group) pairs are deduplicated, the
pairs of a bucket come together, any union of groups is counted exactly within its bucket, and bucket counts add up,
since no identifier is in two buckets. The error is therefore 0; memory per task falls as buckets are added.

The deduplicated pairs are the mergeable partial result: ``merge`` of the pairs of days, partitions or tables counts
the same as the pairs of all their rows.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def pairs(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, kind, id, *groups) without repetition; kind is the position in ``ids``. Null and empty ids are left out.

    Null group values are values of their own. Deduplication starts on the map side and is spread over identifier
    and groups together, so an identifier that holds a third of all rows burdens no task.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("string").alias("id")) for i, c in enumerate(ids)])
    rows = df.select(F.explode(kinds).alias("_x"), *[c.alias(f"g{i}") for i, c in enumerate(groups.values())])
    rows = rows.select("_x.kind", "_x.id", *[f"g{i}" for i in range(len(groups))]).filter("id <> ''").distinct()
    named = [F.col(f"g{i}").alias(g) for i, g in enumerate(groups)]
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "kind", "id", *named)


def merge(*parts: DataFrame) -> DataFrame:
    """The union of partial results made with the same ids, groups and number of buckets."""
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def _count(variants: DataFrame, by: list[str], ids: Sequence[str]) -> DataFrame:
    """Distinct within the bucket, where all of an identifier's rows lie already; then the buckets' counts added."""
    once = variants.select("bucket", "kind", "id", *by).distinct()
    return once.groupBy(*by).agg(*[F.count_if(F.col("kind") == i).alias(c) for i, c in enumerate(ids)])


def grouping_sets(found: DataFrame, ids: Sequence[str], groups: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """(grp, *groups, *ids): the distinct ids of every group of every set; grp names the set, other groups are null."""
    sample = {f.name: f.dataType for f in found.schema}
    one = lambda s: F.struct(F.lit(",".join(s) or "all").alias("grp"), *[(F.col(g) if g in s else F.lit(None).cast(sample[g])).alias(g) for g in groups])
    rows = found.repartition("bucket").select("bucket", "kind", "id", F.explode(F.array(*map(one, sets))).alias("_v"))
    return _count(rows.select("bucket", "kind", "id", "_v.*"), ["grp", *groups], ids)


def unions(found: DataFrame, ids: Sequence[str], wanted: Mapping[str, Column]) -> DataFrame:
    """(grp, *ids): the distinct ids in each named union of groups, given as a condition on the group columns.

    A union without rows isn't in the result. A condition that is null isn't fulfilled.
    """
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wanted.items()]))
    rows = found.repartition("bucket").select("bucket", "kind", "id", F.explode(named).alias("grp"))
    return _count(rows, ["grp"], ids)
