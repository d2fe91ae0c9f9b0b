"""The cold tier: Parquet below app_id=/year=/month=, its export, reads, restores, and reads across both tiers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenq.operators.identity import overlay
from lumenq.plans.tier import Range, months, plan
from lumenq.scope import Scope

MAX_DAYS = 400


def _within(df: DataFrame, ranges: Iterable[Range], column: str = "occurred_at") -> DataFrame:
    kept = F.lit(False)
    for a, b in ranges:
        kept = kept | ((F.col(column) >= F.lit(a)) & (F.col(column) < F.lit(b)))
    return df.filter(kept)


def export(rows: DataFrame, path: str, ranges: Iterable[Range]) -> None:
    """Append the rows of the ranges; one file per task and month, sorted by time so that row groups prune."""
    t = F.col("occurred_at")
    out = _within(rows, ranges).withColumns({"year": F.year(t), "month": F.month(t)})
    out.repartition("app_id", "year", "month", F.pmod(F.xxhash64("occurred_at"), F.lit(8))).sortWithinPartitions("app_id", "occurred_at").write.mode("append").partitionBy("app_id", "year", "month").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def read(spark: SparkSession, path: str, schema, ranges: list[Range], app_ids: Iterable[str] | None = None) -> DataFrame:
    """Cold rows of the ranges. No file is no row; files of older schemas lack columns, which are null.

    Conditions on app_id, year and month, derived from the ranges, prune partitions before any file is opened.
    """
    names = [f.name for f in schema]
    if not ranges or not exists(spark, path):
        return spark.createDataFrame([], schema)
    got = spark.read.option("mergeSchema", True).option("basePath", path).parquet(path)
    ym = sorted({m for a, b in ranges for m in months(a, b)})
    got = got.filter(_any_month(ym))
    if app_ids is not None:
        got = got.filter(F.col("app_id").isin(*app_ids))
    cols = [(F.col(f.name) if f.name in got.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return _within(got, ranges).select(*cols).select(*names)


def _any_month(ym):
    kept = F.lit(False)
    for y, m in ym:
        kept = kept | ((F.col("year") == y) & (F.col("month") == m))
    return kept


def across(spark: SparkSession, hot: DataFrame, path: str, watermark: dt.datetime, start: dt.datetime, end: dt.datetime, restored: Iterable[Range] = (), app_ids: Iterable[str] | None = None, late: bool = True) -> DataFrame:
    """One frame over both tiers. ``late``: rows that arrived for a cold range after its export are still hot and count.

    ``hot`` must hold no exported rows but those of restored ranges.
    """
    if end - start > dt.timedelta(days=MAX_DAYS):
        raise ValueError(f"at most {MAX_DAYS} days")
    p = plan(watermark, start, end, restored)
    near = _within(hot, [(start, end)] if late else p["hot"])
    return near.unionByName(read(spark, path, hot.schema, p["cold"], app_ids))


def counts_by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def merge_day_counts(*parts: DataFrame) -> DataFrame:
    """Counts add up across tiers; distinct counts don't, and are taken from the united rows instead."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("day").agg(F.sum("n").alias("n"))


def distinct_by_day(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    rows = rows if aliases is None else overlay(rows, aliases)
    who = [c for c in ("app_id", "distinct_id") if c in rows.columns]  # a frame of one app may come without it
    return rows.filter("distinct_id <> ''").groupBy(F.to_date("occurred_at").alias("day")).agg(F.count_distinct(*who).alias("users"))


def concatenated_distinct(hot: DataFrame, cold: DataFrame, watermark: dt.datetime) -> DataFrame:
    """(day, users, partial): per-tier distinct counts side by side; the day of the seam is in both and is left out of
    the figures (null) and flagged, as its counts can't be added."""
    seam = watermark.astimezone(dt.timezone.utc).date()
    both = distinct_by_day(cold).unionByName(distinct_by_day(hot))
    split = watermark != dt.datetime(seam.year, seam.month, seam.day, tzinfo=dt.timezone.utc)
    is_seam = (F.col("day") == F.lit(seam)) & F.lit(split)
    return both.withColumn("partial", is_seam).groupBy("day", "partial").agg(F.max(F.when(~is_seam, F.col("users"))).alias("users"))


def counts_by_key(rows: DataFrame, key: str, among: DataFrame | None = None) -> DataFrame:
    """(key, n, first, last), of the keys in ``among`` if given."""
    rows = rows if among is None else rows.join(among.select(key).distinct(), key, "left_semi")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))


def count_range(rows: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """(n): rows in [start, end)."""
    return _within(rows, [(start, end)]).agg(F.count(F.lit(1)).alias("n"))


def counts_by_app(rows: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """(app_id, n) of [start, end)."""
    return _within(rows, [(start, end)]).groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))


def count_restorable(cold: DataFrame, wanted: Range, live: DataFrame, key: str = "id") -> DataFrame:
    """(n): cold rows of a range that a restore would bring back, being not in the live table (as restored before)."""
    there = _within(live, [wanted]).select(key)
    return _within(cold, [wanted]).join(there, key, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def count_in_purge_scope(rows: DataFrame, scope: Scope, start: dt.datetime | None = None, end: dt.datetime | None = None, distinct_ids: Iterable[str] | None = None) -> DataFrame:
    """(n): rows a purge would take: in scope, in [start, end) as far as given, of the persons given."""
    rows = scope.apply(rows)
    if start is not None:
        rows = rows.filter(F.col("occurred_at") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("occurred_at") < F.lit(end))
    if distinct_ids is not None:
        rows = rows.filter(F.col("distinct_id").isin(*distinct_ids))
    return rows.agg(F.count(F.lit(1)).alias("n"))


def restore(spark: SparkSession, path: str, live_schema, wanted: Range, pin: str) -> DataFrame:
    """Cold rows of a range in the live table's columns and types, tagged with the pin that keeps them hot."""
    return read(spark, path, live_schema, [wanted]).withColumn("restore_pin", F.lit(pin))


def cycle(spark: SparkSession, hot: DataFrame, path: str, ranges: list[Range], watermark: dt.datetime, now: dt.datetime | None = None, keep: dt.timedelta = dt.timedelta(0), lag: dt.timedelta = dt.timedelta(0), pinned: Iterable[Range] = ()) -> tuple[dt.datetime, list[Range]]:
    """Export ranges oldest first and verify each; (new watermark, ranges that may be dropped from the hot tier).

    Ranges that end within ``keep`` of ``now`` stay hot. An append isn't repeatable, so a range that already has cold rows
    must match the hot count, and is not exported again; the first that doesn't ends the cycle, so the watermark never
    skips one. Dropped may be what lay below the watermark before the cycle (a range is in both tiers for a cycle at
    least), ended ``lag`` ago, is not pinned by a restore, and has not grown by late rows since its export. Folders
    of ranges to come need no making.
    """
    before, pinned = watermark, list(pinned)
    drop = []
    for r in sorted(ranges):
        if now is not None and r[1] > now - keep:
            continue
        want = _within(hot, [r]).count()
        have = read(spark, path, hot.schema, [r]).count()
        if have == 0 and want:
            export(hot, path, [r])
            have = read(spark, path, hot.schema, [r]).count()
        if have != want:
            if r[1] <= before and want > have:
                continue  # grown: its late rows are nowhere else
            break
        watermark = max(watermark, r[1])
        if r[1] <= before and (now is None or now - r[1] >= lag) and not any(a < r[1] and r[0] < b for a, b in pinned):
            drop.append(r)
    return watermark, drop
