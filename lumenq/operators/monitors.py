"""Uptime monitors: percentages, latest checks, and the consecutive-failure state machine."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F


def uptime(checks: DataFrame, now: dt.datetime, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Per monitor the percentage of checks that were up in the last days; null without checks."""
    t = F.col("checked_at")
    pct = lambda d: F.round(100 * F.avg(F.when((t > F.lit(now - dt.timedelta(days=d))) & (t <= F.lit(now)), F.col("up").cast("int"))), 6)
    return checks.groupBy("monitor_id").agg(*[pct(d).alias(f"uptime_{d}d") for d in days])


def monitor_list(checks: DataFrame, now: dt.datetime) -> DataFrame:
    """Per monitor its latest check and its uptime of a day."""
    last = F.max_by(F.struct("up", "status_code", "response_time_ms", "checked_at"), F.struct("checked_at", "id"))
    day = F.when((F.col("checked_at") > F.lit(now - dt.timedelta(days=1))) & (F.col("checked_at") <= F.lit(now)), F.col("up").cast("int"))
    return checks.groupBy("monitor_id").agg(last.alias("x"), F.round(100 * F.avg(day), 6).alias("uptime_1d")).select("monitor_id", "x.up", "x.status_code", "x.response_time_ms", F.col("x.checked_at").alias("last_checked_at"), "uptime_1d")


def latency_points(checks: DataFrame, now: dt.datetime, hours: int) -> DataFrame:
    return checks.filter(F.col("checked_at") >= F.lit(now - dt.timedelta(hours=hours))).select("monitor_id", "checked_at", "response_time_ms", "up")


def status_matches(spec: str, code: Column) -> Column:
    """``200-299,301``: any of the codes and inclusive ranges; parts that are neither are skipped."""
    found: Column = F.lit(False)
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        if low.strip().isdigit() and (not dash or high.strip().isdigit()):
            found = found | code.between(int(low), int(high if dash else low))
    return F.coalesce(found, F.lit(False))


def healthy(spec: str, code: Column, body: Column | None = None, contains: str | None = None) -> Column:
    ok = status_matches(spec, code)
    return ok if contains is None or body is None else ok & F.coalesce(body.contains(contains), F.lit(False))


def fold(checks: Iterable[tuple[object, bool]], down_after: int = 3, up_after: int = 2, state: str = "unknown") -> Iterator[tuple[object, str, str, bool]]:
    """(time, from, to, fires) at each change: so many failures in a row are down, so many successes up. From unknown
    to up is silent."""
    run = 0
    last: bool | None = None
    for at, up in checks:
        run = run + 1 if up == last else 1
        last = up
        to = "up" if up and run >= up_after else "down" if not up and run >= down_after else state
        if to != state:
            yield at, state, to, not (state == "unknown" and to == "up")
            state = to


def transitions(checks: DataFrame, down_after: int = 3, up_after: int = 2) -> DataFrame:
    """(monitor_id, at, source, target, fires) as ``fold``, but by runs of equal checks and window functions.

    A run of failures as long as ``down_after`` sets the state at its ``down_after``-th check, as does a run of
    successes; consecutive settings of the same state are one.
    """
    w = Window.partitionBy("monitor_id").orderBy("checked_at", "id")
    c = checks.select("monitor_id", "checked_at", "id", "up").withColumn("new", F.coalesce((F.col("up") != F.lag("up").over(w)).cast("int"), F.lit(1)))
    c = c.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("monitor_id", "run").orderBy("checked_at", "id")))
    sets = c.filter((F.col("up") & (F.col("k") == up_after)) | (~F.col("up") & (F.col("k") == down_after)))
    sets = sets.withColumn("target", F.when(F.col("up"), "up").otherwise("down"))
    sets = sets.withColumn("source", F.coalesce(F.lag("target").over(w), F.lit("unknown"))).filter("source <> target")
    return sets.select("monitor_id", F.col("checked_at").alias("at"), "source", "target", (~((F.col("source") == "unknown") & (F.col("target") == "up"))).alias("fires"))


def incidents(changes: DataFrame) -> DataFrame:
    """(monitor_id, started_at, ended_at): from a change to down until the next change; open ones end null."""
    w = Window.partitionBy("monitor_id").orderBy("at")
    return changes.withColumn("ended_at", F.lead("at").over(w)).filter("target = 'down'").select("monitor_id", F.col("at").alias("started_at"), "ended_at")
