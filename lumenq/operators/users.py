"""Users and sessions over time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lumenq.operators.latency import percentiles
from lumenq.operators.series import one_row, ratio, since
from lumenq.query.errors import QueryError
from lumenq.scope import ALL, Scope

MS = 1000
HISTOGRAM = (("<10s", 10), ("10-60s", 60), ("1-5m", 300), ("5-30m", 1800), ("30m+", None))
MAX_DAYS, MAX_APPS, MAX_CELLS = 92, 20, 1200


def seen(*frames: DataFrame, scope: Scope = ALL) -> DataFrame:
    """(app_id, distinct_id, occurred_at) of all frames, without null and empty ids."""
    parts = [scope.apply(f).filter("distinct_id <> ''").select("app_id", "distinct_id", "occurred_at") for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duration_ms(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_ms", (F.unix_micros("last_event_at") - F.unix_micros("started_at")) / MS)


def user_stats(persons: DataFrame, events: DataFrame, errors: DataFrame, sessions: DataFrame, start: dt.datetime, now: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """One row: total, active and new users, distinct users of the last 1, 7 and 30 days, session lengths, stickiness."""
    p = persons.agg(F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("last_seen") >= F.lit(start)).alias("active_in_range"), F.count_if(F.col("first_seen") >= F.lit(start)).alias("new_in_range"))
    back = lambda d: F.lit(now - dt.timedelta(days=d))
    # one row per user of an app first: three distinct counts then need no expansion
    last = seen(events, errors, scope=scope).filter(F.col("occurred_at") <= F.lit(now)).groupBy("app_id", "distinct_id").agg(F.max("occurred_at").alias("t"))
    a = last.agg(*[F.count_if(F.col("t") >= back(d)).alias(n) for n, d in (("dau", 1), ("wau", 7), ("mau", 30))])
    s = session_stats(sessions, start, scope).select("avg_session_ms", "median_session_ms")
    return one_row(p, a, s).withColumn("stickiness", ratio(F.col("dau"), F.col("mau")))


def active_user_series(persons: DataFrame, events: DataFrame, errors: DataFrame, start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """(day, active_users, new_users): days with either; the other is 0."""
    active = since(seen(events, errors, scope=scope), start).groupBy(F.to_date("occurred_at").alias("day")).agg(F.count_distinct("app_id", "distinct_id").alias("active_users"))
    new = since(persons, start, "first_seen").groupBy(F.to_date("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("new_users"))
    return active.join(new, "day", "full").select("day", F.coalesce("active_users", F.lit(0)).alias("active_users"), F.coalesce("new_users", F.lit(0)).alias("new_users"))


def day_grid(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    spark = df.sparkSession
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def active_users_combined(legs: Sequence[DataFrame], persons: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(day, total, identified, guest) over several apps: identified users merge across apps by their id, guests don't.

    ``legs``: scoped frames of app_id, distinct_id, occurred_at. Days without users are there, as 0.
    """
    rows = seen(*legs)
    rows = rows.withColumn("day", F.to_date("occurred_at")).filter(F.col("day").between(F.lit(first), F.lit(last)))
    rows = rows.select("app_id", "distinct_id", "day").distinct()
    known = persons.filter("identified_at is not null").select("app_id", "distinct_id", F.lit(True).alias("known"))
    keyed = rows.join(known, ["app_id", "distinct_id"], "left")
    identity = F.when(F.col("known"), F.concat(F.lit("u:"), "distinct_id")).otherwise(F.concat(F.lit("a:"), "app_id", F.lit(":"), "distinct_id"))
    once = keyed.select("day", identity.alias("identity"), F.coalesce("known", F.lit(False)).alias("known")).distinct()
    n = once.groupBy("day").agg(F.count(F.lit(1)).alias("total"), F.count_if("known").alias("identified"), F.count_if(~F.col("known")).alias("guest"))
    grid = day_grid(rows, first, last)
    return grid.join(n, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "identified", "guest")])


def report_window(now: dt.datetime, days: int, apps: int, watermark: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """First and last day of a report: whole UTC days up to yesterday, not before the watermark's day."""
    if not 1 <= days <= MAX_DAYS:
        raise QueryError("bad_window", f"1 to {MAX_DAYS} days")
    if not 1 <= apps <= MAX_APPS or apps * days > MAX_CELLS:
        raise QueryError("bad_window", f"at most {MAX_APPS} apps, and {MAX_CELLS} app days")
    last = now.astimezone(dt.timezone.utc).date() - dt.timedelta(days=1)
    first = last - dt.timedelta(days=days - 1)
    return (max(first, watermark) if watermark else first), last


def session_stats(sessions: DataFrame, start: dt.datetime, scope: Scope = ALL, k: int | None = None) -> DataFrame:
    """sessions, crashed (an unhandled error on the session's own row), average and median length in ms; with ``k`` the
    median of a sketch (``latency.percentiles``), which is right for more sessions than one buffer holds lengths of."""
    s = duration_ms(since(scope.apply(sessions), start, "last_event_at"))
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("unhandled_errors_count") > 0).alias("crashed"), F.round(F.avg("duration_ms"), 3).alias("avg_session_ms"), F.round(percentiles("duration_ms", [0.5], k)[0], 6).alias("median_session_ms"))


def session_duration_series(sessions: DataFrame, start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    s = duration_ms(since(scope.apply(sessions), start, "started_at"))
    return s.groupBy(F.to_date("started_at").alias("day")).agg(F.round(F.avg("duration_ms"), 3).alias("avg_ms"))


def duration_histogram(df: DataFrame, seconds: str) -> DataFrame:
    """(bucket, label, n) of the five fixed lengths, the upper bound outside; missing ones are 0."""
    c, case = F.col(seconds), None
    for i, (_, top) in enumerate(HISTOGRAM):
        case = (F.when(c < top, i) if case is None else case.when(c < top, i)) if top else case.when(c.isNotNull(), i)
    n = df.select(case.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    labels = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x, _ in HISTOGRAM])).alias("bucket", "label"))
    return labels.join(n, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))
