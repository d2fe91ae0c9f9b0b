"""Funnels, journeys, screens and dwell, workflows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lumenq.operators.series import ratio, since, user
from lumenq.operators.users import duration_histogram
from lumenq.query.errors import QueryError
from lumenq.scope import ALL, Scope

DWELL_CAP_MS = 1_800_000
IDLE = dt.timedelta(minutes=30)


def check_funnel(steps: Sequence[str], name: str = "", description: str = "") -> list[str]:
    """The trimmed steps, if a funnel may have them."""
    steps = [s.strip() for s in steps]
    if not 2 <= len(steps) <= 10:
        raise QueryError("bad_funnel", "2 to 10 steps")
    if any(not 0 < len(s) <= 200 for s in steps) or len(name) > 120 or len(description) > 1000:
        raise QueryError("bad_funnel", "too long, or an empty step")
    return steps


def funnel(events: DataFrame, steps: Sequence[str], start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """(step, name, n, from_start, from_previous): users (each of one app) who did the steps in order, each at or after the one before.

    A user's time of a step is its first occurrence at or after its time of the previous step; steps may repeat and
    share a time. Every leg has the constant lower bound of time and its own name filter, so each prunes its scan.
    All legs are joined along one chain partitioned by user, and counted in one aggregate at its end.
    """
    steps = check_funnel(steps)
    rows = since(scope.apply(events), start).filter("distinct_id <> ''")
    leg = lambda s: rows.filter(F.col("name") == s).select("app_id", "distinct_id", "occurred_at")
    who = ["app_id", "distinct_id"]
    chain = leg(steps[0]).groupBy(*who).agg(F.min("occurred_at").alias("t0"))
    for i, s in enumerate(steps[1:], 1):
        times = [f"t{k}" for k in range(i)]
        nxt = leg(s).withColumnsRenamed({"app_id": "_app", "distinct_id": "_id", "occurred_at": "_t"})
        joined = chain.join(nxt, (F.col("app_id") == F.col("_app")) & (F.col("distinct_id") == F.col("_id")) & (F.col("_t") >= F.col(times[-1])), "left")
        chain = joined.groupBy(*who).agg(*[F.first(t).alias(t) for t in times], F.min("_t").alias(f"t{i}"))
    counts = chain.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(len(steps))])
    rowed = counts.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(f"n{i}").alias("n"), F.col("n0").alias("first"), F.col(f"n{max(0, i - 1)}").alias("prev")) for i, s in enumerate(steps)])).alias("step", "x"))
    return rowed.select("step", "x.name", "x.n", ratio(F.col("x.n"), F.col("x.first")).alias("from_start"), ratio(F.col("x.n"), F.col("x.prev")).alias("from_previous"))


def paths(events: DataFrame, start: dt.datetime, depth: int = 5, scope: Scope = ALL) -> DataFrame:
    """(app_id, distinct_id, step, name, next): each user's first ``depth`` events, screens included, ties by id.

    The step limit is applied on the map side too (a group limit of the window), so a user with a third of all rows
    sends ``depth`` of them per task.
    """
    if not 2 <= depth <= 10:
        raise QueryError("bad_depth", "2 to 10")
    rows = since(scope.apply(events), start).filter("distinct_id <> ''").select("app_id", "distinct_id", "occurred_at", "id", "name")
    w = Window.partitionBy("app_id", "distinct_id").orderBy("occurred_at", "id")
    first = rows.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= depth)
    return first.withColumn("next", F.lead(F.struct("name")).over(w))


def journey_nodes(p: DataFrame) -> DataFrame:
    return p.groupBy("step", "name").agg(F.count(F.lit(1)).alias("n"))


def journey_links(p: DataFrame) -> DataFrame:
    """(step, source, target, n): from a step to the next one, within the depth."""
    return p.filter("next is not null").groupBy("step", F.col("name").alias("source"), F.col("next.name").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def dwell(events: DataFrame, start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """(screen, dwell_ms, gaps): time to the session's next event after a screen view, at most 30 minutes each.

    The missing gap of a session's last row is dropped before the cap, which would otherwise stand in for it; gaps
    that aren't positive are dropped.
    """
    rows = since(scope.apply(events), start).filter("session_id <> ''").select("app_id", "session_id", "occurred_at", "id", "name", "screen")
    w = Window.partitionBy("app_id", "session_id").orderBy("occurred_at", "id")
    gap = (F.unix_micros(F.lead("occurred_at").over(w)) - F.unix_micros("occurred_at")) / 1000
    views = rows.withColumn("gap", gap).filter("name = '$screen' and screen is not null and gap is not null and gap > 0")
    return views.groupBy("screen").agg(F.sum(F.least("gap", F.lit(float(DWELL_CAP_MS)))).alias("dwell_ms"), F.count(F.lit(1)).alias("gaps"))


def screen_list(events: DataFrame, errors: DataFrame, start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """(screen, views, events, exceptions, users, avg_dwell_ms), for every screen of an event or an error."""
    ev, er = since(scope.apply(events), start).filter("screen is not null"), since(scope.apply(errors), start).filter("screen is not null")
    view = F.col("name") == "$screen"
    rows = ev.select("screen", "app_id", "distinct_id", F.when(view, "v").otherwise("e").alias("k")).unionByName(er.select("screen", "app_id", "distinct_id", F.lit("x").alias("k")))
    n = lambda k: F.count_if(F.col("k") == k)
    counts = rows.groupBy("screen").agg(n("v").alias("views"), n("e").alias("events"), n("x").alias("exceptions"), F.count_distinct(user()).alias("users"))
    d = dwell(events, start, scope).select("screen", "dwell_ms")
    return counts.join(d, "screen", "left").select("screen", "views", "events", "exceptions", "users", F.round(ratio(F.coalesce("dwell_ms", F.lit(0.0)), F.col("views")), 3).alias("avg_dwell_ms"))


def screen_people(events: DataFrame, errors: DataFrame, screen_devices: DataFrame, start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """(screen, device family, rows, users) of what happened on each screen."""
    rows = [since(scope.apply(f), start).filter("screen is not null").select("app_id", "screen", "device_key", "distinct_id") for f in (events, errors)]
    rows = rows[0].unionByName(rows[1])
    fam = screen_devices.select("app_id", "device_key", "family")
    return rows.join(fam, ["app_id", "device_key"], "left").groupBy("screen", "family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(user()).alias("users"))


def effective_status(now: dt.datetime):
    """A run that is active but idle for more than 30 minutes is abandoned."""
    idle = F.col("last_event_at") < F.lit(now - IDLE)
    return F.when((F.col("status") == "active") & idle, "abandoned").otherwise(F.col("status"))


def run_seconds():
    """The length of a finished run in seconds, else null."""
    return F.when(F.col("status") == "finished", (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6)


def workflow_list(runs: DataFrame, now: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """Per workflow: runs, by effective status, users, median and p95 ms of finished runs, completion rate."""
    r = scope.apply(runs).withColumn("s", effective_status(now)).withColumn("ms", run_seconds() * 1000)
    n = lambda s: F.count_if(F.col("s") == s)
    return r.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), *[n(s).alias(s) for s in ("finished", "failed", "active", "abandoned")], F.count_distinct(user()).alias("unique_users"),
        F.round(F.percentile("ms", 0.5), 6).alias("median_ms"), F.round(F.percentile("ms", 0.95), 6).alias("p95_ms"), F.round(n("finished") / F.count(F.lit(1)), 6).alias("completion_rate"),
    )


def workflow_runs(runs: DataFrame, now: dt.datetime, status: str | None = None, scope: Scope = ALL) -> DataFrame:
    r = scope.apply(runs).withColumn("status", effective_status(now))
    return r if status is None else r.filter(F.col("status") == status)


def workflow_durations(runs: DataFrame, name: str, scope: Scope = ALL) -> DataFrame:
    return duration_histogram(scope.apply(runs).filter(F.col("name") == name).withColumn("seconds", run_seconds()).filter("seconds is not null"), "seconds")


def workflow_top_events(events: DataFrame, name: str, limit: int = 10, scope: Scope = ALL) -> DataFrame:
    """The workflow's most frequent events; its own lifecycle events don't count."""
    e = scope.apply(events).filter((F.col("workflow_name") == name) & ~F.coalesce(F.col("name").startswith("$workflow"), F.lit(False)))
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def workflow_top_issues(errors: DataFrame, name: str, limit: int = 10, scope: Scope = ALL) -> DataFrame:
    """(issue_id, n): the issues that most errors of the workflow belong to, ties by id."""
    e = scope.apply(errors).filter((F.col("workflow_name") == name) & F.col("issue_id").isNotNull())
    return e.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue_id").limit(limit)


def workflow_spans(runs: DataFrame, scope: Scope = ALL) -> DataFrame:
    """Runs of each session in the order they started, with their position from 1; ties by id."""
    w = Window.partitionBy("app_id", "session_id").orderBy("started_at", "workflow_id")
    return scope.apply(runs).filter("session_id <> ''").withColumn("position", F.row_number().over(w))


def screen_recent(events: DataFrame, errors: DataFrame, start: dt.datetime, each: int = 20, scope: Scope = ALL) -> DataFrame:
    """(screen, kind, place, id, occurred_at): the latest ``each`` events and exceptions of every screen, ties by id.

    The limit of the window is applied on the map side too, so a screen with a third of all rows sends ``each`` of them
    per task.
    """
    ev = since(scope.apply(events), start).filter("screen is not null and (name is null or name <> '$screen')").select("screen", F.lit("event").alias("kind"), "id", "occurred_at")
    er = since(scope.apply(errors), start).filter("screen is not null").select("screen", F.lit("exception").alias("kind"), "id", "occurred_at")
    w = Window.partitionBy("screen", "kind").orderBy(F.desc("occurred_at"), F.desc("id"))
    return ev.unionByName(er).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each)
