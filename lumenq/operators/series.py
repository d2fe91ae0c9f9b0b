"""Event and error series, totals and rates. Every input is scoped before anything else."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from lumenq.scope import ALL, Scope


def since(df: DataFrame, start: dt.datetime | None, column: str = "occurred_at") -> DataFrame:
    return df if start is None else df.filter(F.col(column) >= F.lit(start))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def user() -> Column:
    """Whom a row is about: apps share identity strings, so a user is one of an app. Null without an identity."""
    return F.when(F.col("distinct_id") != "", F.struct("app_id", "distinct_id"))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side, by a union and an aggregate rather than a cross join."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def top_events(events: DataFrame, start: dt.datetime, limit: int, scope: Scope = ALL) -> DataFrame:
    """(name, n): the most frequent names, ties by name."""
    n = since(scope.apply(events), start).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), F.asc_nulls_last("name")).limit(limit)


def daily(rows: DataFrame, start: dt.datetime | None, scope: Scope = ALL, where: Column | None = None) -> DataFrame:
    """(day, n): rows per UTC day; ``where`` narrows to a name or an issue."""
    rows = since(scope.apply(rows), start)
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def overview_totals(events: DataFrame, errors: DataFrame, sessions: DataFrame, persons: DataFrame, start: dt.datetime, scope: Scope = ALL) -> DataFrame:
    """One row: events (screens included), errors, sessions, crashed_sessions, users, new_users, has_crash_signal.

    Under an environment scope users are members of the scoped events, errors and sessions; else the durable rows.
    """
    ev, er, se = since(scope.apply(events), start), since(scope.apply(errors), start), since(scope.apply(sessions), start, "last_event_at")
    kinds = [ev.select(F.lit("ev").alias("k"), "app_id", "distinct_id", F.lit(None).cast("boolean").alias("flag")), er.select(F.lit("er").alias("k"), "app_id", "distinct_id", F.col("handled").isNotNull().alias("flag")), se.select(F.lit("se").alias("k"), "app_id", "distinct_id", (F.col("unhandled_errors_count") > 0).alias("flag"))]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    n = lambda c: F.count_if(c)
    k = F.col("k")
    totals = rows.agg(n(k == "ev").alias("events"), n(k == "er").alias("errors"), n(k == "se").alias("sessions"), n((k == "se") & F.col("flag")).alias("crashed_sessions"), n((k == "er") & F.col("flag")).alias("_known"))
    people = Scope(scope.app_id, apps=scope.apps).apply(persons)
    if scope.env.kind != "all":
        members = rows.filter("distinct_id <> ''").select("app_id", "distinct_id").distinct()
        people = people.join(members, ["app_id", "distinct_id"], "left_semi")
    users = people.agg(n(F.col("last_seen") >= F.lit(start)).alias("users"), n(F.col("first_seen") >= F.lit(start)).alias("new_users"))
    return one_row(totals, users).select("events", "errors", "sessions", "crashed_sessions", "users", "new_users", ((F.col("errors") == 0) | (F.col("_known") > 0)).alias("has_crash_signal"))


def overview_rates(totals: DataFrame) -> DataFrame:
    """error_rate: errors per event and error. crash_free: null without sessions, or if errors say nothing of handling."""
    crash_free = F.when((F.col("sessions") > 0) & F.col("has_crash_signal"), 1 - F.col("crashed_sessions") / F.col("sessions"))
    return totals.select(ratio(F.col("errors"), F.col("events") + F.col("errors")).alias("error_rate"), crash_free.alias("crash_free"))
