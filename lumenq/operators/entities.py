"""Persons, devices and their groups; rollups rebuilt from raw rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lumenq.functions.ids import blank_to_null
from lumenq.scope import ALL, Scope


def _counts():
    return [F.sum("is_event").alias("events_count"), F.sum("is_error").alias("errors_count"), F.count_distinct(blank_to_null("session_id")).alias("sessions_count"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen")]


def list_persons(activity: DataFrame, scope: Scope = ALL) -> DataFrame:
    """Persons with any activity in scope, with their counts there."""
    return scope.apply(activity).filter("distinct_id <> ''").groupBy("app_id", "distinct_id").agg(*_counts())


def list_devices(activity: DataFrame, scope: Scope = ALL) -> DataFrame:
    """Devices with any activity in scope; transactions make them members and seen, but aren't counted. The latest
    distinct id goes by (time, id)."""
    last = F.max_by("distinct_id", F.when(F.col("distinct_id") != "", F.struct("occurred_at", "id")))
    return scope.apply(activity).filter("device_key <> ''").groupBy("app_id", "device_key").agg(*_counts(), last.alias("last_distinct_id"))


def device_groups(devices: DataFrame, sessions: DataFrame, start: dt.datetime) -> DataFrame:
    """By family, model, os_name and os_version (nulls are values): devices, lifetime sums, and sessions since ``start``."""
    s = sessions.filter(F.col("started_at") >= F.lit(start)).filter("device_key <> ''").groupBy("app_id", "device_key").agg(F.count(F.lit(1)).alias("sessions"))
    j = devices.join(s, ["app_id", "device_key"], "left")
    return j.groupBy("family", "model", "os_name", "os_version").agg(F.count(F.lit(1)).alias("device_count"), F.sum("events_count").alias("events_count"), F.sum("errors_count").alias("errors_count"), F.sum(F.coalesce("sessions", F.lit(0))).alias("sessions_count"), F.max("last_seen").alias("last_seen"))


def env_rollup(activity: DataFrame, key: str) -> DataFrame:
    """Per (app, key, environment), null being an environment of its own, from 0/1 measures of all sources."""
    return activity.filter(F.col(key) != "").groupBy("app_id", key, "environment_id").agg(*_counts())


def session_timeline(events: DataFrame, errors: DataFrame, tx: DataFrame, app_id: str, session_id: str, each: int = 500) -> DataFrame:
    """One session's events, errors and transactions in order, the first ``each`` of each kind."""
    return timeline([("event", events, "name"), ("error", errors, "message"), ("transaction", tx, "name")], (F.col("app_id") == app_id) & (F.col("session_id") == session_id), each)


def person_timeline(events: DataFrame, errors: DataFrame, app_id: str, distinct_id: str, each: int = 500) -> DataFrame:
    return timeline([("event", events, "name"), ("error", errors, "message")], (F.col("app_id") == app_id) & (F.col("distinct_id") == distinct_id), each)


def timeline(kinds, where, each: int) -> DataFrame:
    legs = [f.filter(where).select(F.lit(k).alias("kind"), "id", F.col("occurred_at").alias("at"), F.col(c).alias("what")).orderBy("at", "id").limit(each) for k, f, c in kinds]
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x)
    return out.orderBy("at", "kind", "id")


def tag_keys(rows: DataFrame, sample: int | None = None) -> DataFrame:
    """(key, n): tag keys of all rows, or of the first ``sample`` tagged ones if a report asks for no more; untagged rows
    are left out before the sample."""
    tagged = rows.select("tags").filter("tags is not null and size(tags) > 0")
    tagged = tagged if sample is None else tagged.limit(sample)
    return tagged.select(F.explode(F.map_keys("tags")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def affected_users(occurrences: DataFrame, lg_k: int = 14) -> DataFrame:
    """(issue_id, users): approximate distinct users from mergeable sketches, with a standard error of 1.04/sqrt(2^lg_k)."""
    o = occurrences.filter("issue_id is not null and distinct_id <> ''")
    return o.groupBy("issue_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg("distinct_id", lg_k)).alias("users"))
