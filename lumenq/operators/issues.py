"""Issue statistics from occurrences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lumenq.functions.fingerprint import culprit
from lumenq.operators.series import since, user
from lumenq.scope import ALL, Scope

LATEST = ("occurred_at", "id")


def env_stats(issues: DataFrame, occurrences: DataFrame, scope: Scope = ALL) -> DataFrame:
    """Per issue with an occurrence in scope (inner membership): times_seen, users_seen, first and last seen, and title,
    culprit, level and exception_type of its latest occurrence, or the issue's own where that has none."""
    o = scope.apply(occurrences).filter("issue_id is not null")
    last = F.struct(*LATEST)
    said = F.concat_ws(": ", F.nullif("exception_type", F.lit("")), F.nullif("exception_value", F.lit("")))
    o = o.withColumns({"_title": F.coalesce(F.nullif(said, F.lit("")), "message"), "_culprit": F.nullif(culprit(F.col("stacktrace")), F.lit(""))})
    s = o.groupBy("issue_id").agg(F.count(F.lit(1)).alias("times_seen"), F.count_distinct(F.when(F.col("distinct_id") != "", F.col("distinct_id"))).alias("users_seen"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.max_by(F.struct("level", "exception_type", "_title", "_culprit"), last).alias("latest"))
    i = issues.select(F.col("id").alias("issue_id"), "app_id", F.col("title").alias("own_title"), F.col("culprit").alias("own_culprit"), "status", F.col("level").alias("own_level"), F.col("type").alias("own_type"))
    return i.join(s, "issue_id").select("issue_id", "app_id", F.coalesce("latest._title", "own_title").alias("title"), F.coalesce("latest._culprit", "own_culprit").alias("culprit"), "status", F.coalesce("latest.level", "own_level").alias("level"), F.coalesce("latest.exception_type", "own_type").alias("type"), "times_seen", "users_seen", "first_seen", "last_seen")


def issue_stats(issues: DataFrame, levels: tuple[str, ...] = ("fatal", "error", "warning", "info"), statuses: tuple[str, ...] = ("unresolved", "resolved", "ignored")) -> DataFrame:
    """One row: total, and issues by status and by level."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in statuses] + [F.count_if(F.col("level") == x).alias(x) for x in levels]
    return issues.agg(F.count(F.lit(1)).alias("total"), *by)


def issue_stats_scoped(issues: DataFrame, occurrences: DataFrame, scope: Scope) -> DataFrame:
    """``issue_stats`` of the issues with an occurrence in scope, each at the level of its latest occurrence there."""
    return issue_stats(env_stats(issues, occurrences, scope))


def top_issues(issues: DataFrame, limit: int) -> DataFrame:
    """By stored times_seen, ties by id."""
    return issues.orderBy(F.desc("times_seen"), "id").limit(limit)


def top_issues_scoped(issues: DataFrame, occurrences: DataFrame, start: dt.datetime, limit: int, scope: Scope) -> DataFrame:
    """By the count derived within the scope, of issues last seen there since ``start``."""
    s = env_stats(issues, occurrences, scope)
    return since(s, start, "last_seen").orderBy(F.desc("times_seen"), "issue_id").limit(limit)


def occurrence_stats(rows: DataFrame) -> DataFrame:
    """events, users and sessions of whatever rows a list shows; users and sessions are those of an app."""
    session = F.when(F.col("session_id") != "", F.struct("app_id", "session_id"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.count_distinct(user()).alias("users"), F.count_distinct(session).alias("sessions"))
