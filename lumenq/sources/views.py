"""The analytical tables (events, occurrences, transactions, sessions, ...) as views of the delivered telemetry.

Choices made where the delivered tables have no such column: sessions are rolled up by the client's session id;
a workflow run is a session's events named ``x_started`` ... ``x_closed`` or ``x_completed``; monitor checks are the
HTTP transactions of a route; store figures are the orders of a day. ``NOW`` is the fixed clock of the queries.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenq.functions.ids import blank_to_null
from lumenq.session import written
from lumenq.sources.tables import table

NOW = dt.datetime(2023, 1, 16, tzinfo=dt.timezone.utc)


def day(c: str | Column) -> Column:
    """The UTC day as a date (the session's time zone is UTC)."""
    return F.to_date(c)


def events(spark: SparkSession, d: str) -> DataFrame:
    common = ["delivery_id as id", "app_id", "environment_id", "name", "distinct_id", "session_id", "release"]
    tail = ["tags", "timestamp as occurred_at", "received_at"]
    js = table(spark, d, "js").filter("type = 'event' and timestamp is not null").selectExpr(*common, "screen", "device_key", "properties", *tail)
    null = "cast(null as string)"
    node = table(spark, d, "node").filter("type = 'event' and timestamp is not null").selectExpr(*common, f"{null} as screen", f"{null} as device_key", f"{null} as properties", *tail)
    flow = F.nullif(F.regexp_extract("name", "^([a-z]+)_[a-z]+$", 1), F.lit(""))
    both = js.unionByName(node).withColumn("workflow_name", F.when(F.col("session_id") != "", flow))
    return both.withColumn("workflow_id", F.when(F.col("workflow_name").isNotNull(), F.concat_ws(":", "session_id", "workflow_name")))


def issues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "issues")


def environments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "app_environments")


def devices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "devices")


def client_fingerprint(c: str = "fingerprint") -> Column:
    """SHA-256 of the client's fingerprint elements joined by line feeds; null without elements."""
    joined = F.array_join(c, "\n")
    return F.when(joined != "", F.sha2(joined, 256))


_NULL = "cast(null as string)"


def _error_legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Error rows of node, which have fingerprints, and of js, which have none."""
    common = ["delivery_id as id", "app_id", "environment_id", "distinct_id", "session_id", "release", "tags", "timestamp as occurred_at", "received_at"]
    rest = f"{_NULL} as workflow_id", f"{_NULL} as workflow_name", f"{_NULL} as symbolication_status"
    node = table(spark, d, "node").filter("type = 'error' and timestamp is not null").withColumn("fp", client_fingerprint())
    node = node.selectExpr(*common, f"{_NULL} as screen", f"{_NULL} as device_key", "fp as fingerprint", "level", "message", "exception.type as exception_type", "exception.value as exception_value", "exception.stacktrace as stacktrace", "exception.mechanism.handled as handled", f"{_NULL} as extra", *rest)
    kind = node.schema["stacktrace"].dataType.simpleString()
    js = table(spark, d, "js").filter("type = 'error' and timestamp is not null")
    js = js.selectExpr(*common, "screen", "device_key", f"{_NULL} as fingerprint", f"{_NULL} as level", f"{_NULL} as message", f"{_NULL} as exception_type", f"{_NULL} as exception_value", f"cast(null as {kind}) as stacktrace", "cast(null as boolean) as handled", "properties as extra", *rest)
    return node, js


def bare_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Error rows without their issues."""
    node, js = _error_legs(spark, d)
    return node.unionByName(js)


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Error rows with issue_id, null where no issue is established.

    Rows without a fingerprint have a key of their own in the join, so they don't meet in one task; a hot fingerprint is
    on the preserved side, which Spark splits if it doesn't send the issues to all tasks. Rows of js never join.
    """
    i = issues(spark, d).select("app_id", F.col("fingerprint").alias("_key"), F.col("id").alias("issue_id"))
    node, js = _error_legs(spark, d)
    keyed = node.withColumn("_key", F.coalesce("fingerprint", F.concat(F.lit("-"), "id")))
    found = keyed.join(i, ["app_id", "_key"], "left").drop("_key")
    return found.unionByName(js.withColumn("issue_id", F.lit(None).cast(i.schema["issue_id"].dataType)))


def current_issues(spark: SparkSession, d: str) -> DataFrame:
    """Established issues with last_seen and times_seen carried on by the occurrences that came since."""
    s = occurrences(spark, d).filter("issue_id is not null").groupBy(F.col("issue_id").alias("id")).agg(F.max("occurred_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    i = issues(spark, d).join(s, "id", "left")
    return i.withColumns({"last_seen": F.greatest("last_seen", "_last"), "times_seen": F.col("times_seen") + F.coalesce("_n", F.lit(0))}).drop("_last", "_n")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "flutter").filter("timestamp is not null and duration_ms is not null and not isnan(duration_ms)")
    return rows.selectExpr("delivery_id as id", "app_id", "environment_id", "name", "op", "duration_ms", "status", "http_method", "http_status", "url", "distinct_id", "session_id", "device_key", "tags", "cast(null as string) as extra", "timestamp as occurred_at", "finished_at", "received_at")


def activity(spark: SparkSession, d: str) -> DataFrame:
    """Events, errors and transactions as rows of 0/1 measures, for rollups."""
    cols = ["id", "app_id", "environment_id", "distinct_id", "session_id", "device_key", "occurred_at"]
    ev = events(spark, d).selectExpr(*cols, "1 as is_event", "0 as is_error", "0 as is_transaction", "0 as is_unhandled")
    er = bare_occurrences(spark, d).selectExpr(*cols, "0 as is_event", "1 as is_error", "0 as is_transaction", "case when handled = false then 1 else 0 end as is_unhandled")
    tx = transactions(spark, d).selectExpr(*cols, "0 as is_event", "0 as is_error", "1 as is_transaction", "0 as is_unhandled")
    return ev.unionByName(er).unionByName(tx)


_ROLLED: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def _stamp(spark: SparkSession, d: str) -> tuple:
    """Size and time of the tables that rollups are made of."""
    fs = spark._jvm.org.apache.hadoop.fs
    out = []
    for t in ("js", "node", "flutter"):
        p = fs.Path(f"{d}/{t}.parquet")
        f = p.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((f.getContentSummary(p).getLength(), f.getFileStatus(p).getModificationTime()))
    return tuple(out)


def rolled(spark: SparkSession, d: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A rollup as a table of its own, as ingestion keeps it: written when it is first read, and again when a table below
    it has changed."""
    key, stamp = (spark.sparkContext.applicationId, d, build.__name__), _stamp(spark, d)
    if key not in _ROLLED or _ROLLED[key][0] != stamp:
        _ROLLED[key] = stamp, written(build(spark, d), build.__name__)
    return _ROLLED[key][1]


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return rolled(spark, d, session_rollup)


def persons(spark: SparkSession, d: str) -> DataFrame:
    return rolled(spark, d, person_rollup)


def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row per app and client session id."""
    last = F.struct("occurred_at", "id")
    a = activity(spark, d).withColumn("session_id", blank_to_null("session_id")).filter("session_id is not null")
    return a.groupBy("app_id", "session_id").agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_event_at"), F.max_by("environment_id", last).alias("environment_id"), F.max_by("distinct_id", last).alias("distinct_id"), F.max_by("device_key", last).alias("device_key"),
        F.sum("is_event").alias("events_count"), F.sum("is_error").alias("errors_count"), F.sum("is_unhandled").alias("unhandled_errors_count"),
    )


def person_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row per app and distinct id; identified_at and properties (traits, the latest) from identify items."""
    a = activity(spark, d).filter("distinct_id <> ''").groupBy("app_id", "distinct_id").agg(F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.sum("is_event").alias("events_count"), F.sum("is_error").alias("errors_count"), F.count_distinct(blank_to_null("session_id")).alias("sessions_count"))
    known = table(spark, d, "js").filter("type = 'identify' and distinct_id <> ''").groupBy("app_id", "distinct_id").agg(F.min("timestamp").alias("identified_at"), F.max_by("properties", F.when(F.col("properties").isNotNull(), F.struct("timestamp", "delivery_id"))).alias("properties"))
    return a.join(known, ["app_id", "distinct_id"], "left")


def device_list(spark: SparkSession, d: str) -> DataFrame:
    """Known devices with their sessions and the latest person on them."""
    own = activity(spark, d).filter("device_key <> ''").groupBy("app_id", "device_key").agg(F.count_distinct(blank_to_null("session_id")).alias("sessions_count"), F.max_by("distinct_id", F.when(F.col("distinct_id") != "", F.struct("occurred_at", "id"))).alias("distinct_id"))
    return devices(spark, d).join(own, ["app_id", "device_key"], "left").withColumn("sessions_count", F.coalesce("sessions_count", F.lit(0)))


def workflows(spark: SparkSession, d: str) -> DataFrame:
    """Runs: started, ended by x_closed or x_completed (finished) or x_failed (failed), else active."""
    e = events(spark, d).filter("workflow_id is not null")
    done, failed = F.col("name").rlike("_(closed|completed)$"), F.col("name").rlike("_failed$")
    r = e.groupBy("app_id", "workflow_id", "session_id", F.col("workflow_name").alias("name")).agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_event_at"), F.max(F.when(done, F.col("occurred_at"))).alias("finished_at"), F.max(F.when(failed, F.col("occurred_at"))).alias("failed_at"), F.max_by("distinct_id", F.struct("occurred_at", "id")).alias("distinct_id"), F.max_by("environment_id", F.struct("occurred_at", "id")).alias("environment_id"))
    status = F.when(F.col("finished_at").isNotNull(), "finished").when(F.col("failed_at").isNotNull(), "failed").otherwise("active")
    return r.select("app_id", "workflow_id", "session_id", "name", "distinct_id", "environment_id", "started_at", "last_event_at", status.alias("status"), F.coalesce("finished_at", "failed_at").alias("ended_at"))


def monitor_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a route: up below status 400; a null or unusable status counts as down."""
    t = transactions(spark, d).filter("op = 'http'")
    up = F.coalesce(F.col("http_status").between(200, 399), F.lit(False))
    return t.select("id", "app_id", F.concat_ws(" ", "app_id", "name").alias("monitor_id"), F.col("occurred_at").alias("checked_at"), up.alias("up"), F.col("http_status").alias("status_code"), F.col("duration_ms").alias("response_time_ms"))


def store_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("store")).agg(F.count(F.lit(1)).alias("installs"), F.count_if(F.col("o_totalprice") < 50000).alias("uninstalls"))
