"""Queries of the general data-processing problems (p2, p3, p4, p5, p7) with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenq.functions.ids import is_uuid, uuid_bytes, uuid_key
from lumenq.operators import dedupe, features, late, sessions, skew
from lumenq.sources.tables import table


def utc_day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# ---- p2: late and out-of-order events

def _node_views(spark: SparkSession, d: str, group: list[str]) -> late.LambdaViews:
    """The table as it was received, week by week, through the fast and the batch layer."""
    return late.replay(late.first_arrivals(table(spark, d, "node"), uuid_key("event_id"), group), group)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _node_views(spark, d, []).late()


def p2_hours(spark: SparkSession, d: str) -> DataFrame:
    return _node_views(spark, d, ["app_id"]).summary()


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return _node_views(spark, d, ["app_id"]).versions()


# ---- p3: sessions by gap

def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sessions(spark, d).select("app_id", "distinct_id", "start_us", "end_us")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessionize(table(spark, d, "node"), ["app_id", "distinct_id"], valid=F.col("distinct_id") != "")
    return s.select("app_id", "distinct_id", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n")


# ---- p4: skewed keys

def _errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "node").filter("type = 'error' and timestamp is not null")
    return rows.select("app_id", utc_day("timestamp").alias("day"), F.coalesce(F.array_join("fingerprint", "\n"), F.lit("")).alias("fingerprint"), F.coalesce(F.col("exception.type"), F.lit("")).alias("exception_type"), "timestamp", "delivery_id")


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    r = skew.first_last_by_key(_errors(spark, d), ["day", "fingerprint", "exception_type"])
    return r.select("day", "fingerprint", "exception_type", "n", F.col("first_row").alias("first_delivery_id"), F.col("last_row").alias("last_delivery_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_keys(spark, d).drop("n")


def p4_issues(spark: SparkSession, d: str) -> DataFrame:
    """Error rows per established issue and day, by a fragment-replicate join."""
    rows = _errors(spark, d).filter("fingerprint <> ''").select("app_id", "day", "delivery_id", F.sha2("fingerprint", 256).alias("fingerprint"))
    issues = table(spark, d, "issues").select("app_id", "fingerprint", F.col("id").alias("issue_id"), "status")
    j = skew.fragment_replicate_join(rows, issues, ["app_id", "fingerprint"], "delivery_id")
    return j.groupBy("issue_id", "status", "day").agg(F.count(F.lit(1)).alias("n"))


# ---- p5: feature table

def _js_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "js").filter("type = 'event' and timestamp is not null and distinct_id <> ''").select("app_id", "distinct_id", "name", "timestamp", "delivery_id")


def p5_types(spark: SparkSession, d: str) -> DataFrame:
    r = features.typed_stats(_js_events(spark, d), ["app_id", "distinct_id"], "name")
    return r.select("app_id", "distinct_id", "name", "n", "last_us", F.col("last_row").alias("last_delivery_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_types(spark, d).select("app_id", "distinct_id", "name", "last_delivery_id")


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_table(_js_events(spark, d), ["app_id", "distinct_id"], "name")


# ---- p7: messages delivered more than once

def p7_found(spark: SparkSession, d: str) -> DataFrame:
    legs = [dedupe.removed_deliveries(table(spark, d, t), uuid_bytes("event_id"), valid=is_uuid("event_id")).select(F.lit(t).alias("src"), "delivery_id") for t in ("js", "node")]
    return legs[0].unionByName(legs[1])


def p7_kept_js(spark: SparkSession, d: str) -> DataFrame:
    """What stays of js, with all its columns."""
    return dedupe.keep_first(table(spark, d, "js"), uuid_bytes("event_id"), valid=is_uuid("event_id"))


def p7_kept_node(spark: SparkSession, d: str) -> DataFrame:
    """What stays of node, with all its columns."""
    return dedupe.keep_first(table(spark, d, "node"), uuid_bytes("event_id"), valid=is_uuid("event_id"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What stays of both tables, in the columns they share."""
    cols = ["delivery_id", "batch_id", "app_id", "environment_id", "type", "event_id", "name", "distinct_id", "session_id", "timestamp", "sent_at", "received_at", "release"]
    legs = [dedupe.keep_first(table(spark, d, t).select(*cols), uuid_bytes("event_id"), valid=is_uuid("event_id")).select(F.lit(t).alias("src"), "*") for t in ("js", "node")]
    return legs[0].unionByName(legs[1])


QUERIES = {f.__name__: f for f in (p2_found, p2_hours, p2_versions, p3_found, p3_sessions, p4_found, p4_keys, p4_issues, p5_found, p5_types, p5_features, p7_found, p7_kept, p7_kept_js, p7_kept_node)}

_UUID = "case when regexp_full_match(lower(event_id), '(urn:uuid:)?\\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\\}?') then nullif(right(replace(replace(replace(lower(event_id), '-', ''), '{', ''), '}', ''), 32), repeat('0', 32)) end"

_MESSAGES = f"""
with keyed as (select delivery_id, app_id, epoch_us(timestamp) as t, epoch_us(received_at) as r, coalesce({_UUID}, 'row ' || delivery_id) as u from node where timestamp is not null),
ranked as (select *, row_number() over (partition by u order by r, delivery_id) as k from keyed),
messages as (select delivery_id, app_id, t, r, (t // 3600000000) * 3600000000 as p from ranked where k = 1),
classed as (select *, p + 3600000000 as e, case when r < p + 3600000000 then 'fast' when r < p + 25 * 3600000000 then 'batch' else 'frozen' end as layer,
  least((r // 3600000000) * 3600000000 + 3600000000, p + 25 * 3600000000) as run from messages)
"""

_SESSIONS = """
with rows_ as (select app_id, distinct_id, epoch_us(timestamp) as t from node where timestamp is not null and distinct_id <> ''),
cuts as (select *, case when t - lag(t) over w <= 1800000000 then 0 else 1 end as c from rows_ window w as (partition by app_id, distinct_id order by t)),
parts as (select *, sum(c) over (partition by app_id, distinct_id order by t rows unbounded preceding) as s from cuts),
done as (select app_id, distinct_id, min(t) as start_us, max(t) as end_us, max(t) - min(t) as duration_us, count(*) as n from parts group by app_id, distinct_id, s)
"""

_ERRORS = "(select app_id, strftime(timestamp at time zone 'UTC', '%Y-%m-%d') as day, coalesce(array_to_string(fingerprint, chr(10)), '') as fingerprint, coalesce(exception.type, '') as exception_type, timestamp, delivery_id from node where type = 'error' and timestamp is not null)"
_KEYS = f"select day, fingerprint, exception_type, count(*) as n, arg_min(delivery_id, (timestamp, delivery_id)) as first_delivery_id, arg_max(delivery_id, (timestamp, delivery_id)) as last_delivery_id from {_ERRORS} group by all"
_TYPES = "select app_id, distinct_id, name, count(*) as n, epoch_us(max(timestamp)) as last_us, arg_max(delivery_id, (timestamp, delivery_id)) as last_delivery_id from js where type = 'event' and timestamp is not null and distinct_id <> '' group by all"


def _ranked(src: str) -> str:
    return f"(select *, {_UUID} as u, row_number() over (partition by {_UUID} order by received_at, delivery_id) as k from {src})"


_KEPT_COLS = "delivery_id, batch_id, app_id, environment_id, type, event_id, name, distinct_id, session_id, timestamp, sent_at, received_at, release"

SQL = {
    "p2_found": _MESSAGES + "select delivery_id, case layer when 'batch' then 'corrected' else 'dropped' end as outcome from classed where layer <> 'fast'",
    "p2_hours": _MESSAGES + "select app_id, p as period_us, count(*) filter (layer = 'fast') as provisional, count(*) filter (layer <> 'frozen') as final, count(*) filter (layer = 'batch') as corrected, count(*) filter (layer = 'frozen') as dropped, max(run) filter (layer = 'batch') as last_run_us from classed group by all",
    "p2_versions": _MESSAGES + "select app_id, period_us, run_us, added, cast(sum(added) over (partition by app_id, period_us order by run_us) as bigint) as value from (select app_id, p as period_us, case layer when 'fast' then 0 else run end as run_us, count(*) as added from classed where layer <> 'frozen' group by all)",
    "p3_found": _SESSIONS + "select app_id, distinct_id, start_us, end_us from done",
    "p3_sessions": _SESSIONS + "select * from done",
    "p4_found": f"select day, fingerprint, exception_type, first_delivery_id, last_delivery_id from ({_KEYS})",
    "p4_keys": _KEYS,
    "p4_issues": f"select i.id as issue_id, i.status, e.day, count(*) as n from {_ERRORS} e join issues i on i.app_id = e.app_id and i.fingerprint = sha256(e.fingerprint) where e.fingerprint <> '' group by all",
    "p5_found": f"select app_id, distinct_id, name, last_delivery_id from ({_TYPES})",
    "p5_types": _TYPES,
    "p5_features": f"with s as ({_TYPES}), names as (select distinct name from s where name is not null), ents as (select app_id, distinct_id, cast(sum(n) as bigint) as n_events, max(last_us) as last_us from s group by all), grid as (select e.app_id, e.distinct_id, x.name from ents e, names x) "
    "select e.app_id, e.distinct_id, e.n_events, e.last_us, g.counts, g.last_by_type from ents e join (select grid.app_id, grid.distinct_id, list(coalesce(s.n, 0) order by grid.name) as counts, list(s.last_us order by grid.name) as last_by_type from grid left join s using (app_id, distinct_id, name) group by all) g using (app_id, distinct_id)",
    "p7_found": " union all ".join(f"select '{t}' as src, delivery_id from {_ranked(t)} where u is not null and k > 1" for t in ("js", "node")),
    "p7_kept": " union all ".join(f"select '{t}' as src, {_KEPT_COLS} from {_ranked(t)} where u is null or k = 1" for t in ("js", "node")),
}
