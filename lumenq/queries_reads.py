"""Queries of searches, analytical reads, rollups, tiers, monitors and alerts, each with its SQL.

The clock is ``views.NOW``; windows reach 30 days back from it and cover every period of the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenq.functions import fingerprint as fp
from lumenq.operators import alerts, behaviour, entities, identity, issues as iss, latency, monitors, pii, purge, series, users
from lumenq.plans import paging, search
from lumenq.query import Resource, parse
from lumenq.scope import ALL, Env, Scope
from lumenq.session import shared_dir
from lumenq.sources import tier, views
from lumenq.sources.tables import table

NOW = views.NOW
SINCE = NOW - dt.timedelta(days=30)
STEPS = ("$screen", "$pageview", "coupon_viewed", "cart_retried")

QUERIES: dict = {}
SQL: dict[str, str] = {}

# ---- SQL of the views

_S = "timestamptz '2022-12-17 00:00:00+00'"
_N = "timestamptz '2023-01-16 00:00:00+00'"
_DAY = "cast(occurred_at at time zone 'UTC' as date)"
_CTE = f"""with ev0 as (
 select delivery_id as id, app_id, environment_id, name, distinct_id, session_id, release, screen, device_key, properties, tags, timestamp as occurred_at from js where type = 'event' and timestamp is not null
 union all select delivery_id, app_id, environment_id, name, distinct_id, session_id, release, null, null, null, tags, timestamp from node where type = 'event' and timestamp is not null),
ev as (select *, case when session_id <> '' then nullif(regexp_extract(name, '^([a-z]+)_[a-z]+$', 1), '') end as workflow_name from ev0),
er0 as (
 select delivery_id as id, app_id, environment_id, distinct_id, session_id, release, tags, timestamp as occurred_at, null as screen, null as device_key, case when array_to_string(fingerprint, chr(10)) <> '' then sha256(array_to_string(fingerprint, chr(10))) end as fingerprint,
  level, message, exception.type as exception_type, exception.value as exception_value, exception.stacktrace as stacktrace, exception.mechanism.handled as handled, null as extra from node where type = 'error' and timestamp is not null
 union all select delivery_id, app_id, environment_id, distinct_id, session_id, release, tags, timestamp, screen, device_key, null, null, null, null, null, null, null, properties from js where type = 'error' and timestamp is not null),
er as (select er0.*, i.id as issue_id from er0 left join issues i on i.app_id = er0.app_id and i.fingerprint = er0.fingerprint),
tx as (select delivery_id as id, app_id, environment_id, name, op, duration_ms, status, http_method, http_status, url, distinct_id, session_id, device_key, tags, timestamp as occurred_at, finished_at from flutter where timestamp is not null and duration_ms is not null and not isnan(duration_ms)),
act as (
 select id, app_id, environment_id, distinct_id, session_id, device_key, occurred_at, 1 as is_event, 0 as is_error, 0 as is_unhandled from ev
 union all select id, app_id, environment_id, distinct_id, session_id, device_key, occurred_at, 0, 1, case when handled = false then 1 else 0 end from er0
 union all select id, app_id, environment_id, distinct_id, session_id, device_key, occurred_at, 0, 0, 0 from tx),
se as (select app_id, session_id, min(occurred_at) as started_at, max(occurred_at) as last_event_at, arg_max_null(environment_id, (occurred_at, id)) as environment_id, arg_max_null(distinct_id, (occurred_at, id)) as distinct_id, arg_max_null(device_key, (occurred_at, id)) as device_key,
  cast(sum(is_event) as bigint) as events_count, cast(sum(is_error) as bigint) as errors_count, cast(sum(is_unhandled) as bigint) as unhandled_errors_count, (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1000 as duration_ms from act where session_id <> '' group by app_id, session_id),
known as (select app_id, distinct_id, min(timestamp) as identified_at from js where type = 'identify' and distinct_id <> '' group by all),
pe as (select a.*, k.identified_at from (select app_id, distinct_id, min(occurred_at) as first_seen, max(occurred_at) as last_seen, cast(sum(is_event) as bigint) as events_count, cast(sum(is_error) as bigint) as errors_count, count(distinct nullif(session_id, '')) as sessions_count from act where distinct_id <> '' group by app_id, distinct_id) a left join known k using (app_id, distinct_id)),
wf as (select app_id, workflow_id, name, distinct_id, environment_id, started_at, last_event_at, case when finished_at is not null then 'finished' when failed_at is not null then 'failed' else 'active' end as status, coalesce(finished_at, failed_at) as ended_at from (
  select app_id, session_id || ':' || workflow_name as workflow_id, workflow_name as name, arg_max_null(distinct_id, (occurred_at, id)) as distinct_id, arg_max_null(environment_id, (occurred_at, id)) as environment_id, min(occurred_at) as started_at, max(occurred_at) as last_event_at,
  max(occurred_at) filter (regexp_matches(name, '_(closed|completed)$')) as finished_at, max(occurred_at) filter (regexp_matches(name, '_failed$')) as failed_at from ev where workflow_name is not null group by app_id, session_id, workflow_name)),
mc as (select id, app_id, app_id || coalesce(' ' || name, '') as monitor_id, occurred_at as checked_at, coalesce(http_status between 200 and 399, false) as up, http_status as status_code, duration_ms as response_time_ms from tx where op = 'http')
"""


def query(sql: str | None = None, cte: bool = True):
    """Register a query under its function's name, with its SQL over the views' CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (_CTE + sql) if cte else sql
        return f

    return add


def _env(spark: SparkSession, d: str) -> DataFrame:
    return views.environments(spark, d)


# ---- predicates (2.2, 2.3)

def _search(spark: SparkSession, d: str, resource: Resource, text: str, scope: Scope = ALL) -> DataFrame:
    source = {Resource.EVENTS: views.events, Resource.OCCURRENCES: views.occurrences, Resource.TRANSACTIONS: views.transactions, Resource.SESSIONS: views.sessions, Resource.ISSUES: views.issues}[resource]
    occ = views.occurrences(spark, d) if resource is Resource.ISSUES else None
    days = 365 if resource is Resource.ISSUES else 30
    return search.rows(source(spark, d), resource, parse(text), NOW, days, scope, _env(spark, d), occ)[0]


_EV = f"select id, name, app_id from ev where occurred_at >= {_S} and (name is null or name <> '$screen')"
_ER = f"select id, message from er where occurred_at >= {_S}"
_TX = f"select id, name, duration_ms from tx where occurred_at >= {_S}"


def _predicate(name: str, resource: Resource, text: str, base: str, where: str) -> None:
    cols = base.split("from")[0].removeprefix("select ").strip().split(", ")

    def f(spark: SparkSession, d: str) -> DataFrame:
        return _search(spark, d, resource, text).select(*cols)

    f.__name__ = name
    f.__doc__ = f"{resource.name.lower()}: {text}"
    query(f"{base} and {where}")(f)


for _args in [
    ("filter_eq", Resource.EVENTS, "name:coupon_viewed", _EV, "name = 'coupon_viewed'"),
    ("filter_not_null_safe", Resource.TRANSACTIONS, "!http.method:GET", _TX, "http_method is distinct from 'GET'"),
    ("filter_in", Resource.TRANSACTIONS, "op:[navigation,screen_load]", _TX, "op in ('navigation', 'screen_load')"),
    ("filter_like", Resource.EVENTS, "name:coupon*", _EV, "name ilike 'coupon%'"),
    ("filter_contains_literal", Resource.EVENTS, "name:~_", _EV, "name ilike '%\\_%' escape '\\'"),
    ("filter_range", Resource.TRANSACTIONS, "duration:[1s..2s]", _TX, "duration_ms between 1000 and 2000"),
    ("filter_complement", Resource.TRANSACTIONS, "!http.status:>=500 !duration:<100", _TX, "http_status < 500 and duration_ms >= 100"),
    ("filter_has", Resource.TRANSACTIONS, "has:http.status", _TX, "http_status is not null"),
    ("filter_json_path", Resource.EVENTS, "has:properties.step", _EV, "json_exists(properties, '$.step')"),
    ("filter_json_string", Resource.EVENTS, "properties.step:2", _EV, "json_type(properties, '$.step') = 'VARCHAR' and json_extract_string(properties, '$.step') = '2'"),
    ("filter_json_equal", Resource.EVENTS, "properties.plan:[free,pro]", _EV, "json_type(properties, '$.plan') = 'VARCHAR' and json_extract_string(properties, '$.plan') in ('free', 'pro')"),
    ("filter_json_like", Resource.EVENTS, "properties.cart_value:9*", _EV, "json_extract_string(properties, '$.cart_value') ilike '9%'"),
    ("filter_json_not", Resource.EVENTS, "!has:properties.step", _EV, "not coalesce(json_exists(properties, '$.step'), false)"),
    ("filter_tag", Resource.EVENTS, "tag.tier:team", _EV, "tags['tier'] = 'team'"),
    ("filter_tag_not", Resource.EVENTS, "!tag.tier:team", _EV, "tags['tier'] is distinct from 'team'"),
    ("filter_tag_any", Resource.EVENTS, "tag:~pro", _EV, "len(list_filter(map_values(tags), lambda x: x ilike '%pro%')) > 0"),
    ("filter_tag_has", Resource.EVENTS, "has:tag.env", _EV, "list_contains(map_keys(tags), 'env')"),
    ("filter_environment", Resource.EVENTS, "environment:staging", _EV, "environment_id in (select id from app_environments where env_name = 'staging')"),
    ("filter_environment_unknown", Resource.EVENTS, "environment:nowhere", _EV, "false"),
    ("filter_environment_not", Resource.EVENTS, "!environment:staging", _EV, "coalesce(environment_id not in (select id from app_environments where env_name = 'staging'), true)"),
    ("filter_handled", Resource.OCCURRENCES, "is:unhandled", _ER, "handled = false"),
    ("filter_handled_not", Resource.OCCURRENCES, "!handled:true", _ER, "handled is distinct from true"),
    ("filter_stack", Resource.OCCURRENCES, "stack.function:merge", _ER, "len(list_filter(stacktrace, lambda f: f.function = 'merge')) > 0"),
    ("filter_text", Resource.OCCURRENCES, '"timed out"', _ER, "(message ilike '%timed out%' or exception_type ilike '%timed out%' or exception_value ilike '%timed out%')"),
    ("filter_text_events", Resource.EVENTS, "cart", _EV, "(coalesce(name ilike '%cart%', false) or coalesce(distinct_id ilike '%cart%', false) or coalesce(properties ilike '%cart%', false) or coalesce(cast(to_json(tags) as varchar) ilike '%cart%', false))"),
    ("filter_release", Resource.OCCURRENCES, "release:~2.1 !level:[error,fatal]", _ER, "release ilike '%2.1%' and (level is null or level not in ('error', 'fatal'))"),
    ("filter_message", Resource.OCCURRENCES, "message:*timed* OR session:~a", _ER, "(message ilike '%timed%' or session_id ilike '%a%')"),
    ("filter_text_not", Resource.OCCURRENCES, '!"timed out"', _ER, "not (coalesce(message ilike '%timed out%', false) or coalesce(exception_type ilike '%timed out%', false) or coalesce(exception_value ilike '%timed out%', false))"),
    ("filter_workflow", Resource.EVENTS, "workflow:cart", _EV, "workflow_name = 'cart'"),
    ("filter_workflow_not", Resource.EVENTS, "!workflow:cart", _EV, "workflow_name is distinct from 'cart'"),
    ("filter_nested", Resource.TRANSACTIONS, "(op:http !(http.method:GET OR http.status:<500)) OR name:/cart", _TX, "((op = 'http' and http_method is distinct from 'GET' and http_status >= 500) or name = '/cart')"),
    ("filter_time", Resource.ISSUES, "firstSeen:<-2mo", "select id, title from issues where last_seen >= timestamptz '2022-01-16 00:00:00+00'", "first_seen < timestamptz '2022-11-16 00:00:00+00'"),
    ("filter_session_duration", Resource.SESSIONS, "duration:>5m errorsCount:>=1", f"select session_id, app_id from se where last_event_at >= {_S}", "duration_ms > 300000 and errors_count >= 1"),
]:
    _predicate(*_args)

_ISSUES = "select id, title from issues where last_seen >= timestamptz '2022-01-16 00:00:00+00'"
for _args in [
    ("issue_by_occurrence_semi", Resource.ISSUES, "distinctId:worker-644c1b", _ISSUES, "exists (select 1 from er where er.issue_id = issues.id and er.app_id = issues.app_id and er.distinct_id = 'worker-644c1b' and occurred_at >= timestamptz '2022-01-16 00:00:00+00')"),
    ("issue_not_occurrence_anti", Resource.ISSUES, "!distinctId:worker-644c1b", _ISSUES, "not exists (select 1 from er where er.issue_id = issues.id and er.app_id = issues.app_id and er.distinct_id = 'worker-644c1b' and occurred_at >= timestamptz '2022-01-16 00:00:00+00')"),
    ("issue_by_tag", Resource.ISSUES, "tag.tier:team is:unresolved", _ISSUES, "status = 'unresolved' and exists (select 1 from er where er.issue_id = issues.id and er.app_id = issues.app_id and er.tags['tier'] = 'team')"),
    ("issue_text", Resource.ISSUES, "mailer", _ISSUES, "(title ilike '%mailer%' or type ilike '%mailer%' or culprit ilike '%mailer%' or exists (select 1 from er where er.issue_id = issues.id and er.app_id = issues.app_id and occurred_at >= timestamptz '2022-12-17 00:00:00+00' and (extra ilike '%mailer%' or cast(to_json(tags) as varchar) ilike '%mailer%')))"),
]:
    _predicate(*_args)
SQL["issue_text"] = SQL["issue_text"].replace("issues where last_seen >= timestamptz '2022-01-16 00:00:00+00'", f"issues where last_seen >= {_S}")


# ---- lists and paging (2.4)

def _paged(df: DataFrame, resource: Resource, text: str, sort: str, days: int, size: int, pages: int) -> DataFrame:
    """The first pages of a list one after another, each from the cursor of the one before, as (page, *row)."""
    out, cursor = None, None
    for i in range(pages):
        s = search.listing(df, resource, parse(text), NOW, sort, size, cursor, days=days)
        part = s.data.withColumn("page", F.lit(i))
        out = part if out is None else out.unionByName(part)
        cursor = s.envelope()["next_cursor"]
        if cursor is None:
            break
    return out


@query("select app_id, distinct_id, events_count, sessions_count from pe where last_seen >= timestamptz '2022-01-16 00:00:00+00' and distinct_id ilike 'usr%' order by events_count desc, distinct_id desc, app_id desc limit 50")
def persons_search(spark, d):
    return search.listing(views.persons(spark, d), Resource.PERSONS, parse("distinctId:usr*"), NOW, "events_count", 50, days=365).data.select("app_id", "distinct_id", "events_count", "sessions_count")


@query(cte=False, sql="select app_id, device_key, family, browser from devices where last_seen >= timestamptz '2022-12-17 00:00:00+00' and os_name ilike '%o%' and family is not null order by browser nulls last, device_key, app_id limit 50")
def devices_search(spark, d):
    return search.listing(views.device_list(spark, d), Resource.DEVICES, parse("os.name:~o has:device.family"), NOW, "-browser", 50).data.select("app_id", "device_key", "family", "browser")


@query(f"select least(count(*), 10000) as total, count(*) > 10000 as total_is_capped from pe where last_seen >= {_S}")
def persons_count(spark, d):
    return search.listing(views.persons(spark, d), Resource.PERSONS, parse(""), NOW).count


@query(cte=False, sql="select cast((row_number() over (order by browser desc nulls last, device_key desc, app_id desc) - 1) // 100 as int) as page, app_id, device_key, browser from devices where last_seen >= timestamptz '2022-01-16 00:00:00+00' qualify page < 8")
def devices_pages(spark, d):
    """Eight pages of a hundred by a key that is often null, each from the cursor of the one before."""
    rows = views.devices(spark, d).withColumns({"sessions_count": F.lit(0), "distinct_id": F.lit(None).cast("string")})
    return _paged(rows, Resource.DEVICES, "", "browser", 365, 100, 8).select("page", "app_id", "device_key", "browser")

@query(f"select id, name, occurred_at from ev where occurred_at >= {_S} and (name is null or name <> '$screen') order by name desc nulls last, id desc limit 50")
def events_page_sorted(spark, d):
    return search.listing(views.events(spark, d), Resource.EVENTS, parse(""), NOW, "name", 50).data.select("id", "name", "occurred_at")


@query(f"select id, name, occurred_at from ev where occurred_at >= {_S} and (name is null or name <> '$screen') and occurred_at < timestamptz '2023-01-09 00:00:00+00' order by occurred_at desc, id desc limit 50")
def events_keyset_page(spark, d):
    c = paging.Cursor("occurred_at", dt.datetime(2023, 1, 9, tzinfo=dt.timezone.utc), "0").encode()
    return search.listing(views.events(spark, d), Resource.EVENTS, parse(""), NOW, None, 50, c).data.select("id", "name", "occurred_at")


@query(f"select id, name, duration_ms from tx where occurred_at >= {_S} order by duration_ms desc, id desc limit 50 offset 100")
def transactions_offset_page(spark, d):
    found, _ = search.rows(views.transactions(spark, d), Resource.TRANSACTIONS, parse(""), NOW)
    return paging.page(found, paging.Sort("duration_ms"), 50, offset=100).select("id", "name", "duration_ms")


@query(f"select least(count(*), 10000) as total, count(*) > 10000 as total_is_capped from tx where occurred_at >= {_S}")
def count_capped(spark, d):
    return search.listing(views.transactions(spark, d), Resource.TRANSACTIONS, parse(""), NOW).count


@query(f"select id, times_seen, last_seen from issues where last_seen >= {_S} and status = 'unresolved' and level in ('error', 'fatal') order by times_seen, id limit 50")
def issues_list(spark, d):
    return search.listing(views.issues(spark, d), Resource.ISSUES, parse("is:unresolved level:[error,fatal]"), NOW, "-times_seen", occurrences=views.occurrences(spark, d)).data.select("id", "times_seen", "last_seen")


@query(f"select id, issue_id, message from er where occurred_at >= {_S} and level = 'fatal' order by occurred_at desc, id desc limit 50")
def occurrences_list(spark, d):
    return search.listing(views.occurrences(spark, d), Resource.OCCURRENCES, parse("level:fatal"), NOW).data.select("id", "issue_id", "message")


@query(f"select app_id, session_id, events_count from se where last_event_at >= {_S} order by events_count desc, session_id desc, app_id desc limit 50")
def sessions_list(spark, d):
    return search.listing(views.sessions(spark, d), Resource.SESSIONS, parse(""), NOW, "events_count").data.select("app_id", "session_id", "events_count")


_HOT_SESSION = "(select app_id, session_id from se order by events_count + errors_count desc, session_id desc, app_id limit 1)"


@query(f"select kind, id, \"at\", what from (select 'event' as kind, id, occurred_at as \"at\", name as what from ev semi join {_HOT_SESSION} h using (app_id, session_id) union all select 'error', id, occurred_at, message from er0 semi join {_HOT_SESSION} h using (app_id, session_id) union all select 'transaction', id, occurred_at, name from tx semi join {_HOT_SESSION} h using (app_id, session_id))")
def session_timeline(spark, d):
    """The timeline of the busiest session."""
    s = views.sessions(spark, d).orderBy(F.desc(F.col("events_count") + F.col("errors_count")), F.desc("session_id"), "app_id").first()
    return entities.session_timeline(views.events(spark, d), views.bare_occurrences(spark, d), views.transactions(spark, d), s["app_id"], s["session_id"])


@query("select key, count(*) as n from (select unnest(map_keys(tags)) as key from er0 where tags is not null) group by key")
def tag_keys(spark, d):
    rows = views.bare_occurrences(spark, d)
    return entities.tag_keys(rows)


# ---- series and totals (2.5)

@query(f"select name, count(*) as n from ev where occurred_at >= {_S} group by name order by n desc, name nulls last limit 20")
def top_events(spark, d):
    return series.top_events(views.events(spark, d), SINCE, 20)


@query(f"select {_DAY} as day, count(*) as n from ev where occurred_at >= {_S} group by 1")
def event_series(spark, d):
    return series.daily(views.events(spark, d), SINCE)


@query(f"select {_DAY} as day, count(*) as n from er0 where occurred_at >= {_S} and environment_id is null group by 1")
def error_series(spark, d):
    return series.daily(views.bare_occurrences(spark, d), SINCE, Scope(env=Env("unattributed")))


@query(f"select issue_id, {_DAY} as day, count(*) as n from er where occurred_at >= {_S} and issue_id is not null group by 1, 2")
def issue_occurrence_series(spark, d):
    """For every issue at once."""
    rows = series.since(views.occurrences(spark, d).filter("issue_id is not null"), SINCE)
    return rows.groupBy("issue_id", F.to_date("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_STAGING = "environment_id in (select id from app_environments where env_name = 'staging')"
_TOTALS = f"""select (select count(*) from ev where occurred_at >= {_S}) as events, (select count(*) from er0 where occurred_at >= {_S}) as errors, (select count(*) from se where last_event_at >= {_S}) as sessions,
 (select count(*) from se where last_event_at >= {_S} and unhandled_errors_count > 0) as crashed_sessions, (select count(*) from pe where last_seen >= {_S}) as users, (select count(*) from pe where first_seen >= {_S}) as new_users,
 (select count(*) = 0 or count(handled) > 0 from er0 where occurred_at >= {_S}) as has_crash_signal"""


def _totals(spark, d, scope=ALL):
    return series.overview_totals(views.events(spark, d), views.bare_occurrences(spark, d), views.sessions(spark, d), views.persons(spark, d), SINCE, scope)


@query(_TOTALS)
def overview_totals(spark, d):
    return _totals(spark, d)


@query(f"""select (select count(*) from ev where occurred_at >= {_S} and {_STAGING}) as events, (select count(*) from er0 where occurred_at >= {_S} and {_STAGING}) as errors, (select count(*) from se where last_event_at >= {_S} and {_STAGING}) as sessions,
 (select count(*) from se where last_event_at >= {_S} and unhandled_errors_count > 0 and {_STAGING}) as crashed_sessions, (select count(*) from pe where last_seen >= {_S} and (app_id, distinct_id) in (select * from m)) as users, (select count(*) from pe where first_seen >= {_S} and (app_id, distinct_id) in (select * from m)) as new_users,
 (select count(*) = 0 or count(handled) > 0 from er0 where occurred_at >= {_S} and {_STAGING}) as has_crash_signal
 from (select 1)""".replace("(select * from m)", f"(select (app_id, distinct_id) from ev where occurred_at >= {_S} and {_STAGING} and distinct_id <> '' union select (app_id, distinct_id) from er0 where occurred_at >= {_S} and {_STAGING} and distinct_id <> '' union select (app_id, distinct_id) from se where last_event_at >= {_S} and {_STAGING} and distinct_id <> '')"))
def overview_totals_scoped(spark, d):
    ids = [r[0] for r in _env(spark, d).filter("env_name = 'staging'").select("id").collect()]
    return _totals(spark, d, Scope(env=Env.subset(ids)))


@query(f"select case when events + errors = 0 then 0.0 else errors / (events + errors) end as error_rate, case when sessions > 0 and has_crash_signal then 1 - crashed_sessions / sessions end as crash_free from ({_TOTALS})")
def crash_free(spark, d):
    return series.overview_rates(_totals(spark, d))


_ENV_STATS = """select issue_id, i.app_id, coalesce(s.title, i.title) as title, coalesce(s.culprit, i.culprit) as culprit, i.status, coalesce(s.level, i.level) as level, coalesce(s.exception_type, i.type) as type, s.times_seen, s.users_seen, s.first_seen, s.last_seen from
 (select issue_id, count(*) as times_seen, count(distinct nullif(distinct_id, '')) as users_seen, min(occurred_at) as first_seen, max(occurred_at) as last_seen, arg_max_null(level, (occurred_at, er.id)) as level, arg_max_null(exception_type, (occurred_at, er.id)) as exception_type,
  arg_max_null(coalesce(nullif(concat_ws(': ', nullif(exception_type, ''), nullif(exception_value, '')), ''), message), (occurred_at, er.id)) as title, arg_max_null(culprit, (occurred_at, er.id)) as culprit
  from (select *, case when frame is null then null when frame.filename is null then coalesce(frame.function, '?') else coalesce(frame.function, '?') || ' (' || frame.filename || coalesce(':' || frame.lineno, '') || ')' end as culprit from (select *, coalesce(list_filter(stacktrace, lambda f: f.in_app)[-1], stacktrace[-1]) as frame from er)) er where issue_id is not null {} group by issue_id) s join issues i on i.id = s.issue_id"""


@query(_ENV_STATS.format(""))
def issue_env_stats(spark, d):
    return iss.env_stats(views.issues(spark, d), views.occurrences(spark, d))


@query("select count(*) as total, " + ", ".join([f"count(*) filter (status = '{s}') as {s}" for s in ("unresolved", "resolved", "ignored")] + [f"count(*) filter (level = '{x}') as {x}" for x in ("fatal", "error", "warning", "info")]) + " from issues")
def issue_stats(spark, d):
    return iss.issue_stats(views.issues(spark, d))


@query("select count(*) as total, " + ", ".join([f"count(*) filter (status = '{s}') as {s}" for s in ("unresolved", "resolved", "ignored")] + [f"count(*) filter (level = '{x}') as {x}" for x in ("fatal", "error", "warning", "info")]) + f" from ({_ENV_STATS.format('and er.environment_id is null')})")
def issue_stats_scoped(spark, d):
    return iss.issue_stats_scoped(views.issues(spark, d), views.occurrences(spark, d), Scope(env=Env("unattributed")))


@query("select id, times_seen from issues order by times_seen desc, id limit 10")
def top_issues(spark, d):
    return iss.top_issues(views.issues(spark, d), 10).select("id", "times_seen")


@query(f"select issue_id, times_seen from ({_ENV_STATS.format('and er.environment_id is null')}) where last_seen >= {_S} order by times_seen desc, issue_id limit 10")
def top_issues_scoped(spark, d):
    return iss.top_issues_scoped(views.issues(spark, d), views.occurrences(spark, d), SINCE, 10, Scope(env=Env("unattributed"))).select("issue_id", "times_seen")


@query(f"select count(*) as events, count(distinct (app_id, distinct_id)) filter (distinct_id <> '') as users, count(distinct (app_id, session_id)) filter (session_id <> '') as sessions from er where occurred_at >= {_S} and level = 'error'")
def occurrence_stats(spark, d):
    return iss.occurrence_stats(_search(spark, d, Resource.OCCURRENCES, "level:error"))


# ---- users and sessions

_SEEN = "(select app_id, distinct_id, occurred_at from ev where distinct_id <> '' union all select app_id, distinct_id, occurred_at from er0 where distinct_id <> '')"
_ACTIVE = ", ".join(f"(select count(*) from (select app_id, distinct_id, max(occurred_at) as t from {_SEEN} where occurred_at <= {_N} group by all) where t >= {_N} - interval {n} day) as {k}" for k, n in (("dau", 1), ("wau", 7), ("mau", 30)))
_SESSION_STATS = f"select count(*) as sessions, count(*) filter (unhandled_errors_count > 0) as crashed, round(avg(duration_ms), 3) as avg_session_ms, round(quantile_cont(duration_ms, 0.5), 6) as median_session_ms from se where last_event_at >= {_S}"
_USER_STATS = f"select *, case when mau = 0 then 0.0 else dau / mau end as stickiness from (select (select count(*) from pe) as total_users, (select count(*) from pe where last_seen >= {_S}) as active_in_range, (select count(*) from pe where first_seen >= {_S}) as new_in_range, {_ACTIVE}, s.avg_session_ms, s.median_session_ms from ({_SESSION_STATS}) s)"


@query(_USER_STATS)
def user_stats(spark, d):
    return users.user_stats(views.persons(spark, d), views.events(spark, d), views.bare_occurrences(spark, d), views.sessions(spark, d), SINCE, NOW)


@query(f"select stickiness from ({_USER_STATS})")
def stickiness(spark, d):
    return user_stats(spark, d).select("stickiness")


@query(f"select day, coalesce(active_users, 0) as active_users, coalesce(new_users, 0) as new_users from (select {_DAY} as day, count(distinct (app_id, distinct_id)) as active_users from {_SEEN} where occurred_at >= {_S} group by 1) full join (select cast(first_seen at time zone 'UTC' as date) as day, count(*) as new_users from pe where first_seen >= {_S} group by 1) using (day)")
def active_user_series(spark, d):
    return users.active_user_series(views.persons(spark, d), views.events(spark, d), views.bare_occurrences(spark, d), SINCE)


@query(f"""select day, coalesce(total, 0) as total, coalesce(identified, 0) as identified, coalesce(guest, 0) as guest from (select cast(unnest(generate_series(timestamp '2022-12-28', timestamp '2023-01-15', interval 1 day)) as date) as day) left join
 (select day, count(*) as total, count(*) filter (k) as identified, count(*) filter (not k) as guest from (select distinct {_DAY} as day, case when pe.identified_at is not null then 'u:' || s.distinct_id else 'a:' || s.app_id || ':' || s.distinct_id end as who, pe.identified_at is not null as k from {_SEEN} s left join pe using (app_id, distinct_id)) group by day) using (day)""")
def active_users_combined(spark, d):
    first, last = users.report_window(NOW, 19, 20)
    legs = [views.events(spark, d), views.bare_occurrences(spark, d)]
    return users.active_users_combined(legs, views.persons(spark, d), first, last)


@query(_SESSION_STATS)
def session_stats(spark, d):
    return users.session_stats(views.sessions(spark, d), SINCE)


@query(f"select cast(started_at at time zone 'UTC' as date) as day, round(avg(duration_ms), 3) as avg_ms from se where started_at >= {_S} group by 1")
def session_duration_series(spark, d):
    return users.session_duration_series(views.sessions(spark, d), SINCE)


def _histogram(rows: str) -> str:
    return f"select cast(bucket as int) as bucket, label, coalesce(n, 0) as n from (values (0, '<10s'), (1, '10-60s'), (2, '1-5m'), (3, '5-30m'), (4, '30m+')) l(bucket, label) left join (select case when s < 10 then 0 when s < 60 then 1 when s < 300 then 2 when s < 1800 then 3 else 4 end as bucket, count(*) as n from ({rows}) group by 1) using (bucket)"


@query(_histogram(f"select duration_ms / 1000 as s from se where started_at >= {_S}"))
def session_duration_histogram(spark, d):
    s = users.duration_ms(series.since(views.sessions(spark, d), SINCE, "started_at")).withColumn("s", F.col("duration_ms") / 1000)
    return users.duration_histogram(s, "s")


# ---- behaviour

_FUNNEL = "".join([f", f0 as (select app_id, distinct_id, min(occurred_at) as t from ev where name = '{STEPS[0]}' and distinct_id <> '' and occurred_at >= {_S} group by all)"] + [f", f{i} as (select app_id, distinct_id, min(occurred_at) as t from ev join f{i - 1} p using (app_id, distinct_id) where name = '{s}' and occurred_at >= p.t and occurred_at >= {_S} group by all)" for i, s in enumerate(STEPS) if i])
_FUNNEL_ROWS = " union all ".join(f"select {i} as step, '{s}' as name, (select count(*) from f{i}) as n, (select count(*) from f{i}) / (select count(*) from f0) as from_start, (select count(*) from f{i}) / (select count(*) from f{max(0, i - 1)}) as from_previous" for i, s in enumerate(STEPS))


@query(_FUNNEL + f" select step, name, n from ({_FUNNEL_ROWS})")
def funnel(spark, d):
    return funnel_ratios(spark, d).select("step", "name", "n")


@query(_FUNNEL + " " + _FUNNEL_ROWS)
def funnel_ratios(spark, d):
    return behaviour.funnel(views.events(spark, d), STEPS, SINCE)


_PATHS = f"(select *, lead(name) over w as nxt, lead(1) over w as has from (select app_id, distinct_id, occurred_at, id, name, row_number() over (partition by app_id, distinct_id order by occurred_at, id) as step from ev where occurred_at >= {_S} and distinct_id <> '') where step <= 5 window w as (partition by app_id, distinct_id order by step))"


@query(f"select step, name, count(*) as n from {_PATHS} group by all")
def journey_nodes(spark, d):
    return behaviour.journey_nodes(behaviour.paths(views.events(spark, d), SINCE))


@query(f"select step, name as source, nxt as target, count(*) as n from {_PATHS} where has = 1 group by all")
def journey_links(spark, d):
    return behaviour.journey_links(behaviour.paths(views.events(spark, d), SINCE))


_DWELL = f"(select screen, sum(least(gap, 1800000)) as dwell_ms, count(*) as gaps from (select name, screen, (epoch_us(lead(occurred_at) over (partition by app_id, session_id order by occurred_at, id)) - epoch_us(occurred_at)) / 1000 as gap from ev where occurred_at >= {_S} and session_id <> '') where name = '$screen' and screen is not null and gap > 0 group by screen)"


@query(f"select screen, round(dwell_ms, 3) as dwell_ms, gaps from {_DWELL}")
def screen_dwell(spark, d):
    return behaviour.dwell(views.events(spark, d), SINCE).select("screen", F.round("dwell_ms", 3).alias("dwell_ms"), "gaps")


@query(f"select screen, views, events, exceptions, users, round(case when views = 0 then 0 else coalesce(dwell_ms, 0) / views end, 3) as avg_dwell_ms from (select screen, count(*) filter (k = 'v') as views, count(*) filter (k = 'e') as events, count(*) filter (k = 'x') as exceptions, count(distinct (app_id, distinct_id)) filter (distinct_id <> '') as users from (select screen, app_id, distinct_id, case when name = '$screen' then 'v' else 'e' end as k from ev where occurred_at >= {_S} and screen is not null union all select screen, app_id, distinct_id, 'x' from er0 where occurred_at >= {_S} and screen is not null) group by screen) left join {_DWELL} using (screen)")
def screen_list(spark, d):
    return behaviour.screen_list(views.events(spark, d), views.bare_occurrences(spark, d), SINCE)


@query(f"select screen, family, count(*) as n, count(distinct (app_id, distinct_id)) filter (distinct_id <> '') as users from (select app_id, screen, device_key, distinct_id from ev where occurred_at >= {_S} and screen is not null union all select app_id, screen, device_key, distinct_id from er0 where occurred_at >= {_S} and screen is not null) left join devices using (app_id, device_key) group by all")
def screen_people(spark, d):
    return behaviour.screen_people(views.events(spark, d), views.bare_occurrences(spark, d), views.devices(spark, d), SINCE)


_RUNS = f"(select *, case when status = 'active' and last_event_at < {_N} - interval 30 minute then 'abandoned' else status end as s, case when status = 'finished' then (epoch_us(ended_at) - epoch_us(started_at)) / 1000 end as ms from wf)"


@query("select name, count(*) as runs, " + ", ".join(f"count(*) filter (s = '{s}') as {s}" for s in ("finished", "failed", "active", "abandoned")) + f", count(distinct (app_id, distinct_id)) filter (distinct_id <> '') as unique_users, round(quantile_cont(ms, 0.5), 6) as median_ms, round(quantile_cont(ms, 0.95), 6) as p95_ms, round(count(*) filter (s = 'finished') / count(*), 6) as completion_rate from {_RUNS} group by name")
def workflow_list(spark, d):
    return behaviour.workflow_list(views.workflows(spark, d), NOW)


@query(f"select workflow_id, app_id, s as status from {_RUNS} where s = 'abandoned'")
def workflow_runs(spark, d):
    return behaviour.workflow_runs(views.workflows(spark, d), NOW, "abandoned").select("workflow_id", "app_id", "status")


@query(_histogram(f"select ms / 1000 as s from {_RUNS} where name = 'cart' and ms is not null"))
def workflow_durations(spark, d):
    return behaviour.workflow_durations(views.workflows(spark, d), "cart")


@query("select name, count(*) as n from ev where workflow_name = 'cart' group by name order by n desc, name limit 10")
def workflow_top_events(spark, d):
    return behaviour.workflow_top_events(views.events(spark, d), "cart")


@query("select app_id, session_id, workflow_id, cast(row_number() over (partition by app_id, session_id order by started_at, workflow_id) as int) as position, started_at from (select *, left(workflow_id, length(workflow_id) - length(name) - 1) as session_id from wf)")
def workflow_spans(spark, d):
    """The runs of every session, in order."""
    return behaviour.workflow_spans(views.workflows(spark, d)).select("app_id", "session_id", "workflow_id", "position", "started_at")


@query(f"select screen, kind, cast(place as int) as place, id, occurred_at from (select *, row_number() over (partition by screen, kind order by occurred_at desc, id desc) as place from (select screen, 'event' as kind, id, occurred_at from ev where occurred_at >= {_S} and screen is not null and (name is null or name <> '$screen') union all select screen, 'exception', id, occurred_at from er0 where occurred_at >= {_S} and screen is not null)) where place <= 20")
def screen_recent(spark, d):
    """The latest events and exceptions of every screen."""
    return behaviour.screen_recent(views.events(spark, d), views.bare_occurrences(spark, d), SINCE)


# ---- latency

_FAILED = "(coalesce(status = 'error', false) or coalesce(http_status >= 500, false))"


@query("select name, op, count(*) as n, " + ", ".join(f"round(quantile_cont(duration_ms, {q}), 6) as {k}" for k, q in (("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))) + f", round(avg(duration_ms), 3) as avg_ms, round(avg(cast({_FAILED} as int)), 6) as error_rate from tx where occurred_at >= {_S} group by all")
def performance_summary(spark, d):
    return latency.performance_summary(views.transactions(spark, d), SINCE)


@query(f"select {_DAY} as day, round(quantile_cont(duration_ms, 0.5), 6) as p50, round(quantile_cont(duration_ms, 0.95), 6) as p95, count(*) as throughput from tx where occurred_at >= {_S} group by 1")
def performance_series(spark, d):
    return latency.performance_series(views.transactions(spark, d), SINCE)


# ---- entities

_ROLL = "cast(sum(is_event) as bigint) as events_count, cast(sum(is_error) as bigint) as errors_count, count(distinct nullif(session_id, '')) as sessions_count, min(occurred_at) as first_seen, max(occurred_at) as last_seen"


@query(f"select app_id, distinct_id, {_ROLL} from act where distinct_id <> '' group by all")
def persons_list(spark, d):
    return entities.list_persons(views.activity(spark, d))


@query(f"select app_id, device_key, {_ROLL}, arg_max(distinct_id, (occurred_at, id)) filter (distinct_id <> '') as last_distinct_id from act where device_key <> '' group by all")
def devices_list(spark, d):
    return entities.list_devices(views.activity(spark, d))


@query(f"select family, model, os_name, os_version, count(*) as device_count, cast(sum(events_count) as bigint) as events_count, cast(sum(errors_count) as bigint) as errors_count, cast(sum(coalesce(n, 0)) as bigint) as sessions_count, max(last_seen) as last_seen from devices left join (select app_id, device_key, count(*) as n from se where started_at >= {_S} and device_key <> '' group by all) using (app_id, device_key) group by all")
def device_groups(spark, d):
    return entities.device_groups(views.devices(spark, d), views.sessions(spark, d), SINCE)


@query(f"select app_id, device_key, environment_id, {_ROLL} from act where device_key <> '' group by all")
def rollup_backfill(spark, d):
    return entities.env_rollup(views.activity(spark, d), "device_key")


@query(f"select app_id, distinct_id, environment_id, {_ROLL} from act where distinct_id <> '' group by all")
def person_env_rollup(spark, d):
    return entities.env_rollup(views.activity(spark, d), "distinct_id")


@query("select app_id, session_id, started_at, last_event_at, environment_id, distinct_id, device_key, events_count, errors_count, unhandled_errors_count from se")
def sessions_rollup(spark, d):
    """Built anew, not read."""
    return views.session_rollup(spark, d)


@query("select issue_id, abs(n - users) <= greatest(1, 0.05 * n) as close from (select 1 as issue_id, 1 as n, 1 as users) where false union all select issue_id, true from (select issue_id from er where issue_id is not null and distinct_id <> '' group by issue_id)")
def affected_users(spark, d):
    """The sketch against the exact count: within 5 % (over six standard errors), or 1."""
    o = views.occurrences(spark, d)
    exact = o.filter("issue_id is not null and distinct_id <> ''").groupBy("issue_id").agg(F.count_distinct("distinct_id").alias("n"))
    return entities.affected_users(o).join(exact, "issue_id").select("issue_id", (F.abs(F.col("n") - F.col("users")) <= F.greatest(F.lit(1.0), 0.05 * F.col("n"))).alias("close"))


# ---- tiers and identities (2.8, 2.9)

_WM = dt.datetime(2023, 1, 9, 12, tzinfo=dt.timezone.utc)
_RESTORED = ((dt.datetime(2023, 1, 4, tzinfo=dt.timezone.utc), dt.datetime(2023, 1, 5, tzinfo=dt.timezone.utc)),)


def _tiered(spark, d):
    """Events with their cold part written to Parquet and read again through the planner."""
    ev = views.events(spark, d).select("id", "app_id", "environment_id", "name", "distinct_id", "occurred_at")
    path = shared_dir(spark, "cold")
    from lumenq.plans.tier import plan

    p = plan(_WM, SINCE, NOW, _RESTORED)
    tier.export(ev, path, p["cold"])
    hot = tier._within(ev, p["hot"])
    return tier.across(spark, hot, path, _WM, SINCE, NOW, _RESTORED)


_IN = f"occurred_at >= {_S} and occurred_at < {_N}"


@query(f"select {_DAY} as day, count(*) as n from ev where {_IN} group by 1")
def tier_counts_by_day(spark, d):
    return tier.counts_by_day(_tiered(spark, d))


@query(f"select {_DAY} as day, count(distinct (app_id, distinct_id)) as users from ev where {_IN} and distinct_id <> '' group by 1")
def tier_distinct_by_day(spark, d):
    return tier.distinct_by_day(_tiered(spark, d))


_ALIASES = "(select app_id, alias_id, min(distinct_id) as distinct_id from (select app_id, 'anon_' || right(distinct_id, 12) as alias_id, distinct_id from pe where starts_with(distinct_id, 'usr-')) group by all)"


def _aliases(spark, d):
    """Aliases of the test: a guest id that ends like a user's."""
    p = views.persons(spark, d).filter("distinct_id like 'usr-%'")
    return p.groupBy("app_id", F.concat(F.lit("anon_"), F.right("distinct_id", F.lit(12))).alias("alias_id")).agg(F.min("distinct_id").alias("distinct_id"))


@query(f"select {_DAY} as day, count(distinct (ev.app_id, coalesce(a.distinct_id, ev.distinct_id))) as users from ev left join {_ALIASES} a on a.app_id = ev.app_id and a.alias_id = ev.distinct_id where {_IN} and ev.distinct_id <> '' group by 1")
def alias_resolved_distinct(spark, d):
    rows = series.since(views.events(spark, d), SINCE).filter(F.col("occurred_at") < F.lit(NOW)).filter("distinct_id <> ''")
    return tier.distinct_by_day(rows, identity.without_chains(_aliases(spark, d)))


@query(f"select app_id, distinct_id, cast(sum(events_count) as bigint) as events_count, min(first_seen) as first_seen, max(last_seen) as last_seen from (select pe.app_id, coalesce(a.distinct_id, pe.distinct_id) as distinct_id, events_count, first_seen, last_seen from pe left join {_ALIASES} a on a.app_id = pe.app_id and a.alias_id = pe.distinct_id) group by all")
def identity_rollup_move(spark, d):
    p = views.persons(spark, d).select("app_id", "distinct_id", "events_count", "first_seen", "last_seen")
    return identity.move_rollup(p, _aliases(spark, d), ["events_count"])


@query(" union all ".join(f"select '{k}' as source, t.app_id, coalesce(a.distinct_id, t.distinct_id) as distinct_id, count(*) as n from {t} t left join {_ALIASES} a on a.app_id = t.app_id and a.alias_id = t.distinct_id group by all" for k, t in (("events", "ev"), ("errors", "er0"), ("transactions", "tx"), ("sessions", "se"), ("persons", "pe"))))
def identity_rewrite(spark, d):
    """Rows by person in each of five tables after their ids are rewritten."""
    frames = {"events": views.events, "errors": views.bare_occurrences, "transactions": views.transactions, "sessions": views.sessions, "persons": views.persons}
    done = identity.rewrite({k: f(spark, d).select("app_id", "distinct_id") for k, f in frames.items()}, _aliases(spark, d))
    out = None
    for k, f in done.items():
        part = f.groupBy("app_id", "distinct_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("source"), "app_id", "distinct_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("select distinct_id, count(*) as n, min(occurred_at) as first, max(occurred_at) as last from ev where distinct_id in (select distinct_id from er0) group by all")
def counts_by_key(spark, d):
    return tier.counts_by_key(views.events(spark, d), "distinct_id", views.bare_occurrences(spark, d))


@query(f"select app_id, distinct_id, cast(count(*) filter (occurred_at >= timestamptz '2023-01-05 00:00:00+00' or environment_id is not null) as bigint) as n from ev where distinct_id <> '' group by all having n > 0")
def purge_recompute(spark, d):
    """Unattributed events before a day are purged; the touched persons' counts are rebuilt."""
    ev = views.events(spark, d).filter("distinct_id <> ''").select("app_id", "distinct_id", "environment_id", "occurred_at")
    roll = ev.groupBy("app_id", "distinct_id").agg(F.count(F.lit(1)).alias("n"))
    kept, gone = purge.split(ev, F.col("environment_id").isNull() & (F.col("occurred_at") < F.lit(dt.datetime(2023, 1, 5, tzinfo=dt.timezone.utc))))
    return purge.recompute(roll, kept, purge.touched(gone, ["distinct_id"]), "distinct_id", {"n": F.count(F.lit(1))})


@query("select o_orderdate::date as day, o_orderstatus as store, count(*) as installs, count(*) filter (o_totalprice < 50000) as uninstalls from orders group by all", cte=False)
def store_metrics_range(spark, d):
    return views.store_metrics(spark, d)


# ---- monitors and alerts (2.5, 2.11)

@query("select monitor_id, " + ", ".join(f"round(100 * avg(cast(up as int)) filter (checked_at > {_N} - interval {n} day and checked_at <= {_N}), 6) as uptime_{n}d" for n in (1, 7, 30)) + " from mc group by monitor_id")
def uptime_pct(spark, d):
    return monitors.uptime(views.monitor_checks(spark, d), NOW)


@query(f"select monitor_id, x.up as up, x.status_code as status_code, x.response_time_ms as response_time_ms, x.checked_at as last_checked_at, uptime_1d from (select monitor_id, arg_max(struct_pack(up := up, status_code := status_code, response_time_ms := response_time_ms, checked_at := checked_at), (checked_at, id)) as x, round(100 * avg(cast(up as int)) filter (checked_at > {_N} - interval 1 day and checked_at <= {_N}), 6) as uptime_1d from mc group by monitor_id)")
def monitor_list(spark, d):
    return monitors.monitor_list(views.monitor_checks(spark, d), NOW)


@query(f"select monitor_id, checked_at, response_time_ms, up from mc where checked_at >= {_N} - interval 72 hour")
def latency_series(spark, d):
    return monitors.latency_points(views.monitor_checks(spark, d), NOW, 72)


_FOLD = """, c1 as (select *, case when up is distinct from lag(up) over (partition by monitor_id order by checked_at, id) then 1 else 0 end as new from mc),
c2 as (select *, sum(new) over (partition by monitor_id order by checked_at, id rows unbounded preceding) as run from c1), c3 as (select *, row_number() over (partition by monitor_id, run order by checked_at, id) as k from c2),
c4 as (select monitor_id, checked_at, id, case when up then 'up' else 'down' end as target from c3 where (up and k = 2) or (not up and k = 3)),
tr as (select monitor_id, checked_at as "at", source, target, not (source = 'unknown' and target = 'up') as fires from (select *, coalesce(lag(target) over (partition by monitor_id order by checked_at, id), 'unknown') as source from c4) where source <> target)"""


@query(_FOLD + " select * from tr")
def monitor_fold(spark, d):
    return monitors.transitions(views.monitor_checks(spark, d))


@query(_FOLD + " select monitor_id, \"at\" as started_at, ended_at from (select *, lead(\"at\") over (partition by monitor_id order by \"at\") as ended_at from tr) where target = 'down'")
def monitor_incidents(spark, d):
    return monitors.incidents(monitors.transitions(views.monitor_checks(spark, d)))


_AT = dt.datetime(2023, 1, 10, tzinfo=dt.timezone.utc)
_ATS = "timestamptz '2023-01-10 00:00:00+00'"


@query(f"select app_id, count(*) as value, count(*) >= 5 as fires from er0 where occurred_at >= {_ATS} - interval 1 day and occurred_at <= {_ATS} and level = 'error' group by app_id")
def alert_threshold(spark, d):
    return alerts.threshold(views.bare_occurrences(spark, d), _AT, alerts.Condition("error_threshold", 5, 86_400, level="error"))


@query(f"select *, previous > 0 and current >= previous * 1.5 and current >= 3 as fires from (select app_id, count(*) filter (occurred_at >= {_ATS} - interval 1 day) as current, count(*) filter (occurred_at < {_ATS} - interval 1 day) as previous from er0 where occurred_at >= {_ATS} - interval 2 day and occurred_at <= {_ATS} group by app_id)")
def alert_spike(spark, d):
    return alerts.spike(views.bare_occurrences(spark, d), _AT, alerts.Condition("error_spike", 3, 86_400, factor=1.5))


_NOW_ISSUES = """, cur as (select i.id, i.app_id, i.status, i.level, i.first_seen, greatest(i.last_seen, s.last) as last_seen from issues i left join (select issue_id, max(occurred_at) as last from er where issue_id is not null group by 1) s on s.issue_id = i.id) """
_OCC_IN = "exists (select 1 from er where er.issue_id = cur.id and er.occurred_at > cur.first_seen - interval 1 hour and er.occurred_at <= cur.last_seen)"


@query(_NOW_ISSUES + f"select id, first_seen from cur where first_seen > {_N} - interval 365 day and first_seen <= {_N} and {_OCC_IN} order by first_seen desc, id limit 20")
def alert_new_issues(spark, d):
    return alerts.new_issues(views.current_issues(spark, d), views.occurrences(spark, d), NOW - dt.timedelta(days=365), NOW).select("id", "first_seen")


@query(_NOW_ISSUES + f"select id, last_seen from cur where status in ('resolved', 'ignored') and last_seen > {_N} - interval 30 day and last_seen <= {_N} and {_OCC_IN} order by last_seen desc, id limit 20")
def alert_regression(spark, d):
    return alerts.regressions(views.current_issues(spark, d), views.occurrences(spark, d), SINCE, NOW).select("id", "last_seen")


@query(f"select app_id, round(quantile_cont(duration_ms, 0.95), 6) as value, round(quantile_cont(duration_ms, 0.95), 6) >= 1000 as fires from tx where occurred_at >= {_ATS} - interval 1 day and occurred_at <= {_ATS} group by app_id")
def latency_alert(spark, d):
    return alerts.latency(views.transactions(spark, d), _AT, alerts.Condition.parse("perf_degradation", {"window_seconds": 86_400}))


# ---- what SQL can't express, or only at length

def _mask(c: str) -> str:
    """Words that are UUIDs or addresses, and digits. Neighbouring words share a space, hence each pattern twice."""
    h = "[0-9a-fA-F]"
    for pattern, name in ((f"[\"'',.]*{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}[\"'',.]*", "uuid"), (f"0x{h}+", "addr")):
        for _ in range(2):
            c = f"regexp_replace({c}, '(^|\\s){pattern}(\\s|$)', '\\1{{{name}}}\\2', 'g')"
    return f"regexp_replace({c}, '[0-9]+', '{{n}}', 'g')"


def _message(c: str) -> str:
    return f"trim(regexp_replace({_mask(f'lower({c})')}, '\\s+', ' ', 'g'))"


_BASE = "trim(regexp_extract(regexp_extract(f.filename, '^([^?#]*)', 1), '([^/\\\\]*)$', 1))"
_KEPT = f"list_filter(string_split({_BASE}, '.'), lambda p: not (regexp_full_match(p, '[0-9a-fA-F]{{6,40}}') and regexp_matches(p, '[0-9]')))"
_FILE = _mask(f"case when len(string_split({_BASE}, '.')) >= 3 and len({_KEPT}) >= 2 then array_to_string({_KEPT}, '.') else {_BASE} end")
_FRAME = f"case when coalesce(f.module, '') <> '' and coalesce(f.function, '') <> '' then {_mask('trim(f.module)')} || '::' || {_mask('trim(f.function)')} when coalesce(f.function, '') <> '' then {_mask('trim(f.function)')} when f.filename is not null then {_FILE} else '?' end"
_OWN = "list_filter(exception.stacktrace, lambda f: coalesce(f.in_app, false))"
_POOL = f"case when len({_OWN}) > 0 then {_OWN} else exception.stacktrace end"
_TYPE = _mask("trim(split_part(exception.type, '(', 1))")
_FINGERPRINT = f"""select delivery_id, sha256(case when len(fingerprint) > 0 then array_to_string(list_transform(fingerprint, lambda x: coalesce(x, '')), chr(10)) when exception.type is null then 'message' || chr(10) || {_message("coalesce(message, 'unknown')")}
 when len(exception.stacktrace) > 0 then {_TYPE} || chr(10) || array_to_string(list_transform(list_reverse({_POOL})[1:5], lambda f: {_FRAME}), chr(10)) else {_TYPE} || chr(10) || {_message("coalesce(exception.value, message, '')")} end) as fingerprint,
 case when frame is null then '' when frame.filename is null then coalesce(frame.function, '?') else coalesce(frame.function, '?') || ' (' || frame.filename || coalesce(':' || frame.lineno, '') || ')' end as culprit
 from (select *, coalesce({_OWN}[-1], exception.stacktrace[-1]) as frame from node where type = 'error')"""


@query(_FINGERPRINT, cte=False)
def fingerprint(spark, d):
    """Fingerprint and culprit of every error row of node."""
    n = table(spark, d, "node").filter("type = 'error'")
    e = F.col("exception")
    return n.select("delivery_id", fp.fingerprint(F.col("fingerprint"), e["type"], e["value"], e["stacktrace"], F.col("message")).alias("fingerprint"), fp.culprit(e["stacktrace"]).alias("culprit"))


@query()
def pii_scan(spark, d):
    return pii.findings(pii.scan(table(spark, d, "js"), "delivery_id", ["properties"], tracked=["step"]))


def _ingested(spark, d, files: int, per_trigger: int, every: int = 1) -> tuple:
    """All node rows as envelopes through the streaming sink: (sink, its last batch)."""
    from lumenq.streaming import ingest

    base = shared_dir(spark, "ingest")
    item = F.struct("type", "event_id", "name", "distinct_id", "session_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "release", "level", "message", "fingerprint", "exception", "tags")
    envelopes = table(spark, d, "node").groupBy("app_id", "environment_id", "batch_id").agg(F.date_format(F.min("sent_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("sent_at"), F.collect_list(item).alias("items"))
    envelopes.select(F.to_json(F.struct("app_id", "environment_id", "sent_at", "items")).alias("value")).repartition(files, "value").write.text(base + "/in")
    q = ingest.start(ingest.read_envelopes(spark, base + "/in", per_trigger), base + "/out", base + "/checkpoint", available_now=True, every=every)
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    while not tier.exists(spark, f"{base}/out/rows/batch={last}"):
        last -= 1
    return ingest.Sink(base + "/out", every=every), last


@query()
def stream_ingest(spark, d):
    """Node as envelopes, through the streaming sink, to its issues."""
    sink, last = _ingested(spark, d, 1, 1)
    return sink.state(spark, "issues", last).select("app_id", "fingerprint", "title", "first_seen", "last_seen", "times_seen")


@query("select unnest(['issues', 'issue_users', 'sessions', 'devices', 'person_envs', 'device_envs', 'workflows']) as rollup, true as equal", cte=False)
def stream_rollups(spark, d):
    """Each rollup folded over several batches, against a recount of all the rows the stream wrote."""
    from lumenq.streaming import ingest

    sink, last = _ingested(spark, d, 6, 2, every=2)
    rows = spark.read.option("basePath", sink.path + "/rows").parquet(sink.path + "/rows")
    started = ingest.session_starts(rows)
    out = None
    for name, r in ingest.ROLLUPS.items():
        # where a session counts depends on what its first batch knew, so the sessions of persons aren't compared
        numbers = ("times_seen", "events_count", "errors_count", "unhandled_errors_count", "first_seen", "last_seen", "started_at", "last_event_at")
        have, want = sink.state(spark, name, last), r.fold(r.delta(rows, started))
        value = (lambda f: [F.hll_sketch_estimate("users").alias("users")]) if name == "issue_users" else (lambda f: [F.col(c) for c in f.columns if c in numbers])
        a, b = (f.select(*r.key, *value(f)) for f in (have, want))
        diff = a.exceptAll(b).unionByName(b.exceptAll(a))
        part = diff.agg((F.count(F.lit(1)) == 0).alias("equal")).select(F.lit(name).alias("rollup"), "equal")
        out = part if out is None else out.unionByName(part)
    return out
