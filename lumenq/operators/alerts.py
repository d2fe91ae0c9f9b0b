"""Alert rules: conditions, their evaluation over issues, events, errors and transactions, probes and throttling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenq.operators.latency import METRICS, metric
from lumenq.scope import ALL, Scope

KINDS = ("monitor_down", "monitor_up", "issue_new", "issue_regression", "error_threshold", "error_spike", "event_threshold", "perf_degradation")
COMPARE = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__, "eq": Column.__eq__}
FEW = 20
HOUR = dt.timedelta(hours=1)


@dataclass(frozen=True)
class Condition:
    """A rule's condition, with the defaults and bounds of its kind."""

    kind: str
    threshold: float = 1.0
    window_s: int = 300
    comparator: str = "gte"
    factor: float = 3.0
    metric: str = "p95"
    level: str | None = None
    name: str | None = None

    @staticmethod
    def parse(kind: str, raw: dict) -> "Condition":
        if kind not in KINDS:
            raise ValueError(kind)
        perf = kind == "perf_degradation"
        number = lambda k, d: float(raw[k]) if isinstance(raw.get(k), (int, float)) and not isinstance(raw.get(k), bool) else d
        name = raw.get("metric")
        return Condition(
            kind, number("threshold", 1000.0 if perf else 1.0), int(min(86_400, max(60, number("window_seconds", 900 if perf else 300)))), raw["comparator"] if raw.get("comparator") in COMPARE else "gte",
            max(1.0, number("spike_factor", 3.0)), name if name in METRICS or name in ("max", "avg") else "p95", raw.get("level"), raw.get("name"),
        )


def _window(rows: DataFrame, now: dt.datetime, c: Condition, back: int = 0) -> DataFrame:
    w = dt.timedelta(seconds=c.window_s)
    return rows.filter((F.col("occurred_at") >= F.lit(now - w * (back + 1))) & (F.col("occurred_at") <= F.lit(now - w * back)))


def threshold(rows: DataFrame, now: dt.datetime, c: Condition, scope: Scope = ALL) -> DataFrame:
    """(app_id, value, fires): rows of the last window, compared; of errors by level, of events by name."""
    r = _window(scope.apply(rows), now, c)
    for col, v in (("level", c.level), ("name", c.name)):
        r = r if v is None else r.filter(F.col(col) == v)
    n = r.groupBy("app_id").agg(F.count(F.lit(1)).alias("value"))
    return n.withColumn("fires", COMPARE[c.comparator](F.col("value"), c.threshold))


def spike(rows: DataFrame, now: dt.datetime, c: Condition, scope: Scope = ALL, personal: bool = False) -> DataFrame:
    """(app_id, current, previous, fires): this window against the one before, in one pass.

    A personal spike may come from nothing; an organisation's needs a previous count.
    """
    w = dt.timedelta(seconds=c.window_s)
    t = F.col("occurred_at")
    r = scope.apply(rows).filter((t >= F.lit(now - 2 * w)) & (t <= F.lit(now)))
    n = r.groupBy("app_id").agg(F.count_if(t >= F.lit(now - w)).alias("current"), F.count_if(t < F.lit(now - w)).alias("previous"))
    cur, prev = F.col("current"), F.col("previous")
    fires = (cur >= c.threshold) & ((prev == 0) | (cur >= prev * c.factor)) if personal else (prev > 0) & (cur >= prev * c.factor) & (cur >= max(c.threshold, 1.0))
    return n.withColumn("fires", fires)


def latency(tx: DataFrame, now: dt.datetime, c: Condition, scope: Scope = ALL) -> DataFrame:
    r = _window(scope.apply(tx), now, c)
    r = r if c.name is None else r.filter(F.col("name") == c.name)
    n = r.groupBy("app_id").agg(F.round(metric(c.metric), 6).alias("value"))
    return n.withColumn("fires", COMPARE[c.comparator](F.col("value"), c.threshold))


def new_issues(issues: DataFrame, occurrences: DataFrame, start: dt.datetime, end: dt.datetime, scope: Scope = ALL, level: str | None = None, limit: int = FEW) -> DataFrame:
    """Issues first seen in (start, end] that occurred in scope between an hour before they were first seen and last."""
    i = issues.filter((F.col("first_seen") > F.lit(start)) & (F.col("first_seen") <= F.lit(end)))
    i = i if level is None else i.filter(F.col("level") == level)
    return _occurred(i, occurrences.filter(F.col("occurred_at") > F.lit(start - HOUR)), scope).orderBy(F.desc("first_seen"), "id").limit(limit)


def regressions(issues: DataFrame, occurrences: DataFrame, start: dt.datetime, end: dt.datetime, scope: Scope = ALL, limit: int = FEW) -> DataFrame:
    """Resolved or ignored issues seen again in (start, end]."""
    i = issues.filter(F.col("status").isin("resolved", "ignored") & (F.col("last_seen") > F.lit(start)) & (F.col("last_seen") <= F.lit(end)))
    return _occurred(i, occurrences.filter(F.col("occurred_at") <= F.lit(end)), scope).orderBy(F.desc("last_seen"), "id").limit(limit)


def _occurred(issues: DataFrame, occurrences: DataFrame, scope: Scope) -> DataFrame:
    """``issues`` that have an occurrence in their own range of time.

    Occurrences meet the few issues in question in an inner join, whose skewed side may be split, and leave it as
    one row per issue and task; the issues are then matched with these.
    """
    o = scope.apply(occurrences).filter("issue_id is not null").select("issue_id", F.col("occurred_at").alias("_t"))
    i = issues.select(F.col("id").alias("_id"), (F.col("first_seen") - F.expr("interval 1 hour")).alias("_from"), F.col("last_seen").alias("_to"))
    seen = o.join(i, (F.col("issue_id") == F.col("_id")) & (F.col("_t") > F.col("_from")) & (F.col("_t") <= F.col("_to"))).select(F.col("_id").alias("id")).distinct()
    return issues.join(seen, "id", "left_semi")


def evaluate(kind: str, c: Condition, now: dt.datetime, last_eval: dt.datetime | None, scope: Scope = ALL, *, issues: DataFrame | None = None, errors: DataFrame | None = None, events: DataFrame | None = None, transactions: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """One rule of any of the eight kinds: (app_id, subject, value), a row for each app, issue or monitor that fires.

    Kinds that watch for something to happen (new and returned issues, monitors that went down or up) take what lies
    in (last_eval, now], reaching back no further than the rule's window, and ``FEW`` of it at most; without a
    last evaluation, the window. The others compare the window [now - w, now] as a whole.
    """
    since = now - dt.timedelta(seconds=c.window_s)
    start = since if last_eval is None else max(since, last_eval)
    if kind in ("issue_new", "issue_regression"):
        found = new_issues(issues, errors, start, now, scope, c.level) if kind == "issue_new" else regressions(issues, errors, start, now, scope)
        return found.select("app_id", F.col("id").alias("subject"), F.col("times_seen").cast("double").alias("value"))
    if kind in ("monitor_down", "monitor_up"):
        t = F.col("at")
        hit = changes.filter((F.col("target") == kind.removeprefix("monitor_")) & F.col("fires") & (t > F.lit(start)) & (t <= F.lit(now)))
        return hit.orderBy(F.desc("at"), "monitor_id").limit(FEW).select(F.lit(None).cast("string").alias("app_id"), F.col("monitor_id").alias("subject"), F.lit(1.0).alias("value"))
    if kind == "error_threshold":
        found = threshold(errors, now, c, scope)
    elif kind == "event_threshold":
        found = threshold(events, now, c, scope)
    elif kind == "error_spike":
        found = spike(errors, now, c, scope).withColumnRenamed("current", "value")
    elif kind == "perf_degradation":
        found = latency(transactions, now, c, scope)
    else:
        raise ValueError(kind)
    return found.filter("fires").select("app_id", F.col("app_id").alias("subject"), F.col("value").cast("double").alias("value"))


def quiet(minute: int, start: int, end: int) -> bool:
    """Whether a minute of the day is in [start, end), which may wrap past midnight; of no width it never is."""
    if start == end:
        return False
    return start <= minute < end if start < end else minute >= start or minute < end


def local_minute(at: Column, zone: Column | str) -> Column:
    local = F.from_utc_timestamp(at, zone)
    return F.hour(local) * 60 + F.minute(local)


def quiet_column(at: Column, zone: str, start: int, end: int) -> Column:
    m = local_minute(at, zone)
    if start == end:
        return F.lit(False)
    return (m >= start) & (m < end) if start < end else (m >= start) | (m < end)


@dataclass
class Probe:
    org: str
    kind: str
    condition: tuple
    envs: tuple[str, ...]
    apps: set[str] = default(default_factory=set)


def coalesce(wanted: Iterable[tuple[str, str, Condition, tuple[str, ...], str]]) -> list[Probe]:
    """One probe for all subscriptions (org, kind, condition, environments, app) whose condition is the same but for a
    spike factor within a quarter; it asks for the union of their apps."""
    found: dict[tuple, Probe] = {}
    for org, kind, c, envs, app in wanted:
        quantised = (c.threshold, c.window_s, c.comparator, round(c.factor * 4) / 4, c.metric, c.level, c.name)
        key = (org, kind, quantised, tuple(sorted(envs)))
        found.setdefault(key, Probe(org, kind, quantised, key[3])).apps.add(app)
    return list(found.values())


def throttle(alerts: DataFrame, seconds: int, key: str = "dedup_key", at: str = "at") -> DataFrame:
    """Alerts that pass: of each key the first, then the first after each pause of ``seconds`` since one that passed.

    Which pass depends on those before: keys are sorted by time and scanned once, with one time of memory; of a key's
    times only those that pass are looked at one by one. A null time never passes.
    """
    step = seconds * 1_000_000

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: object = scan
        last = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).dictionary_encode()
            codes, us = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(us)]
            passed: list[int] = []
            for a, z in zip(cuts, cuts[1:]):
                k = b.column(0)[a].as_py()
                i = a if k != held else a + int(np.searchsorted(us[a:z], last + step))
                held = k
                while i < z:
                    passed.append(i)
                    last = int(us[i])
                    i = a + int(np.searchsorted(us[a:z], last + step))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(passed, pa.int64())), b.column(1).take(pa.array(passed, pa.int64()))], names=["k", "us"])

    rows = alerts.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(at)).alias("us")).filter("us is not null")
    out = rows.repartition("k").sortWithinPartitions("k", "us").mapInArrow(scan, "k string, us bigint")
    return out.select(F.col("k").alias(key), F.timestamp_micros("us").alias(at))


def digest(pending: DataFrame, reach: DataFrame) -> DataFrame:
    """(user_id, n, items): one digest per user of the due notifications still within the user's reach."""
    due = pending.join(reach, ["user_id", "app_id"], "left_semi")
    return due.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("message")).alias("items"))
