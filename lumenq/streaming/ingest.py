"""Structured Streaming ingest: envelopes as JSON lines, to items, to enriched and fingerprinted rows, to rollups.

Each micro-batch writes its rows and its contribution to every rollup below folders of its own number; every so many
batches the contributions are folded into a snapshot. Delivery is at least once, so all is keyed by the batch number: a
batch that is run again writes the same folders again, and nothing is counted twice. Lines that can't be read go to the
dead letters; lines whose processing failed for a cause that may pass are parked and tried again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenq.functions import fingerprint as fp
from lumenq.functions.ids import uuid_key
from lumenq.sources.tier import exists
from lumenq.streaming import retry

FRAME = "struct<function:string,module:string,filename:string,abs_path:string,lineno:int,colno:int,in_app:boolean>"
ITEM = f"""struct<type:string,event_id:string,name:string,distinct_id:string,session_id:string,timestamp:timestamp,release:string,
level:string,message:string,fingerprint:array<string>,exception:struct<type:string,value:string,mechanism:struct<type:string,handled:boolean>,stacktrace:array<{FRAME}>>,
workflow_id:string,workflow_name:string,op:string,duration_ms:double,status:string,http_status:int,url:string,properties:string,tags:map<string,string>>"""
ENVELOPE = f"struct<app_id:string,environment_id:string,sent_at:timestamp,user_agent:string,context:string,items:array<{ITEM}>>".replace("\n", "")
ISSUE_KEY = ["app_id", "fingerprint"]


def read_envelopes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of lines (value) from text files dropped in a folder; any source with a string column ``value`` will do."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def decode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, dead): one row per item; lines without app or items, or that aren't JSON, are dead with a reason."""
    parsed = lines.select("value", F.from_json("value", ENVELOPE).alias("e"))
    good = F.col("e.app_id").isNotNull() & (F.size("e.items") > 0)
    reason = F.when(F.try_parse_json("value").isNull(), "not json").when(F.col("e.app_id").isNull(), "no app").otherwise("no items")
    dead = parsed.filter(~F.coalesce(good, F.lit(False))).select("value", reason.alias("reason"))
    items = parsed.filter(good).select("e.app_id", "e.environment_id", "e.sent_at", "e.user_agent", "e.context", F.explode("e.items").alias("i"))
    return items.select("app_id", "environment_id", "sent_at", "user_agent", "context", "i.*"), dead


def enrich(items: DataFrame) -> DataFrame:
    """Items with occurred_at (sent_at where the client has no time), device fields, fingerprint, culprit and title."""
    device = fp.device_fields(F.col("context"), F.col("user_agent"))
    ex = F.col("exception")
    out = items.withColumn("occurred_at", F.coalesce("timestamp", "sent_at")).withColumns(device)
    is_error = F.col("type") == "error"
    title = F.coalesce(F.concat_ws(": ", ex["type"], ex["value"]), F.col("message"))
    return out.withColumns({
        "fingerprint": F.when(is_error, fp.fingerprint(F.col("fingerprint"), ex["type"], ex["value"], ex["stacktrace"], F.col("message"))),
        "culprit": F.when(is_error, fp.culprit(ex["stacktrace"])), "title": F.when(is_error, title), "handled": ex["mechanism"]["handled"],
    })


def once(items: DataFrame) -> DataFrame:
    """One copy of each message of a batch, the first by time and then by content, so that a batch that is run again
    keeps the same one; items without a usable id are all kept."""
    ident = uuid_key("event_id")
    whole = F.struct(*[F.col(f"`{c}`") for c in items.columns])
    rows = items.select(ident.alias("_id"), whole.alias("_row"))
    rows = rows.withColumn("_o", F.struct(F.col("_row.occurred_at").isNull(), F.col("_row.occurred_at"), F.xxhash64(F.to_json("_row"))))
    kept = rows.filter("_id is not null").groupBy("_id").agg(F.min_by("_row", "_o").alias("_row")).select("_row")
    return kept.unionByName(rows.filter("_id is null").select("_row")).select("_row.*")


# ---- rollups: what a batch contributes, and how contributions are folded
#
# Contributions carry the number of their batch in ``_n``; a snapshot carries that of its last batch. A fold takes any
# number of them at once: it adds counts, extends bounds, and lets columns of the first or of the last batch win.

def newest(c: str) -> Column:
    """Of the last batch that has one."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)


def oldest(c: str) -> Column:
    """Of the first batch that has one."""
    return F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("_n"))).alias(c)


def _bounds(first: str, last: str) -> list[Column]:
    return [F.min(first).alias(first), F.max(last).alias(last)]


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


_EVENT, _ERROR = "type = 'event'", "type = 'error'"
_COUNTS = ("events_count", "errors_count")
_DEVICE = ("family", "model", "os_name", "os_version", "arch", "browser")


def _counted() -> list[Column]:
    return [F.count_if(F.expr(_EVENT)).alias("events_count"), F.count_if(F.expr(_ERROR)).alias("errors_count")]


def _seen() -> list[Column]:
    return [F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen")]


def _latest(c: str, name: str | None = None) -> Column:
    """Within a batch, of the latest item that has one."""
    return F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("occurred_at"))).alias(name or c)


def _earliest(c: str, name: str | None = None) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("occurred_at"))).alias(name or c)


def issue_delta(errors: DataFrame) -> DataFrame:
    last = F.struct("occurred_at", "title", "culprit", "level")
    return errors.groupBy(*ISSUE_KEY).agg(F.max_by(F.struct("title", "culprit", "level"), last).alias("x"), *_seen(), F.count(F.lit(1)).alias("times_seen")).select(*ISSUE_KEY, "x.title", "x.culprit", "x.level", "first_seen", "last_seen", "times_seen")


def fold_issues(*parts: DataFrame) -> DataFrame:
    """Counts added, first and last seen extended; title, culprit and level of the newest, but a masked ``****`` stays."""
    sticky = lambda c: F.when(F.bool_or(F.col(c) == "****"), "****").otherwise(F.max_by(c, "_n")).alias(c)
    return numbered(*parts).groupBy(*ISSUE_KEY).agg(sticky("title"), sticky("culprit"), sticky("level"), *_bounds("first_seen", "last_seen"), *_sums("times_seen"))


def user_delta(errors: DataFrame) -> DataFrame:
    """Sketches of the users of each issue."""
    return errors.filter("distinct_id <> ''").groupBy(*ISSUE_KEY).agg(F.hll_sketch_agg("distinct_id", 14).alias("users"))


def session_delta(items: DataFrame) -> DataFrame:
    rows = items.filter("session_id <> ''")
    return rows.groupBy("app_id", "session_id").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_event_at"), *_counted(), F.count_if(F.expr(_ERROR) & ~F.col("handled")).alias("unhandled_errors_count"), *map(_latest, ("device_key", "release", "distinct_id", "environment_id")))


def fold_sessions(*parts: DataFrame) -> DataFrame:
    """Bounds extended, counts added; device, release, person and environment of the newest that has one."""
    return numbered(*parts).groupBy("app_id", "session_id").agg(*_bounds("started_at", "last_event_at"), *_sums(*_COUNTS, "unhandled_errors_count"), *map(newest, ("device_key", "release", "distinct_id", "environment_id")))


def device_delta(items: DataFrame) -> DataFrame:
    return items.filter("device_key <> ''").groupBy("app_id", "device_key").agg(*_seen(), *_counted(), *map(_latest, _DEVICE), _latest("distinct_id", "last_distinct_id"))


def session_starts(items: DataFrame) -> DataFrame:
    """Per session whom and which device it counts for, each with the environment of the same item, the latest that has one."""
    at = lambda c: F.max_by(F.struct(c, "environment_id"), F.when(F.col(c) != "", F.col("occurred_at"))).alias(f"of_{c}")
    return items.filter("session_id <> ''").groupBy("app_id", "session_id").agg(at("distinct_id"), at("device_key"))


def env_delta(items: DataFrame, key: str, started: DataFrame) -> DataFrame:
    """Per (app, key, environment), null being an environment of its own. ``started``: ``session_starts`` of sessions
    that no earlier batch had; each counts once, by what its first batch knew of it."""
    rows = items.filter(F.col(key) != "").groupBy("app_id", key, "environment_id").agg(*_seen(), *_counted(), F.lit(0).cast("bigint").alias("sessions_count"))
    new = started.select("app_id", f"of_{key}.*").filter(F.col(key) != "").groupBy("app_id", key, "environment_id").agg(F.count(F.lit(1)).alias("sessions_count"))
    both = rows.unionByName(new, allowMissingColumns=True)
    n = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_COUNTS, "sessions_count")]
    return both.groupBy("app_id", key, "environment_id").agg(*_bounds("first_seen", "last_seen"), *n)


WORKFLOW_KEY = ["app_id", "workflow_id"]
_FIRST = ("name", "session_id", "distinct_id", "device_key", "release", "environment_id")


def workflow_delta(items: DataFrame) -> DataFrame:
    """Runs, with the first end or cancellation among a batch's lifecycle events; ties in time go by name, then reason."""
    rows = items.filter("workflow_id <> ''").select("*", F.col("workflow_name").alias("_flow"))
    ends = F.expr(_EVENT) & F.col("name").isin("$workflow_end", "$workflow_cancel")
    cancelled = F.col("name") == "$workflow_cancel"
    reason = F.when(cancelled, F.get_json_object("properties", "$.reason"))
    end = F.struct(F.when(cancelled, "cancelled").otherwise("completed").alias("status"), F.col("occurred_at").alias("ended_at"), reason.alias("cancel_reason"))
    first = F.min_by(end, F.when(ends, F.struct("occurred_at", "name", reason)))
    return rows.groupBy(*WORKFLOW_KEY).agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_event_at"), *_counted(), _earliest("_flow", "name"), *map(_earliest, _FIRST[1:]), first.alias("ending"))


def fold_workflows(*parts: DataFrame) -> DataFrame:
    """The first batch's identity and the first ending win: a run that has ended isn't opened or ended again."""
    return numbered(*parts).groupBy(*WORKFLOW_KEY).agg(*_bounds("started_at", "last_event_at"), *_sums(*_COUNTS), *map(oldest, _FIRST), F.min_by("ending", F.when(F.col("ending").isNotNull(), F.col("_n"))).alias("ending"))


def runs(workflows: DataFrame) -> DataFrame:
    """Folded workflows with status (active, completed or cancelled), ended_at and cancel_reason."""
    return workflows.select("*", F.coalesce("ending.status", F.lit("active")).alias("status"), "ending.ended_at", "ending.cancel_reason").drop("ending")


def numbered(*parts: DataFrame) -> DataFrame:
    """``parts`` in the order of their batches, with ``_n``."""
    out = None
    for i, p in enumerate(parts):
        p = p if "_n" in p.columns else p.withColumn("_n", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


@dataclass(frozen=True)
class Rollup:
    """delta: a batch's contribution, of (its rows, the sessions that are new). fold: of all contributions so far."""

    key: list[str]
    delta: Callable[[DataFrame, DataFrame], DataFrame]
    fold: Callable[..., DataFrame]


def _adding(key: list[str], aggs: Callable[[], list[Column]]) -> Callable[..., DataFrame]:
    return lambda *parts: numbered(*parts).groupBy(*key).agg(*aggs())


def _seen_sums(*sums: str) -> list[Column]:
    return [*_bounds("first_seen", "last_seen"), *_sums(*sums)]


_ENV = ("app_id", "environment_id")
ROLLUPS = {
    "issues": Rollup(ISSUE_KEY, lambda rows, _: issue_delta(rows.filter(_ERROR)), fold_issues),
    "issue_users": Rollup(ISSUE_KEY, lambda rows, _: user_delta(rows.filter(_ERROR)), _adding(ISSUE_KEY, lambda: [F.hll_union_agg("users").alias("users")])),
    "sessions": Rollup(["app_id", "session_id"], lambda rows, _: session_delta(rows), fold_sessions),
    "devices": Rollup(["app_id", "device_key"], lambda rows, _: device_delta(rows), _adding(["app_id", "device_key"], lambda: [*_seen_sums(*_COUNTS), *map(newest, (*_DEVICE, "last_distinct_id"))])),
    "person_envs": Rollup([*_ENV, "distinct_id"], lambda rows, new: env_delta(rows, "distinct_id", new), _adding([*_ENV, "distinct_id"], lambda: _seen_sums(*_COUNTS, "sessions_count"))),
    "device_envs": Rollup([*_ENV, "device_key"], lambda rows, new: env_delta(rows, "device_key", new), _adding([*_ENV, "device_key"], lambda: _seen_sums(*_COUNTS, "sessions_count"))),
    "workflows": Rollup(WORKFLOW_KEY, lambda rows, _: workflow_delta(rows), fold_workflows),
}


class Sink:
    """``foreachBatch`` target below ``path``: rows, dead letters, parked lines, and the rollups.

    - deltas/<rollup>/batch=n: what batch n contributes, of its own keys only.
    - <rollup>/batch=n: the snapshot of all contributions up to n, written by every ``every``-th batch from the snapshot
      before and the contributions since. So a batch costs what it holds, and the whole state is rewritten once in
      ``every``; the last two snapshots are kept. ``state`` reads the one and adds the other.

    Running batch n again overwrites its own folders with the same contents. A batch whose predecessors are missing is
    an error, not a fresh start. Messages that an earlier batch had are left out: their 16-byte ids are kept per batch,
    of the last ``remember`` batches (None: of all). Lines that fail for a cause that may pass are parked, and due ones
    join a later batch; after the last attempt they are dead letters.
    """

    def __init__(self, path: str, remember: int | None = None, every: int = 1, clock: Callable[[], float] = time.time):
        self.path, self.remember, self.every, self.clock = path.rstrip("/"), remember, every, clock

    def _unseen(self, items: DataFrame, n: int) -> DataFrame:
        spark, at = items.sparkSession, f"{self.path}/seen"
        items = items.withColumn("_id", uuid_key("event_id"))
        if n and exists(spark, at):
            low = 0 if self.remember is None else n - self.remember
            seen = spark.read.parquet(at).filter((F.col("batch") < n) & (F.col("batch") >= low)).select("_id")
            items = items.join(seen, "_id", "left_anti")
        return items.select([c for c in items.columns if c != "_id"] + ["_id"])

    def _base(self, n: int) -> int:
        """The last batch before ``n`` that wrote a snapshot; -1 if none was due."""
        return n // self.every * self.every - 1

    def _parts(self, spark: SparkSession, name: str, base: int, n: int, schema: StructType | None = None) -> list[DataFrame]:
        """The snapshot of batch ``base`` and the contributions since, up to batch ``n``, each with its number;
        ``schema``: that of contributions, where it is known."""
        out = [self._read(spark, f"{name}/batch={base}", base)] if base >= 0 else []
        return out + [self._read(spark, f"deltas/{name}/batch={k}", k, schema) for k in range(base + 1, n + 1)]

    def _read(self, spark: SparkSession, folder: str, n: int, schema: StructType | None = None) -> DataFrame:
        at = f"{self.path}/{folder}"
        if not exists(spark, at):
            raise RuntimeError(f"{at} is missing: the sink can't go on without the batches before")
        return (spark.read.schema(schema) if schema else spark.read).parquet(at).withColumn("_n", F.lit(n))

    def state(self, spark: SparkSession, name: str, n: int) -> DataFrame:
        """A rollup as of batch ``n``."""
        return ROLLUPS[name].fold(*self._parts(spark, name, self._base(n + 1), n))

    def __call__(self, lines: DataFrame, n: int) -> None:
        spark, now = lines.sparkSession, int(self.clock() * 1e6)
        parked = "value string, attempts int, due_us bigint, reason string"
        before = spark.read.schema(parked).parquet(f"{self.path}/parked/batch={n - 1}") if n and exists(spark, f"{self.path}/parked/batch={n - 1}") else spark.createDataFrame([], parked)
        due, later, over = retry.due(before, now)
        work = lines.select("value", F.lit(0).alias("attempts")).unionByName(due.select("value", "attempts"))
        over = over.select("value", F.lit("attempts").alias("reason"))
        try:
            self.process(work, over, n)
        except Exception as e:
            if not retry.transient(e):
                raise
            later = later.unionByName(retry.park(work, str(e)[:500], now))
            self.process(work.limit(0), over, n)
        later.write.mode("overwrite").parquet(f"{self.path}/parked/batch={n}")

    def process(self, lines: DataFrame, over: DataFrame, n: int) -> None:
        spark = lines.sparkSession
        items, dead = decode(lines)
        rows = self._unseen(once(enrich(items)), n).persist()
        try:
            # sorted by app, so that row groups prune on it without a folder for each app
            rows.drop("_id").withColumn("day", F.to_date("occurred_at")).hint("rebalance", "type", "day").sortWithinPartitions("type", "day", "app_id").write.mode("overwrite").partitionBy("type", "day").parquet(f"{self.path}/rows/batch={n}")
            started = session_starts(rows)
            for p in self._parts(spark, "sessions", self._base(n), n - 1):
                started = started.join(p.select("app_id", "session_id"), ["app_id", "session_id"], "left_anti")

            def roll(name: str) -> None:
                r = ROLLUPS[name]
                delta = r.delta(rows, started)
                delta.write.mode("overwrite").parquet(f"{self.path}/deltas/{name}/batch={n}")
                if (n + 1) % self.every == 0:
                    before = self._parts(spark, name, self._base(n), n - 1, delta.schema)
                    r.fold(*before, delta.withColumn("_n", F.lit(n))).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={n}")

            # the rows are cached by now; the jobs don't depend on each other and share the cluster
            jobs = [lambda: dead.unionByName(over).write.mode("overwrite").json(f"{self.path}/dead/batch={n}"), lambda: rows.filter("_id is not null").select("_id").write.mode("overwrite").parquet(f"{self.path}/seen/batch={n}")]
            with ThreadPoolExecutor(len(ROLLUPS) + len(jobs)) as pool:
                for job in [*map(pool.submit, jobs), *(pool.submit(roll, name) for name in ROLLUPS)]:
                    job.result()
            if (n + 1) % self.every == 0:
                self._forget(spark, n - 2 * self.every)
        finally:
            rows.unpersist()

    def _forget(self, spark: SparkSession, n: int) -> None:
        """Remove the snapshot of batch ``n`` and the contributions that it and those before it hold."""
        if n < 0:
            return
        fs = spark._jvm.org.apache.hadoop.fs
        for name in ROLLUPS:
            for folder in [f"{name}/batch={n}", *(f"deltas/{name}/batch={k}" for k in range(n - self.every + 1, n + 1))]:
                p = fs.Path(f"{self.path}/{folder}")
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def start(lines: DataFrame, path: str, checkpoint: str, available_now: bool = False, remember: int | None = None, every: int = 1) -> StreamingQuery:
    w = lines.writeStream.foreachBatch(Sink(path, remember, every)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(items: DataFrame, lateness: str = "24 hours", width: str = "1 hour") -> DataFrame:
    """Streaming counts per app and event-time window with a watermark, as an incremental alternative to the views."""
    return items.withWatermark("occurred_at", lateness).groupBy("app_id", F.window("occurred_at", width)).agg(F.count(F.lit(1)).alias("n"))
