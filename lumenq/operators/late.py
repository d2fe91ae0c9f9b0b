"""Problem 2: late and out-of-order events, as lambda views.

The *fast layer* increments a provisional count per period with what arrives before the period ends. A scheduled
*batch* recomputes every open period from the full log and replaces the provisional value. A period is *frozen* at
its cut-off; what arrives afterwards is reported and changes nothing. ``LambdaViews`` keeps log, increments and batch
results as tables; ``replay`` feeds a delivered table through them in slices of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenq.functions.ids import packed_key, packed_order, packed_us
from lumenq.session import shared_dir

HOUR = 3_600_000_000
DAY = 24 * HOUR
AHEAD = 0  # the lane of periods that no day of arrival bounds
NONE = -1  # and that of messages that count nowhere


@dataclass(frozen=True)
class Lateness:
    """Lengths in microseconds. ``schedule`` is the pause between batch runs; runs fall on its multiples."""

    period: int = HOUR
    cutoff: int = 24 * HOUR
    schedule: int = HOUR

    def start(self, us: Column) -> Column:
        return us - F.pmod(us, F.lit(self.period))

    def end(self, us: Column) -> Column:
        return self.start(us) + F.lit(self.period)

    def layer(self, us: Column, received_us: Column) -> Column:
        """The layer that counts a message: fast, batch or (too late for either) frozen."""
        end = self.end(us)
        return F.when(received_us < end, "fast").when(received_us < end + self.cutoff, "batch").otherwise("frozen")

    def run(self, us: Column, received_us: Column) -> Column:
        """The time of the batch run that first sees a message; never after its period's cut-off."""
        nxt = received_us - F.pmod(received_us, F.lit(self.schedule)) + F.lit(self.schedule)
        return F.least(nxt, self.end(us) + self.cutoff)


def first_arrivals(df: DataFrame, ident: Column, group: list[str], time: str = "timestamp", received: str = "received_at", key: str = "delivery_id", named: bool = False) -> DataFrame:
    """One row per message: (key, time_us, received_us, *group) of its first arrival by (received, key); ``named`` adds ident.

    ``ident`` is binary of 9 bytes or more; a row without is its own message. Rows with a null ``time`` are left out before copies are compared;
    a message whose copies all lack a time is in no period. A null ``received`` counts as arriving last of all.
    """
    own = F.unhex(F.hex(F.col(key)))  # 8 bytes at most: no identifier of 16 bytes is equal to it
    rows = df.filter(F.col(time).isNotNull()).select(F.coalesce(ident, own).alias("ident"), packed_order(F.unix_micros(F.col(received)), F.col(key)).alias("o"), F.unix_micros(F.col(time)).alias("time_us"), *group)
    by = rows.groupBy("ident")
    # without group columns all buffers are fixed-width and this is a hash aggregate
    once = by.agg(F.min("o").alias("o"), F.min_by(F.struct("time_us", *group), "o").alias("v")).select("ident", "o", "v.*") if group else by.agg(F.min("o").alias("o"), F.min_by("time_us", "o").alias("time_us"))
    return once.select(packed_key(F.col("o")).alias(key), "time_us", F.coalesce(packed_us(F.col("o")), F.lit(1 << 62)).alias("received_us"), *group, *["ident"] * named)


def classify(messages: DataFrame, policy: Lateness = Lateness()) -> DataFrame:
    """``messages`` with period_us, layer and run_us."""
    t, r = F.col("time_us"), F.col("received_us")
    return messages.select("*", policy.start(t).alias("period_us"), policy.layer(t, r).alias("layer"), policy.run(t, r).alias("run_us"))


def late_messages(messages: DataFrame, policy: Lateness = Lateness(), key: str = "delivery_id") -> DataFrame:
    """In one pass, to hold the views against: (key, outcome) of messages that corrected a period or came after its freeze."""
    late = classify(messages, policy).filter("layer <> 'fast'")
    return late.select(key, F.when(F.col("layer") == "batch", "corrected").otherwise("dropped").alias("outcome"))


def final_view(messages: DataFrame, group: list[str], policy: Lateness = Lateness()) -> DataFrame:
    """As ``LambdaViews.summary``, in one pass: per group and period the provisional count, the frozen one, corrections, drops and the last run that changed it."""
    c = classify(messages, policy)
    n = lambda *layers: F.count_if(F.col("layer").isin(*layers))
    return c.groupBy(*group, "period_us").agg(n("fast").alias("provisional"), n("fast", "batch").alias("final"), n("batch").alias("corrected"), n("frozen").alias("dropped"), F.max(F.when(F.col("layer") == "batch", F.col("run_us"))).alias("last_run_us"))


def versions(messages: DataFrame, group: list[str], policy: Lateness = Lateness()) -> DataFrame:
    """As ``LambdaViews.versions``, in one pass: each value a period's view took: one row per batch run that replaced it (run 0: provisional)."""
    c = classify(messages, policy).filter("layer <> 'frozen'").withColumn("run_us", F.when(F.col("layer") == "fast", F.lit(0)).otherwise(F.col("run_us")))
    w = Window.partitionBy(*group, "period_us").orderBy("run_us").rowsBetween(Window.unboundedPreceding, 0)
    return c.groupBy(*group, "period_us", "run_us").agg(F.count(F.lit(1)).alias("added")).withColumn("value", F.sum("added").over(w))


class LambdaViews:
    """The views as tables below ``path``, for arrivals that come batch by batch.

    ``ingest`` adds arrivals to the log and increments the fast view; ``run_batch(now)`` does all scheduled runs up to
    ``now``: it recomputes every open period from the log, replaces it and freezes those past their cut-off; ``view``
    is what the batch found, plus the increments of periods that have not ended yet.

    - log/batch=/layer=/lane=: the messages of an ingest. The lane is the day of the period, so a run opens only
      the folders of open periods; periods more than two days ahead of their message's arrival (wrong clocks) share
      a lane that every run reads, and messages too late for any run share one that none reads. Folders are therefore
      as many as days of arrival, whatever the clients' clocks say.
    - fast/batch=: increments. runs/run=/now_us=: the versions of all periods open at a run; frozen ones are never
      written again.

    A folder appears when its job is committed, so the folders are the state: a new instance on the path goes on after
    the last run and the last batch that they name.

    Ingesting a batch number again, or running again after a failure, overwrites its own folders: nothing counts twice.
    Messages with an ``ident`` that an earlier batch had are left out, so re-delivery doesn't count either. ``group`` may
    be empty; group columns are strings, null being a value of its own. No message at all gives empty views.
    """

    def __init__(self, spark: SparkSession, group: list[str], policy: Lateness = Lateness(), path: str | None = None):
        self.spark, self.group, self.policy = spark, group, policy
        self.path = path or shared_dir(spark, "lambda-views")
        done = self._runs().agg(F.max(F.struct("run", "now_us")).alias("r")).first()["r"]
        self.runs, self.last_run = done if done else (-1, None)
        top = self._log().agg(F.max("batch")).first()[0]
        self.batches = -1 if top is None else top

    def _table(self, name: str, *schema: str) -> DataFrame:
        fields = ", ".join(filter(None, schema))
        try:
            return self.spark.read.schema(fields).parquet(f"{self.path}/{name}")
        except Exception as e:  # no such folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], fields)

    def _groups(self) -> str:
        return ", ".join(f"`{g}` string" for g in self.group)

    def _log(self) -> DataFrame:
        return self._table("log", "delivery_id bigint, ident binary, time_us bigint, received_us bigint", self._groups(), "period_us bigint, run_us bigint, batch bigint, layer string, lane int")

    def _fast(self) -> DataFrame:
        return self._table("fast", self._groups(), "period_us bigint, n bigint, batch bigint")

    def _runs(self) -> DataFrame:
        return self._table("runs", self._groups(), "period_us bigint, run_us bigint, added bigint, value bigint, frozen boolean, run bigint, now_us bigint")

    def _kept(self) -> DataFrame:
        """The versions that hold: those of frozen periods, and those of the last run."""
        return self._runs().filter((F.col("run") <= self.runs) & (F.col("frozen") | (F.col("run") == self.runs)))

    def _going_on(self) -> DataFrame:
        """The increments of periods that had not ended at the last run, added up."""
        fast = self._fast() if self.last_run is None else self._fast().filter(F.col("period_us") + self.policy.period > self.last_run)
        return fast.groupBy(*self.group, "period_us").agg(F.sum("n").alias("n"))

    def ingest(self, messages: DataFrame, batch: int | None = None) -> None:
        """``messages``: first arrivals (``first_arrivals``) of what came since the last call.

        With their ``ident``, messages of other batches are left out, which takes the identifiers of the whole log;
        without it, each message is given once over all calls. ``batch`` names the call, to repeat it; the next number if not given.
        """
        n = self.batches + 1 if batch is None else batch
        if "ident" in messages.columns:
            seen = self._log().filter((F.col("batch") != n) & F.col("ident").isNotNull()).select("ident")
            messages = messages.join(seen, "ident", "left_anti")
        else:
            messages = messages.withColumn("ident", F.lit(None).cast("binary"))
        day = F.floor(F.col("period_us") / DAY).cast("int")
        far = F.col("period_us") > F.col("received_us") + 2 * DAY
        lane = F.when(F.col("layer") == "frozen", NONE).when(far, AHEAD).otherwise(day)
        rows = classify(messages, self.policy).withColumn("lane", lane)
        rows.select("delivery_id", "ident", "time_us", "received_us", *[F.col(g).cast("string").alias(g) for g in self.group], "period_us", "run_us", "layer", "lane").write.mode("overwrite").partitionBy("layer", "lane").parquet(f"{self.path}/log/batch={n}")
        new = self._log().filter((F.col("batch") == n) & (F.col("layer") == "fast"))
        new.groupBy(*self.group, "period_us").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/fast/batch={n}")
        self.batches = max(self.batches, n)

    def run_batch(self, now_us: int) -> None:
        """All scheduled runs since the last call up to ``now_us``, each period open at any of them being recomputed.

        A run that changes a period leaves a version of it: the same that the runs one by one would have left, since
        run r counts what had arrived before r.
        """
        p, n = self.policy, self.runs + 1
        t = F.col("period_us")
        rows = self._log().filter((F.col("layer") != "frozen") & (t + p.period <= now_us) & ((F.col("layer") == "fast") | (F.col("run_us") <= now_us)))
        if self.last_run is not None:
            closed = self.last_run - p.cutoff - p.period  # frozen by an earlier run
            rows = rows.filter((t > closed) & ((F.col("lane") == AHEAD) | (F.col("lane") >= closed // DAY)))
        run = F.when(F.col("layer") == "fast", F.lit(0)).otherwise(F.col("run_us"))
        w = Window.partitionBy(*self.group, "period_us").orderBy("run_us").rowsBetween(Window.unboundedPreceding, 0)
        found = rows.groupBy(*self.group, "period_us", run.alias("run_us")).agg(F.count(F.lit(1)).alias("added"))
        found.withColumn("value", F.sum("added").over(w)).withColumn("frozen", t + p.period + p.cutoff <= now_us).write.mode("overwrite").parquet(f"{self.path}/runs/run={n}/now_us={now_us}")
        self.runs, self.last_run = n, now_us

    def view(self) -> DataFrame:
        """(*group, period_us, n, frozen): the count of each period as it stands."""
        batch = self._kept().groupBy(*self.group, "period_us").agg(F.max("value").alias("n"), F.bool_or("frozen").alias("frozen"))
        return batch.unionByName(self._going_on().withColumn("frozen", F.lit(False)))

    def versions(self) -> DataFrame:
        """(*group, period_us, run_us, added, value): each value a period took; run 0 is the provisional one."""
        cols = [*self.group, "period_us", "run_us", "added", "value"]
        return self._kept().select(*cols).unionByName(self._going_on().select(*self.group, "period_us", F.lit(0).cast("bigint").alias("run_us"), F.col("n").alias("added"), F.col("n").alias("value")))

    def late(self) -> DataFrame:
        """(delivery_id, outcome): messages a run has corrected their period with, and those that came after the freeze."""
        return self._late_rows().select("delivery_id", F.when(F.col("layer") == "batch", "corrected").otherwise("dropped").alias("outcome"))

    def _late_rows(self) -> DataFrame:
        done = F.lit(False) if self.last_run is None else F.col("run_us") <= self.last_run
        return self._log().filter((F.col("layer") == "frozen") | ((F.col("layer") == "batch") & done))

    def summary(self) -> DataFrame:
        """(*group, period_us, provisional, final, corrected, dropped, last_run_us), the last run being the last that changed it."""
        by, late = [*self.group, "period_us"], F.col("layer") == "batch"
        parts = [
            self._fast().select(*by, F.col("n").alias("provisional")),
            self.view().select(*by, F.col("n").alias("final")),
            self._late_rows().select(*by, late.cast("bigint").alias("corrected"), (~late).cast("bigint").alias("dropped"), F.when(late, F.col("run_us")).alias("last_run_us")),
        ]
        rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return rows.groupBy(*by).agg(n("provisional"), n("final"), n("corrected"), n("dropped"), F.max("last_run_us").alias("last_run_us"))


def replay(messages: DataFrame, group: list[str], policy: Lateness = Lateness(), every: int = 7 * DAY) -> LambdaViews:
    """Views of a table that was delivered before, taken in by ``received_us`` in slices of ``every`` microseconds.

    ``messages``: the first arrivals of the whole table. They are put down once, in folders by slice (as many as the
    weeks of arrival), so that a slice reads what is its own; each is ingested, and followed by the runs scheduled up to its
    end. A last run freezes what is past its cut-off then.
    """
    spark = messages.sparkSession
    staged = shared_dir(spark, "arrivals")
    rows = messages.withColumn("slice", F.floor(F.col("received_us") / every))
    rows.hint("rebalance", "slice").write.partitionBy("slice").parquet(staged)
    kept = spark.read.schema(rows.schema).parquet(staged)
    views = LambdaViews(spark, group, policy)
    end = None
    for (k,) in sorted(kept.select("slice").distinct().collect()):
        views.ingest(kept.filter(F.col("slice") == k).drop("slice"))
        end = (k + 1) * every
        views.run_batch(end)
    if end is not None:
        views.run_batch(end + policy.cutoff + policy.period)
    return views
