"""The general data-processing problems against brute force, with nulls, ties, repeated rows, hot keys, empty tables."""

import datetime as dt
import random
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenq.functions.ids import is_uuid, packed_key, packed_order, packed_us, uuid_bytes, uuid_key
from lumenq.operators import dedupe, features, late, sessions, skew

T0 = dt.datetime(2023, 1, 2, tzinfo=dt.timezone.utc)
SCHEMA = "delivery_id bigint, app_id string, event_id string, distinct_id string, name string, timestamp timestamp, received_at timestamp, ident string, slot string"


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def us(seconds):
    return int((T0.timestamp() + seconds) * 1_000_000)


def rows_of(n=3000, seed=1):
    r = random.Random(seed)
    ids = [uuid.UUID(int=r.getrandbits(128)) for _ in range(n // 3)]
    out = []
    for i in range(n):
        u = ids[0] if r.random() < 0.3 else r.choice(ids)
        text = r.choice([str(u), u.hex, u.hex.upper(), f"urn:uuid:{u}", "{" + str(u) + "}", None, "", "0" * 32, "not a uuid"]) if r.random() < 0.5 else str(u)
        who = "hot" if r.random() < 0.35 else r.choice(["a", "b", "c", "", None])
        out.append((i, r.choice(["x", "y"]), text, who, r.choice(["e1", "e2", "e3", None]), at(r.choice([None, r.randrange(0, 200_000)])), at(r.randrange(0, 400_000)), "clash", "clash"))
    return out


def canonical(s):
    try:
        u = uuid.UUID(s) if s else None
    except ValueError:
        return None
    return u.bytes if u and u.int else None


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(6).cache()


def test_uuid_spellings(spark):
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    good = [u, u.upper(), u.replace("-", ""), f"urn:uuid:{u}", "{" + u + "}"]
    bad = [None, "", "x", u[:-1], f" {u} ", u + "0", "0" * 32, "00000000-0000-0000-0000-000000000000"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in good + bad], "s string").select(uuid_key("s")).collect()]
    assert [bytes(x) for x in got[: len(good)]] == [uuid.UUID(u).bytes] * len(good)
    assert got[len(good) :] == [None] * len(bad)


def test_a_trailing_line_feed_makes_no_identifier(spark):
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    rows = [(i, t, at(i)) for i, t in enumerate([u + "\n", u.replace("0", "1") + "\n", "{" + u + "}\n", "0" * 32 + "\n", u, u.upper()])]
    df = spark.createDataFrame(rows, "delivery_id bigint, event_id string, received_at timestamp")
    assert [r[0] for r in dedupe.removed_deliveries(df, uuid_bytes("event_id"), valid=is_uuid("event_id")).collect()] == [5]
    assert [r[0] for r in dedupe.removed_deliveries(df, uuid_key("event_id")).collect()] == [5]
    assert sorted(r.delivery_id for r in dedupe.keep_first(df, uuid_key("event_id")).collect()) == [0, 1, 2, 3, 4]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(10**15), 10**16)), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=30))
def test_packed_order_sorts_like_its_parts(spark, pairs):
    df = spark.createDataFrame(pairs, "t bigint, k bigint").withColumn("p", packed_order(F.col("t"), F.col("k")))
    got = [(r.t, r.k) for r in df.orderBy("p").collect()]
    assert got == sorted(pairs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    back = df.select("t", "k", packed_us(F.col("p")), packed_key(F.col("p"))).collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in back)


def brute_first(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        first.setdefault(canonical(r[2]) or ("row", r[0]), r)
    return {r[0] for r in first.values()}


def test_removed_and_kept(table):
    rows = rows_of()
    keep = brute_first(rows)
    assert {r[0] for r in dedupe.removed_deliveries(table, uuid_key("event_id")).collect()} == {r[0] for r in rows} - keep
    kept = dedupe.keep_first(table, uuid_key("event_id"))
    assert kept.columns == table.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(keep)


def test_keep_first_of_repeated_rows_and_empty(spark):
    u = str(uuid.uuid4())
    row = (1, "x", u, "a", "e", at(0), at(1), "i", "s")
    df = spark.createDataFrame([row, row, row], SCHEMA)
    assert dedupe.keep_first(df, uuid_key("event_id")).count() == 1
    empty = df.limit(0)
    assert dedupe.keep_first(empty, uuid_key("event_id")).count() == 0
    assert dedupe.removed_deliveries(empty, uuid_key("event_id")).count() == 0


def test_first_deliveries_are_a_hash_aggregate(table):
    plan = dedupe.first_deliveries(table, uuid_key("event_id"))._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "partial_min_by" in plan


def test_late_messages(table):
    rows = [r for r in rows_of() if r[5] is not None]
    keep = brute_first(rows)
    want = {}
    for r in rows:
        if r[0] in keep:
            end = us(0) + ((int(r[5].timestamp() * 1e6) - us(0)) // late.HOUR + 1) * late.HOUR
            got = int(r[6].timestamp() * 1e6)
            if got >= end:
                want[r[0]] = "corrected" if got < end + 24 * late.HOUR else "dropped"
    m = late.first_arrivals(table, uuid_key("event_id"), [])
    assert {r[0]: r[1] for r in late.late_messages(m).collect()} == want


def test_late_boundaries(spark):
    h, d = 3600, 86400
    cases = [(0, h - 1, None), (0, h, "corrected"), (0, h + d - 1, "corrected"), (0, h + d, "dropped"), (h - 1, h, "corrected"), (5 * d, 0, None), (h, 2 * h - 1, None)]
    df = spark.createDataFrame([(i, "x", None, "a", "e", at(t), at(r), "i", "s") for i, (t, r, _) in enumerate(cases)], SCHEMA)
    got = {r[0]: r[1] for r in late.late_messages(late.first_arrivals(df, uuid_key("event_id"), [])).collect()}
    assert got == {i: o for i, (_, _, o) in enumerate(cases) if o}


def test_lambda_views_agree_with_the_one_pass_view(spark, table):
    m = late.first_arrivals(table, uuid_key("event_id"), ["app_id"]).cache()
    views = late.LambdaViews(spark, ["app_id"])
    times = [us(s) for s in range(0, 520_000, 40_000 // 3600 * 3600)]
    for a, b in zip(times, times[1:]):
        views.ingest(m.filter((F.col("received_us") >= a) & (F.col("received_us") < b)))
        views.run_batch(b)
    got = {(r.app_id, r.period_us): r.n for r in views.view().collect()}
    want = {(r.app_id, r.period_us): r.final for r in late.final_view(m, ["app_id"]).collect() if r.final}
    assert got == want
    assert all(r.frozen for r in views.view().filter(F.col("period_us") < times[-1] - 26 * late.HOUR).collect())


def test_lambda_views_count_redelivered_messages_once(spark, table):
    log = table.filter("timestamp is not null")
    views = late.LambdaViews(spark, ["app_id"])
    times = [us(s) for s in range(0, 520_000, 120_000 // 3600 * 3600)]
    for a, b in zip(times, times[1:]):
        came = log.filter((F.unix_micros("received_at") >= a) & (F.unix_micros("received_at") < b))
        views.ingest(late.first_arrivals(came, uuid_key("event_id"), ["app_id"], named=True))
        views.run_batch(b)
    m = late.first_arrivals(log.filter(F.unix_micros("received_at") < times[-1]), uuid_key("event_id"), ["app_id"])
    got = {(r.app_id, r.period_us): r.n for r in views.view().collect()}
    assert got == {(r.app_id, r.period_us): r.final for r in late.final_view(m, ["app_id"]).collect() if r.final}


def brute_view(m, group):
    return {(*[r[g] for g in group], r.period_us): r.final for r in late.final_view(m, group).collect() if r.final}


@pytest.mark.parametrize("group", [[], ["app_id"], ["app_id", "slot"]])
def test_replayed_views_agree_with_one_pass(table, group):
    m = late.first_arrivals(table.withColumn("slot", F.when(F.col("delivery_id") % 3 > 0, F.col("slot"))), uuid_key("event_id"), group).cache()
    for every in (late.DAY // 2, 7 * late.DAY):
        views = late.replay(m, group, every=every)
        key = lambda df: sorted(map(repr, (sorted(r.asDict().items()) for r in df.collect())))
        assert key(views.late()) == key(late.late_messages(m))
        assert key(views.summary()) == key(late.final_view(m, group))
        assert key(views.versions()) == key(late.versions(m, group))
        assert {tuple(r[:-2]): r.n for r in views.view().select(*group, "period_us", "n", "frozen").collect()} == brute_view(m, group)


def test_views_of_an_empty_table(table):
    m = late.first_arrivals(table.limit(0), uuid_key("event_id"), [])
    views = late.replay(m, [])
    assert [views.view().count(), views.late().count(), views.summary().count(), views.versions().count()] == [0] * 4
    views.ingest(m)
    views.run_batch(us(0))
    assert views.view().count() == 0


def test_views_repeat_restart_and_redelivery(spark, table):
    log = table.filter("timestamp is not null")
    came = lambda a, b: late.first_arrivals(log.filter((F.unix_micros("received_at") >= us(a)) & (F.unix_micros("received_at") < us(b))), uuid_key("event_id"), [], named=True)
    cuts = [0, 90_000, 180_000, 270_000, 400_000]
    views = late.LambdaViews(spark, [])
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        views.ingest(came(a, b), n)
        views.ingest(came(a, b), n)  # the same call again
        if n:
            views.ingest(came(cuts[n - 1], a), 100 + n)  # all of the last batch delivered again
        views.run_batch(us(b))
        again = late.LambdaViews(spark, [], path=views.path)  # restarted
        assert (again.runs, again.last_run) == (views.runs, views.last_run) == (n, us(b))
        before = sorted(map(tuple, views.view().collect()))
        assert sorted(map(tuple, again.view().collect())) == before
        again.runs, again.last_run = n - 1, us(a) if n else None  # the run again, as after a failure
        again.run_batch(us(b))
        assert sorted(map(tuple, again.view().collect())) == before
        views = again
    m = late.first_arrivals(log, uuid_key("event_id"), [])
    assert {(r.period_us,): r.n for r in views.view().collect()} == brute_view(m, [])
    got = {r.delivery_id: r.outcome for r in views.late().collect()}
    want = {r.delivery_id: r.outcome for r in late.late_messages(m).collect()}
    assert {k: o for k, o in want.items() if o == "dropped"}.items() <= got.items() <= want.items()


def test_a_run_opens_only_the_folders_of_open_periods(spark):
    rows = [(i, "x", None, "a", "e", at(t), at(r), "i", "s") for i, (t, r) in enumerate([(0, 10), (86_400, 86_410), (864_000, 864_010), (9_000_000, 864_011), (-5_000_000, 864_012), (86_400, 100_000)])]
    m = late.first_arrivals(spark.createDataFrame(rows, SCHEMA), uuid_key("event_id"), [])
    views = late.replay(m, [], every=late.DAY)
    lanes = {(r.layer, r.lane) for r in views._log().select("layer", "lane").collect()}
    day = us(0) // late.DAY
    assert lanes == {("fast", day), ("fast", day + 1), ("batch", day + 1), ("fast", day + 10), ("fast", late.AHEAD), ("frozen", late.NONE)}
    assert {r.period_us: r.n for r in views.view().collect()}[us(86_400)] == 2


def test_versions_end_at_the_final_value(table):
    m = late.first_arrivals(table, uuid_key("event_id"), ["app_id"])
    last = late.versions(m, ["app_id"]).groupBy("app_id", "period_us").agg(F.max("value").alias("v"))
    assert last.join(late.final_view(m, ["app_id"]), ["app_id", "period_us"]).filter("v <> final").count() == 0


def brute_sessions(rows, gap):
    by = {}
    for app, who, t in rows:
        by.setdefault((app, who), []).append(t)
    out = []
    for (app, who), ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.append((app, who, start, prev, n))
                start, n = t, 0
            prev = t
            n += 1
        out.append((app, who, start, prev, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts,batch", [("1", "10000"), ("7", "3"), ("40", "50")])
def test_sessions_with_a_hot_key_over_many_partitions(spark, parts, batch):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(int(parts))
        rows = [(r.choice(["x", None]), "hot" if r.random() < 0.5 else r.choice(["a", "b", None, ""]), r.randrange(0, 3_000_000)) for _ in range(1500)]
        rows += rows[:50]  # repeated
        df = spark.createDataFrame([(a, w, dt.datetime.fromtimestamp(t, dt.timezone.utc)) for a, w, t in rows], "app_id string, distinct_id string, timestamp timestamp")
        got = sessions.sessionize(df, ["app_id", "distinct_id"], valid=F.col("distinct_id") != "")
        have = sorted([(x.app_id, x.distinct_id, x.start_us, x.end_us, x.n) for x in got.collect()], key=repr)
        assert have == brute_sessions([(a, w, t * 1_000_000) for a, w, t in rows if w], 1800 * 1_000_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_session_gap_is_exclusive_and_empty_is_empty(spark):
    df = spark.createDataFrame([("x", "a", at(0)), ("x", "a", at(1800)), ("x", "a", at(3601)), ("x", "a", None)], "app_id string, distinct_id string, timestamp timestamp")
    got = sorted((r.start_us, r.end_us, r.n) for r in sessions.sessionize(df, ["app_id", "distinct_id"]).collect())
    assert got == [(us(0), us(1800), 2), (us(3601), us(3601), 1)]
    assert sessions.sessionize(df.limit(0), ["app_id", "distinct_id"]).count() == 0


def test_pack_loads_balances():
    plan = skew.pack_loads(8, [10] * 128, {1: 5000, 2: 700})
    assert len(plan.heavy[1]) > len(plan.heavy[2]) >= 1
    assert max(plan.loads) <= 1.3 * plan.total / 8
    assert abs(sum(plan.loads) - plan.total) < 1e-6


def test_first_last_by_key_and_balance(spark, table):
    df = table.filter("timestamp is not null")
    got = {(r.distinct_id, r.name): (r.n, r.first_row, r.last_row) for r in skew.first_last_by_key(df, ["distinct_id", "name"]).collect()}
    want = {}
    for r in rows_of():
        if r[5] is not None:
            want.setdefault((r[3], r[4]), []).append((r[5], r[0]))
    assert got == {k: (len(v), min(v)[1], max(v)[1]) for k, v in want.items()}
    assert skew.first_last_by_key(df.limit(0), ["distinct_id", "name"]).count() == 0
    sizes = [r["count"] for r in skew.fragment(df.select("distinct_id", "delivery_id"), ["distinct_id"], "delivery_id", skew.plan_loads(df, [F.col("distinct_id")], 8)).groupBy("_task").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / 8


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_fragment_replicate_join(spark, table, how):
    left = table.select("delivery_id", "distinct_id")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4)], "distinct_id string, v int")
    got = skew.fragment_replicate_join(left, right, ["distinct_id"], "delivery_id", how)
    want = left.join(right, "distinct_id", how)
    key = lambda df: sorted(map(str, (r.asDict().items() for r in df.select(*sorted(df.columns)).collect())))
    assert key(got) == key(want)


def test_typed_stats_with_salts(spark, table):
    df = table.filter("timestamp is not null and distinct_id <> ''")
    got = {(r.app_id, r.distinct_id, r.name): (r.n, r.last_row) for r in features.typed_stats(df, ["app_id", "distinct_id"], "name", parts=16).collect()}
    want = {}
    for r in rows_of():
        if r[5] is not None and r[3]:
            want.setdefault((r[1], r[3], r[4]), []).append((r[5], r[0]))
    assert got == {k: (len(v), max(v)[1]) for k, v in want.items()}
    assert features.heavy_groups(df, ["app_id", "distinct_id", "name"], 16)


def test_feature_table_expands_every_type(spark, table):
    df = table.filter("timestamp is not null and distinct_id <> ''")
    types = features.type_list(df, "name")
    got = features.feature_table(df, ["app_id", "distinct_id"], "name").collect()
    for r in got:
        mine = [x for x in rows_of() if x[5] is not None and x[1] == r.app_id and x[3] == r.distinct_id]
        assert r.n_events == len(mine) and r.counts == [sum(x[4] == t for x in mine) for t in types]
        assert r.last_us == max(int(x[5].timestamp() * 1e6) for x in mine)
    assert features.feature_table(df.limit(0), ["app_id", "distinct_id"], "name").count() == 0
    with pytest.raises(ValueError):
        features.type_list(df, "name", limit=2)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 15])
def test_a_full_bitmap_keeps_the_same_rows(spark, table, bits, monkeypatch):
    monkeypatch.setattr(dedupe, "BITS", bits)
    odd = table.withColumns({c: F.lit("clash") for c in ("row", "k", "p", "block", "bits")})
    many = odd.unionByName(odd.withColumn("delivery_id", F.col("delivery_id") + 10_000).withColumn("event_id", F.lit("x"))).unionByName(odd.filter("delivery_id < 40"))
    kept = dedupe.keep_first(many, uuid_key("event_id"))
    assert kept.columns == many.columns
    want = sorted(brute_first(rows_of()) | {r[0] + 10_000 for r in rows_of()})
    assert sorted(r.delivery_id for r in kept.collect()) == want
