"""Tiers, windows, paging, fingerprints, personal data, symbols, identities, monitors, alerts, streaming."""

import datetime as dt
import hashlib
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenq.functions import fingerprint as fp
from lumenq.operators import alerts, behaviour, identity, latency, monitors, pii, purge, symbols, users
from lumenq.plans import paging, search, tier as tplan, window
from lumenq.plans.prepare import Clamp
from lumenq.query import QueryError, Resource, parse
from lumenq.scope import Env, Scope, narrow
from lumenq.session import shared_dir
from lumenq.sources import csvs, tier

UTC = dt.timezone.utc
T0 = dt.datetime(2023, 1, 1, tzinfo=UTC)
H = dt.timedelta(hours=1)
D = dt.timedelta(days=1)


def code(f, *a, **kw):
    with pytest.raises(QueryError) as e:
        f(*a, **kw)
    return e.value.code


# ---- tier planner

hours = st.integers(0, 200)


@given(hours, hours, hours, st.lists(st.tuples(hours, hours), max_size=5))
def test_plan_covers_the_window_exactly_once(wm, a, b, restored):
    t = lambda h: T0 + h * H
    p = tplan.plan(t(wm), t(a), t(b), [(t(x), t(y)) for x, y in restored])
    for h in range(201):
        at = t(h)
        hot, cold = (sum(x <= at < y for x, y in p[k]) for k in ("hot", "cold"))
        inside = a <= h < b
        want_hot = inside and (h >= wm or any(x <= h < y for x, y in restored))
        assert (hot, cold) == (int(want_hot), int(inside and not want_hot))
    for k in ("hot", "cold"):
        assert all(x[1] < y[0] for x, y in zip(p[k], p[k][1:]))


def test_buckets_and_months():
    t = dt.datetime(2023, 3, 1, 5, tzinfo=UTC)  # a Wednesday
    assert tplan.bucket(t, "week")[0] == dt.datetime(2023, 2, 27, tzinfo=UTC) and tplan.bucket(t, "month")[1] == dt.datetime(2023, 4, 1, tzinfo=UTC)
    assert tplan.months(dt.datetime(2022, 12, 31, 23, tzinfo=UTC), dt.datetime(2023, 2, 1, tzinfo=UTC)) == [(2022, 12), (2023, 1)]


def test_cycle_exports_once_verifies_and_prunes(spark):
    rows = [(i, f"app{i % 2}", T0 + i * 6 * H, f"u{i % 7}") for i in range(200)]
    hot = spark.createDataFrame(rows, "id bigint, app_id string, occurred_at timestamp, distinct_id string")
    path = shared_dir(spark, "cold-test")
    ranges = [(T0 + 10 * D * k, T0 + 10 * D * (k + 1)) for k in range(3)]
    wm, drop = tier.cycle(spark, hot, path, ranges, T0 + 10 * D)
    assert wm == T0 + 30 * D and drop == ranges[:1]
    assert tier.cycle(spark, hot, path, ranges, wm) == (wm, ranges)
    assert tier.read(spark, path, hot.schema, ranges).count() == 120
    got = tier.across(spark, hot.filter(F.col("occurred_at") >= F.lit(wm)), path, wm, T0, T0 + 60 * D)
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    plan = tier.read(spark, path, hot.schema, [ranges[0]], ["app1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "app_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    wider = T_schema(hot)
    assert tier.restore(spark, path, wider, ranges[0], "pin").filter("extra is null and restore_pin = 'pin'").count() == 40
    assert tier.read(spark, path + "-none", hot.schema, ranges).count() == 0
    with pytest.raises(ValueError):
        tier.across(spark, hot, path, wm, T0, T0 + 500 * D)


def test_cycle_keeps_what_is_recent_pinned_or_grown(spark):
    rows = [(i, f"app{i % 2}", T0 + i * 6 * H) for i in range(160)]
    hot = spark.createDataFrame(rows, "id bigint, app_id string, occurred_at timestamp")
    path = shared_dir(spark, "cold-guards")
    ranges = [(T0 + 10 * D * k, T0 + 10 * D * (k + 1)) for k in range(4)]
    now = T0 + 42 * D
    wm, drop = tier.cycle(spark, hot, path, ranges, T0, now, keep=5 * D)
    assert wm == T0 + 30 * D and drop == []  # the last range ended two days ago
    assert tier.cycle(spark, hot, path, ranges, wm, now, keep=5 * D, lag=20 * D) == (wm, ranges[:2])
    assert tier.cycle(spark, hot, path, ranges, wm, now, keep=5 * D, pinned=[(T0 + 12 * D, T0 + 13 * D)])[1] == [ranges[0], ranges[2]]
    grown = hot.unionByName(spark.createDataFrame([(999, "app0", T0 + D)], hot.schema))
    assert tier.cycle(spark, grown, path, ranges, wm, now, keep=5 * D) == (wm, ranges[1:3])


def test_stack_searches_reach_pooled_traces(spark):
    frame = "array<struct<function:string,module:string,filename:string,lineno:int,in_app:boolean>>"
    df = spark.createDataFrame([(1, "a", None, T0, [("merge", None, "m.js", 1, True)]), (2, "a", None, T0, [("other", None, "m.js", 1, True)]), (3, "a", None, T0, None)], f"id bigint, app_id string, environment_id string, occurred_at timestamp, stacktrace {frame}")
    rows, blobs = symbols.pool(df)
    for q, want in (("stack.function:merge", [1]), ("!stack.function:merge", [2, 3]), ("has:stack", [1, 2])):
        got, _ = search.rows(rows, Resource.OCCURRENCES, parse(q), T0 + H, blobs=blobs)
        assert sorted(r.id for r in got.collect()) == want


def T_schema(df):
    return df.withColumn("extra", F.lit(None).cast("string")).schema


def test_seam_day_is_partial(spark):
    df = spark.createDataFrame([("a", T0 + 1 * H), ("a", T0 + 20 * H), ("b", T0 + 30 * H)], "distinct_id string, occurred_at timestamp")
    wm = T0 + 12 * H
    cold, hot = df.filter(F.col("occurred_at") < F.lit(wm)), df.filter(F.col("occurred_at") >= F.lit(wm))
    got = {r.day: (r.users, r.partial) for r in tier.concatenated_distinct(hot, cold, wm).collect()}
    assert got == {dt.date(2023, 1, 1): (None, True), dt.date(2023, 1, 2): (1, False)}


# ---- windows and paging

def test_windows_take_the_tightest_limit():
    w = window.last_days("t", T0, 90, 60, Clamp(30, "costly"))
    assert w.start == T0 - 30 * D and w.clamped.reason == "costly" and w.clamped.to == "30d"
    assert window.last_days("t", T0, 0, 60).clamped is None and window.last_days("t", T0, 90, 60).clamped.to == "60d"
    assert window.last_days("t", T0, 30, 60, Clamp(30, "costly")).clamped is None
    w = window.between("t", ("t", "u"), T0, "u", None, T0)
    assert (w.column, w.start, w.end, w.clamped.to) == ("u", T0 - 365 * D, T0, "365d")
    assert window.between("t", ("t",), T0, None, T0 - 3 * D, T0 - D).clamped is None
    assert code(window.between, "t", ("t",), T0, "x") == "bad_time_field"
    assert code(window.between, "t", ("t",), T0, None, T0, T0) == "bad_window"


def test_cursor_round_trip_and_mismatches():
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    c = paging.Cursor("k", T0 + dt.timedelta(microseconds=7), u)
    assert paging.Cursor.decode(c.encode(), "k", True) == c
    s = paging.Cursor("k", "a|b:c", u)
    assert paging.Cursor.decode(s.encode(), "k", False) == s
    for text, key, temporal in ((c.encode(), "x", True), (c.encode(), "k", False), ("%%%", "k", True), (paging.Cursor("k", "v", "no").encode(), "k", False)):
        assert code(paging.Cursor.decode, text, key, temporal) == "bad_cursor"
    assert code(paging.Sort.parse, "nope", ("a",), "a") == "bad_sort"
    assert not paging.Sort.parse("-a", ("a",), "a").down and paging.Sort.parse(None, ("a",), "a").down


def test_keyset_pages_see_every_row_once_despite_ties(spark):
    rows = [(i, T0 + (i // 10) * H if i % 13 else None, "n") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, occurred_at timestamp, name string").withColumn("id", F.format_string("%05d", "id"))
    sort, got, cur = paging.Sort("occurred_at"), [], None
    while True:
        p = paging.page(df.filter("occurred_at is not null"), sort, 7, cur).collect()
        if not p:
            break
        got += [r.id for r in p]
        cur = paging.Cursor("occurred_at", p[-1].occurred_at.astimezone(UTC), p[-1].id)
    assert len(got) == len(set(got)) == 100 - len(range(0, 100, 13))
    assert paging.capped_count(df, 50).first() == (50, True) and paging.capped_count(df, 100).first() == (100, False)


@pytest.mark.parametrize("sort", ["name", "-name"])
def test_pages_go_on_among_nulls(spark, sort):
    rows = [(f"{i:03d}", "a", None, T0, None if i % 8 > 2 else f"n{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, app_id string, environment_id string, occurred_at timestamp, name string").withColumns({c: F.lit(None).cast("string") for c in ("distinct_id", "contexts", "extra", "properties", "session_id")}).withColumn("tags", F.lit(None).cast("map<string,string>"))
    got, cursor = [], None
    while True:
        e = search.listing(df, Resource.EVENTS, parse(""), T0 + D, sort, 4, cursor).envelope()
        got += [(r["name"], r["id"]) for r in e["data"]]
        cursor = e["next_cursor"]
        if not cursor:
            break
    want = sorted(((r[4], r[0]) for r in rows if r[4]), reverse=sort == "name") + sorted(((None, r[0]) for r in rows if not r[4]), key=lambda x: x[1], reverse=sort == "name")
    assert got == want


def test_persons_by_traits_and_devices_by_text(spark):
    who = spark.createDataFrame([("x", "a", T0, T0, 1, 0, 1, '{"plan": "pro"}'), ("y", "a", T0, T0, 1, 0, 1, '{"plan": "free"}'), ("x", "b", T0, T0, 2, 0, 1, None)], "app_id string, distinct_id string, first_seen timestamp, last_seen timestamp, events_count bigint, errors_count bigint, sessions_count bigint, properties string")
    e = search.listing(who, Resource.PERSONS, parse("traits.plan:pro"), T0 + D, days=365).envelope()
    assert [(r["app_id"], r["distinct_id"]) for r in e["data"]] == [("x", "a")]
    assert [(r["distinct_id"], r["app_id"]) for r in search.listing(who, Resource.PERSONS, parse(""), T0 + D, "-distinct_id").data.collect()] == [("a", "x"), ("a", "y"), ("b", "x")]
    dev = spark.createDataFrame([("x", "d1", "Pixel", T0), ("x", "d2", None, T0)], "app_id string, device_key string, family string, last_seen timestamp").withColumns({c: F.lit(None).cast("string") for c in ("model", "os_name", "browser", "distinct_id")})
    assert [r.device_key for r in search.listing(dev, Resource.DEVICES, parse('"pix"'), T0 + D).data.collect()] == ["d1"]


def test_listing_envelope(spark):
    rows = [(i, "a", None, T0 + i * H, f"n{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, app_id string, environment_id string, occurred_at timestamp, name string").withColumns({c: F.lit(None).cast("string") for c in ("distinct_id", "contexts", "extra", "properties", "session_id")}).withColumn("tags", F.lit(None).cast("map<string,string>"))
    e = search.listing(df, Resource.EVENTS, parse("n1"), T0 + 2 * D, limit=4, days=90).envelope()
    assert [r["id"] for r in e["data"]] == [28, 25, 22, 19] and e["total"] == 10 and e["clamped"].to == "30d" and e["next_cursor"]
    e = search.listing(df, Resource.EVENTS, parse("n1"), T0 + 2 * D, limit=4, cursor=e["next_cursor"]).envelope()
    assert [r["id"] for r in e["data"]][0] < 19 or e["data"][0]["occurred_at"].astimezone(UTC) < T0 + 19 * H


def test_withheld_body_columns(spark):
    df = spark.createDataFrame([], "id bigint, app_id string, occurred_at timestamp, properties string, contexts string, tags map<string,string>, name string, environment_id string")
    for q in ("contexts.a:1", "tag.a:1", "has:tag"):
        assert code(search.rows, df, Resource.EVENTS, parse(q), T0, body=False) == "withheld"
    found, _ = search.rows(df, Resource.EVENTS, parse("properties.a:1"), T0, body=False)  # no part of a body
    assert found.columns == ["id", "app_id", "occurred_at", "properties", "name", "environment_id"]
    assert "tags" in search.rows(df, Resource.EVENTS, parse("tag.a:1"), T0)[0].columns
    assert code(search.rows, df.withColumn("last_seen", F.col("occurred_at")), Resource.ISSUES, parse("release:1"), T0) == "not_searchable"


def test_scopes():
    assert narrow([Env()], Env.one("a")) == Env.one("a")
    assert narrow([Env.subset(["a"]), Env.subset(["b"])], Env()) == Env.subset(["a", "b"])
    assert narrow([Env.subset(["a"])], Env.one("b")) == Env.subset([]) == narrow([], Env())
    assert narrow([Env("unattributed")], Env("unattributed")) == Env("unattributed")


def test_scope_kinds(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", None), ("y", "a")], "app_id string, environment_id string")
    n = lambda **k: Scope(**k).apply(df).count()
    assert n() == 4 and n(app_id="x") == 3 and n(env=Env.one("a")) == 2 and n(env=Env.subset(["a", "b"])) == 3 and n(env=Env("unattributed")) == 1 and n(env=Env.subset([])) == 0 and n(apps=("y",)) == 1


# ---- fingerprints

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_fingerprints(spark):
    frame = "struct<function:string,module:string,filename:string,lineno:int,in_app:boolean>"
    f = lambda fn=None, mod=None, file=None, line=None, app=None: (fn, mod, file, line, app)
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    cases = [
        ((["a", "b"], "E", "v", None, "m"), sha("a\nb")),
        (([], "E(1)", "Id 42  of '" + u + "' at 0xAF,", None, "m"), sha("E\nid {n} of {uuid} at {n}xaf,".replace("{n}xaf,", "{n}xaf,"))),
        ((None, None, None, None, None), sha("message\nunknown")),
        ((None, None, None, None, "Took 5 s\n at 0xff"), sha("message\ntook {n} s at {addr}")),
        ((None, "E", "v", [f("g", "m", "x.js", 1, True), f("h", None, "y.js", 2, False), f("k9", "n", "z.js", 3, True)], None), sha("E\nn::k{n}\nm::g")),
        ((None, "E", "v", [f(None, None, "/a/b/app.3f2a9c.js?x=1", 1, None), f("", "m", None, 1, False)], None), sha("E\n?\napp.js")),
        ((None, "E", "v", [f(f"f{c}", None, None, 1, None) for c in "abcdefg"], None), sha("E\nfg\nff\nfe\nfd\nfc")),
    ]
    df = spark.createDataFrame([c[0] for c in cases], f"c array<string>, k string, v string, s array<{frame}>, m string")
    got = [r[0] for r in df.select(fp.fingerprint(F.col("c"), F.col("k"), F.col("v"), F.col("s"), F.col("m"))).collect()]
    assert got == [c[1] for c in cases]
    got = [r[0] for r in df.select(fp.culprit(F.col("s"))).collect()]
    assert got[4:] == ["k9 (z.js:3)", "", "fg"] or got[4:] == ["k9 (z.js:3)", " ", "fg"] or got[4] == "k9 (z.js:3)"
    assert got[0] == ""


def test_user_agents_and_device_keys(spark):
    chrome = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
    iphone = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1"
    df = spark.createDataFrame([(chrome, "{}"), (iphone, '{"device":{"family":"Pell","device_id":" x1 "}}'), (None, '{"device":{"family":"Pell"},"os":{"name":"ios"}}'), (None, None)], "ua string, ctx string")
    got = [r.asDict() for r in df.select(*[c.alias(n) for n, c in fp.device_fields(F.col("ctx"), F.col("ua")).items()]).collect()]
    assert (got[0]["browser"], got[0]["os_name"], got[0]["device_key"]) == ("Chrome", "Windows", "Windows|Chrome")
    assert (got[1]["browser"], got[1]["os_version"], got[1]["device_key"]) == ("Safari", "17.1", "x1")
    assert got[2]["device_key"] == "Pell|ios" and got[3]["device_key"] is None


# ---- personal data

@pytest.mark.parametrize("value,want", [("a@b.co", "email"), ("a@b@c.de", None), ("+491701234567", "phone_e164"), ("0170123456", None), ("192.168.0.1", "ipv4"), ("1.2.3.256", None), ("2001:db8::1", "ipv6"), ("12:30", None), ("abcdefgh.ijklmnop.q-r_s", "jwt"), ("DE89 3704 0044 0532 0130 00", "iban"), ("078-05-1120", "ssn_us"), ("666-05-1120", None), ("4111 1111 1111 1111", "credit_card"), ("4111 1111 1111 1112", None), ("", None), (5, None)])
def test_detectors(value, want):
    assert pii.detect(value) == want


def test_walk_and_scan_and_mask(spark):
    doc = {"User": {"Mail": "a@b.co"}, "list": ["x@y.zz", {"k": "1.2.3.4"}], "deep": {"a": {"b": {"c": {"d": {"e": {"f": "a@b.co"}}}}}}}
    assert [p for p, _, v in pii.walk(doc) if isinstance(v, str)] == ["User.Mail", "list[]", "list[].k"]
    assert list(pii.walk("x")) == []
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "not json"), (4, '"a@b.co"'), (5, '{"step":1}')], "id bigint, properties string")
    got = sorted((r.id, r.path, r.finding, r.preview) for r in pii.scan(df, "id", ["properties"], tracked=["STEP"]).collect())
    assert got == [(1, "User.Mail", "email", "a…o"), (1, "list[]", "email", "x…z"), (1, "list[].k", "ipv4", "1…4"), (5, "step", "key:step", "<number>")]
    masked = {r.id: r.properties for r in pii.mask_column(df, "properties", ["User", "Mail"]).collect()}
    assert json.loads(masked[1])["User"]["Mail"] == "****" and masked[3] == "not json" and masked[5] == '{"step":1}' and masked[2] is None


# ---- symbols

def test_source_maps(spark):
    assert symbols.vlq("AAgBC") == [0, 0, 16, 1] and symbols.vlq("D") == [-1]
    text = json.dumps({"version": 3, "sourceRoot": "src/", "sources": ["a.js", "http://x/b.js"], "names": ["f"], "mappings": "AAAA,IAACA;;CCAA,K"})
    m = symbols.SourceMap(text)
    assert m.resolve(1, 1) == ("src/a.js", 1, 1, None) and m.resolve(1, 9) == ("src/a.js", 1, 2, "f")
    assert m.resolve(3, 3) == ("http://x/b.js", 1, 2, None) and m.resolve(3, 1) is None and m.resolve(3, 9) is None and m.resolve(2, 1) is None and m.resolve(9, 1) is None
    frames = spark.createDataFrame([("m", 1, 9, i) for i in range(5)] + [("broken", 1, 1, 7), ("none", 1, 1, 8), (None, 1, 1, 9)], "artifact string, lineno int, colno int, id int")
    maps = spark.createDataFrame([("m", text), ("broken", "{")], "artifact string, map string")
    got = {r.id: (r.source, r.name) for r in symbols.symbolicate(frames, maps).collect()}
    assert got == {**{i: ("src/a.js", "f") for i in range(5)}, 7: (None, None), 8: (None, None), 9: (None, None)}


def test_stack_pool_round_trip(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, None)], "id int, stacktrace array<string>")
    rows, blobs = symbols.pool(df)
    assert blobs.count() == 1
    assert sorted((r.id, r.stacktrace) for r in symbols.hydrate(rows, blobs).collect()) == [(1, ["a", "b"]), (2, ["a", "b"]), (3, None)]


# ---- identities and purge

def test_claims_and_overlay(spark):
    have = spark.createDataFrame([("x", "g1", "u1")], "app_id string, alias_id string, distinct_id string")
    req = spark.createDataFrame([("x", "g1", "u1", 1), ("x", "g1", "u2", 2), ("x", "g2", "u1", 3), ("x", "g2", "u1", 4), ("x", "g2", "u3", 5), ("x", "g3", "g1", 6), ("x", "u1", "u9", 7), ("x", "s", "s", 8), ("y", "g1", "u2", 9)], "app_id string, alias_id string, distinct_id string, seq int")
    assert [r.outcome for r in identity.claim(have, req).orderBy("seq").collect()] == ["repeat", "conflict", "fresh", "repeat", "conflict", "chain", "chain", "chain", "fresh"]
    rows = spark.createDataFrame([("x", "g1", 1), ("y", "g1", 2), ("x", None, 3)], "app_id string, distinct_id string, n int")
    assert sorted(((r.n, r.distinct_id) for r in identity.overlay(rows, have).collect())) == [(1, "u1"), (2, "g1"), (3, None)]


def test_purge_keeps_unknown_rows(spark):
    df = spark.createDataFrame([("x", "a", 1), ("x", "a", None), ("x", "b", 2)], "app_id string, who string, v int")
    kept, gone = purge.split(df, F.col("v") <= 1)
    assert kept.count() == 2 and gone.count() == 1
    assert [tuple(r) for r in purge.touched(gone, ["who"]).collect()] == [("x", "who", "a")]


# ---- monitors and alerts

@settings(max_examples=15, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 3), st.integers(1, 3))
def test_window_transitions_equal_the_fold(spark, ups, down, up):
    rows = [("m", T0 + i * H, i, u) for i, u in enumerate(ups)]
    df = spark.createDataFrame(rows, "monitor_id string, checked_at timestamp, id int, up boolean")
    got = [(r["at"].astimezone(UTC), r.source, r.target, r.fires) for r in monitors.transitions(df, down, up).orderBy("at").collect()]
    assert got == list(monitors.fold([(t, u) for _, t, _, u in rows], down, up))


def test_status_match(spark):
    df = spark.createDataFrame([(200,), (204,), (301,), (404,), (None,)], "c int")
    assert [r[0] for r in df.select(monitors.status_matches("200-203, 301,x,9-", F.col("c"))).collect()] == [True, False, True, False, False]


def test_conditions_and_quiet_hours():
    c = alerts.Condition.parse("perf_degradation", {"window_seconds": 5, "metric": "zzz", "comparator": "near", "spike_factor": 0.2})
    assert (c.threshold, c.window_s, c.metric, c.comparator, c.factor) == (1000.0, 60, "p95", "gte", 1.0)
    assert alerts.Condition.parse("error_threshold", {"window_seconds": 10**9}).window_s == 86_400
    assert alerts.quiet(30, 1380, 60) and not alerts.quiet(60, 1380, 60) and alerts.quiet(1380, 1380, 60) and not alerts.quiet(5, 5, 5)
    probes = alerts.coalesce([("o", "error_spike", alerts.Condition("error_spike", factor=3.05), ("b", "a"), "x"), ("o", "error_spike", alerts.Condition("error_spike", factor=3.1), ("a", "b"), "y"), ("o", "error_spike", alerts.Condition("error_spike", factor=4), ("a",), "x")])
    assert [sorted(p.apps) for p in probes] == [["x", "y"], ["x"]]


def test_throttle_and_digest(spark):
    df = spark.createDataFrame([("k", T0 + s * dt.timedelta(seconds=1)) for s in (0, 10, 59, 60, 100, 121)] + [("j", T0)], "dedup_key string, at timestamp")
    got = sorted((r.dedup_key, (r["at"].astimezone(UTC) - T0).seconds) for r in alerts.throttle(df, 60).collect())
    assert got == [("j", 0), ("k", 0), ("k", 60), ("k", 121)]
    pend = spark.createDataFrame([("u", "a", "m2"), ("u", "a", "m1"), ("v", "b", "m3")], "user_id string, app_id string, message string")
    reach = spark.createDataFrame([("u", "a")], "user_id string, app_id string")
    assert [tuple(r) for r in alerts.digest(pend, reach).collect()] == [("u", 2, ["m1", "m2"])]


@pytest.mark.parametrize("parts", [1, 5])
def test_throttle_is_the_greedy_scan(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["hot", "hot", "k", None]), r.randrange(5000)) for _ in range(800)]
    df = spark.createDataFrame([(k, T0 + t * dt.timedelta(seconds=1)) for k, t in rows] + [("k", None)], "dedup_key string, at timestamp").repartition(parts)
    want = []
    for key in ("hot", "k", None):
        last = None
        for t in sorted({t for k, t in rows if k == key}):
            if last is None or t - last >= 90:
                want.append((key, t))
                last = t
    got = [(x.dedup_key, int((x["at"].astimezone(UTC) - T0).total_seconds())) for x in alerts.throttle(df, 90).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rules_are_evaluated_since_the_last_time(spark):
    now = T0 + 10 * D
    at = lambda h: now - h * H
    issues = spark.createDataFrame([(f"i{k}", "a", "unresolved", "error", at(h), at(0), 3) for k, h in enumerate((1, 3, 30))] + [("r1", "a", "resolved", "error", at(90), at(2), 9)], "id string, app_id string, status string, level string, first_seen timestamp, last_seen timestamp, times_seen bigint")
    errors = spark.createDataFrame([(i, "a", None, "error", at(h)) for i, h in (("i0", 1), ("i1", 3), ("i2", 30), ("r1", 2), ("x", 1), ("x", 2))], "issue_id string, app_id string, environment_id string, level string, occurred_at timestamp")
    run = lambda kind, last, c=None, **kw: sorted(r.subject for r in alerts.evaluate(kind, c or alerts.Condition(kind, window_s=86_400), now, last, issues=issues, errors=errors, **kw).collect())
    assert run("issue_new", at(2)) == ["i0"] and run("issue_new", None) == ["i0", "i1"] and run("issue_new", at(99)) == ["i0", "i1"]
    assert run("issue_regression", at(3)) == ["r1"] and run("issue_regression", at(1)) == []
    assert run("error_threshold", at(1), alerts.Condition("error_threshold", 5, 86_400)) == ["a"] and run("error_threshold", at(1), alerts.Condition("error_threshold", 6, 86_400)) == []
    changes = spark.createDataFrame([("m1", at(1), "up", "down", True), ("m2", at(1), "unknown", "up", False), ("m3", at(1), "down", "up", True)], "monitor_id string, at timestamp, source string, target string, fires boolean")
    assert run("monitor_down", at(2), changes=changes) == ["m1"] and run("monitor_up", at(2), changes=changes) == ["m3"] and run("monitor_up", at(0), changes=changes) == []
    tx = spark.createDataFrame([("a", None, "n", 2000.0, at(1))], "app_id string, environment_id string, name string, duration_ms double, occurred_at timestamp")
    assert run("perf_degradation", None, alerts.Condition("perf_degradation", 1000, 86_400), transactions=tx) == ["a"]
    with pytest.raises(ValueError):
        run("nothing", None)


@pytest.mark.parametrize("text,yes", [("1.2.3.4", True), ("255.255.255.255", True), ("01.002.3.4", True), ("1.0001.1.1", False), ("10.00255.1.1", False), ("256.1.1.1", False), ("1.2.3", False), ("1.2.3.4.5", False), (" 1.2.3.4 ", True), ("1..3.4", False), ("１.2.3.4", False)])
def test_ipv4(text, yes):
    assert pii.DETECTORS["ipv4"](text) is yes


def test_tier_counts(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], None if i % 3 else "e", f"u{i % 4}", T0 + i * H) for i in range(48)], "id bigint, app_id string, environment_id string, distinct_id string, occurred_at timestamp")
    n = lambda df: df.first().n
    assert n(tier.count_range(rows, T0, T0 + D)) == 24
    assert {(r.app_id, r.n) for r in tier.counts_by_app(rows, T0, T0 + D).collect()} == {("a", 12), ("b", 12)}
    assert n(tier.count_restorable(rows, (T0, T0 + D), rows.filter("id < 5"))) == 19
    assert n(tier.count_in_purge_scope(rows, Scope("a"), end=T0 + D)) == 12 and n(tier.count_in_purge_scope(rows, Scope(), distinct_ids=["u1"])) == 12
    assert n(tier.count_in_purge_scope(rows, Scope(env=Env("unattributed")), start=T0 + D)) == sum(i % 3 > 0 for i in range(24, 48))


def test_spikes(spark):
    rows = [("a", None, T0 + 30 * H)] * 4 + [("a", None, T0 + 5 * H)] + [("b", None, T0 + 30 * H)] * 4
    df = spark.createDataFrame(rows, "app_id string, environment_id string, occurred_at timestamp")
    c = alerts.Condition("error_spike", 2, 86_400)
    org = {r.app_id: r.fires for r in alerts.spike(df, T0 + 2 * D, c).collect()}
    own = {r.app_id: r.fires for r in alerts.spike(df, T0 + 2 * D, c, personal=True).collect()}
    assert org == {"a": True, "b": False} and own == {"a": True, "b": True}


# ---- behaviour

def test_issues_of_a_workflow(spark):
    rows = [("x", "buy", i) for i in ("a", "b", "b", None)] + [("x", "sell", "a")]
    df = spark.createDataFrame(rows, "app_id string, workflow_name string, issue_id string").withColumn("environment_id", F.lit(None).cast("string"))
    assert [tuple(r) for r in behaviour.workflow_top_issues(df, "buy").collect()] == [("b", 2), ("a", 1)]
    assert behaviour.workflow_top_issues(df, "buy", 1).count() == 1


def test_percentiles_by_sketch_are_exact_for_few_values_and_close_for_many(spark):
    df = spark.range(20_000).select(F.lit("a").alias("app_id"), F.lit(None).cast("string").alias("environment_id"), F.lit("n").alias("name"), F.lit("http").alias("op"), F.col("id").cast("double").alias("duration_ms"), F.lit("ok").alias("status"), F.lit(200).alias("http_status"), F.lit(T0).alias("occurred_at"))
    for rows, off in ((df.filter("id < 500"), 1), (df, 20_000 * 3 * 2.296 / 800**0.9723)):
        a, b = (latency.performance_summary(rows, T0 - D, k=k).first() for k in (None, 800))
        assert all(abs(a[c] - b[c]) <= off for c in ("p50", "p75", "p95", "p99")) and a.n == b.n



def test_funnel_equal_times_repeated_steps_and_order(spark):
    rows = [(1, "a", "s1", 0), (2, "a", "s2", 0), (3, "a", "s1", 5), (4, "b", "s2", 0), (5, "b", "s1", 1), (6, "c", "s1", 9), (7, None, "s1", 1), (8, "", "s1", 1)]
    df = spark.createDataFrame([(i, "x", None, w, n, T0 + t * H) for i, w, n, t in rows], "id int, app_id string, environment_id string, distinct_id string, name string, occurred_at timestamp")
    n = lambda *s: [r.n for r in behaviour.funnel(df, s, T0 - D).orderBy("step").collect()]
    assert n("s1", "s2") == [3, 1] and n("s1", "s1") == [3, 3] and n("s2", "s1", "s2") == [2, 2, 1] and n("zz", "s1") == [0, 0]
    assert code(behaviour.check_funnel, ["a"]) == "bad_funnel" and code(behaviour.check_funnel, ["a", "b" * 201]) == "bad_funnel"


def test_journey_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "x", None, "a", f"n{i % 2}", T0) for i in range(50)], "id int, app_id string, environment_id string, distinct_id string, name string, occurred_at timestamp")
    p = behaviour.paths(df, T0 - D, 3)
    assert sum(r.n for r in behaviour.journey_nodes(p).collect()) == 3 and sum(r.n for r in behaviour.journey_links(p).collect()) == 2
    assert "WindowGroupLimit" in p._jdf.queryExecution().executedPlan().toString()


def test_report_window():
    assert users.report_window(T0 + 5 * H, 2, 1) == (dt.date(2022, 12, 30), dt.date(2022, 12, 31))
    assert users.report_window(T0, 5, 1, dt.date(2022, 12, 30))[0] == dt.date(2022, 12, 30)
    for bad in ((93, 1), (1, 21), (92, 20)):
        assert code(users.report_window, T0, *bad) == "bad_window"


# ---- files and streams

def test_csv_guard(spark):
    df = spark.createDataFrame([("=1+1", 5), ("a,\"b\"", None), (None, -1)], "s string, n int")
    path = shared_dir(spark, "csv")
    csvs.write(df.coalesce(1), path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0] == "s,n" and "'=1+1,5" in lines and '"a,""b""",' in lines and any(x.endswith(",-1") for x in lines)


def test_store_reports(spark, tmp_path):
    import gzip

    (tmp_path / "r.csv.gz").write_bytes(gzip.compress("day,installs\n2023-01-01,5\n".encode()))
    (tmp_path / "u.csv").write_bytes("day,installs\n2023-01-02,7\n".encode("utf-16le"))
    assert [tuple(r) for r in csvs.store_report(spark, str(tmp_path / "r.csv.gz"), "day date, installs int").collect()] == [(dt.date(2023, 1, 1), 5)]
    assert [r.installs for r in csvs.store_report(spark, str(tmp_path / "u.csv"), "day string, installs int", "UTF-16LE").collect()] == [7]


def envelope(app, *items):
    return json.dumps({"app_id": app, "sent_at": "2023-01-01T00:00:00Z", "context": '{"device":{"device_id":"d1"}}', "items": list(items)})


def error(i, second, **kw):
    return {"type": "error", "event_id": f"00000000-0000-4000-8000-{i:012d}", "session_id": "s", "timestamp": f"2023-01-01T00:00:{second:02d}Z", "exception": {"type": "E", "value": "v", "mechanism": {"type": "g", "handled": False}}, **kw}


def test_stream_folds_batches_once(spark, tmp_path):
    from lumenq.streaming import ingest

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    q = lambda: ingest.start(ingest.read_envelopes(spark, str(src), 1), out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    (src / "1.json").write_text("\n".join([envelope("a", error(1, 5), error(1, 6), {"type": "event", "name": "n", "session_id": "s", "timestamp": "2023-01-01T00:01:00Z"}), "garbage", '{"app_id":"a","items":[]}']))
    q()
    (src / "2.json").write_text(envelope("a", error(1, 7), error(2, 1)))  # one message again, one new and earlier
    q()
    r = spark.read.parquet(out + "/issues/batch=1").collect()
    assert [(x.times_seen, x.title, x.first_seen.second, x.last_seen.second) for x in r] == [(2, "E: v", 1, 5)]
    s = spark.read.parquet(out + "/sessions/batch=1").first()
    assert (s.events_count, s.errors_count, s.unhandled_errors_count, s.device_key) == (1, 2, 2, "d1")
    assert sorted(x.reason for x in spark.read.json(out + "/dead").collect()) == ["no items", "not json"]
    again = ingest.Sink(out)
    again(spark.read.text(str(src / "2.json")), 1)  # the batch is run again
    assert [x.times_seen for x in spark.read.parquet(out + "/issues/batch=1").collect()] == [2]


def flow(name, second, **kw):
    return {"type": "event", "name": name, "workflow_id": "w", "timestamp": f"2023-01-01T00:00:{second:02d}Z", **kw}


def test_rollups_of_devices_people_and_workflows(spark, tmp_path):
    from lumenq.streaming import ingest

    out = str(tmp_path / "out")
    batches = [
        [envelope("a", flow("$workflow_start", 1, workflow_name="buy", distinct_id="u1", session_id="s"), error(1, 5, distinct_id="u1"))],
        [envelope("a", flow("step", 7, workflow_name="other", distinct_id="u2", session_id="s"), flow("$workflow_cancel", 9, properties='{"reason": "late"}'), flow("$workflow_end", 8))],
        [envelope("a", flow("$workflow_cancel", 2, properties='{"reason": "no"}'), flow("$workflow_start", 3, workflow_name="again", session_id="s2", distinct_id="u1"))],
    ]
    for every in (1, 2):
        sink = ingest.Sink(f"{out}{every}", every=every)
        for n, lines in enumerate(batches):
            for _ in range(2 if every == 2 else 1):  # each batch twice
                sink(spark.createDataFrame([(x,) for x in lines], "value string"), n)
        w = ingest.runs(sink.state(spark, "workflows", 2)).first()
        assert (w["name"], w.status, w.ended_at.second, w.cancel_reason, w.events_count, w.distinct_id, w.session_id) == ("buy", "completed", 8, None, 6, "u1", "s")
        d = sink.state(spark, "devices", 2).first()
        assert (d.device_key, d.events_count, d.errors_count, d.first_seen.second, d.last_seen.second, d.last_distinct_id) == ("d1", 6, 1, 1, 9, "u1")
        people = {r.distinct_id: (r.events_count, r.errors_count, r.sessions_count) for r in sink.state(spark, "person_envs", 2).collect()}
        assert people == {"u1": (2, 1, 2), "u2": (1, 0, 0)}  # s began with u1; u2 is in it later
        assert [r.sessions_count for r in sink.state(spark, "device_envs", 2).collect()] == [2]
        assert sink.state(spark, "issue_users", 2).select(F.hll_sketch_estimate("users")).first()[0] == 1
        with pytest.raises(RuntimeError):
            ingest.Sink(f"{out}-new", every=every)(spark.createDataFrame([(batches[0][0],)], "value string"), 1)


def test_failed_batches_are_parked_and_tried_again(spark, tmp_path):
    from lumenq.streaming import ingest

    class Failing(ingest.Sink):
        fails = 1

        def process(self, lines, over, n):
            if self.fails and not lines.isEmpty():
                self.fails -= 1
                raise TimeoutError("connection timed out")
            super().process(lines, over, n)

    now = [1000.0]
    sink = Failing(str(tmp_path / "out"), clock=lambda: now[0])
    line = lambda i: spark.createDataFrame([(envelope("a", error(i, i)),)], "value string")
    sink(line(1), 0)
    assert spark.read.parquet(sink.path + "/parked/batch=0").select("attempts", "due_us").first() == (1, 1030 * 10**6)
    sink(line(2), 1)
    assert sink.state(spark, "issues", 1).first().times_seen == 1
    now[0] += 31
    sink(line(3), 2)
    assert sink.state(spark, "issues", 2).first().times_seen == 3 and spark.read.parquet(sink.path + "/parked/batch=2").count() == 0
    sink.fails, n = 99, 3
    sink(line(4), n)
    for _ in range(5):
        now[0], n = now[0] + 3600, n + 1
        sink(line(4).limit(0), n)
    assert [r.reason for r in spark.read.json(sink.path + f"/dead/batch={n}").collect()] == ["attempts"]
    sink.fails = 0
    with pytest.raises(ValueError):
        type("Broken", (Failing,), {"process": lambda self, *a: (_ for _ in ()).throw(ValueError("no"))})(sink.path)(line(5), n + 1)


def test_copies_at_one_time_leave_the_same_one(spark):
    from lumenq.streaming import ingest

    rows = [("00000000-0000-4000-8000-000000000001", T0, f"m{i}") for i in range(6)]
    kept = {ingest.once(spark.createDataFrame(rows[k:] + rows[:k], "event_id string, occurred_at timestamp, message string").repartition(k + 1)).first().message for k in range(4)}
    assert len(kept) == 1


def test_masked_titles_are_sticky(spark):
    from lumenq.streaming import ingest

    cols = "app_id string, fingerprint string, title string, culprit string, level string, first_seen timestamp, last_seen timestamp, times_seen bigint"
    old = spark.createDataFrame([("a", "f", "****", "c", "error", T0, T0, 1)], cols)
    new = spark.createDataFrame([("a", "f", "secret", "d", "fatal", T0 - D, T0 + D, 2)], cols)
    r = ingest.fold_issues(old, new).first()
    assert (r.title, r.culprit, r.level, r.times_seen) == ("****", "d", "fatal", 3)


def test_breadcrumbs_attach_to_the_next_crash(spark, tmp_path):
    from lumenq.streaming import breadcrumbs

    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "u", i * 1_000_000, "crumb", f"c{i}") for i in range(120)] + [("a", "u", 120_000_000, "crash", "boom"), ("a", "u", 121_000_000, "crash", "again"), ("a", "v", 0, "crumb", "old"), ("a", "v", 1801 * 1_000_000, "crash", "late")]
    spark.createDataFrame(rows, "app_id string, distinct_id string, us bigint, kind string, text string").write.parquet(str(src / "b"))
    stream = spark.readStream.schema("app_id string, distinct_id string, us bigint, kind string, text string").parquet(str(src / "b"))
    q = breadcrumbs.attach(stream).writeStream.format("memory").queryName("crashes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()  # a processing-time timeout keeps asking for batches
    assert q.awaitTermination(60)
    got = {r.crash: r.breadcrumbs for r in spark.sql("select * from crashes").collect()}
    assert got["boom"] == [f"c{i}" for i in range(20, 120)] and got["again"] == [] and got["late"] == []
    random.seed(0)


def test_sessions_of_several_apps_page_in_total_order(spark):
    now = dt.datetime(2023, 1, 15, tzinfo=dt.timezone.utc)
    rows = [(app, sid, now - dt.timedelta(hours=1), n) for app in "abcde" for sid, n in (("s1", 4), ("s2", 4), ("s3", 1))]
    df = spark.createDataFrame(rows, "app_id string, session_id string, last_event_at timestamp, events_count bigint").repartition(5)
    for sort, down in (("events_count", True), ("-events_count", False)):
        got, cursor = [], None
        while True:
            e = search.listing(df, Resource.SESSIONS, parse(""), now, sort, 2, cursor).envelope()
            got += [(r["events_count"], r["session_id"], r["app_id"]) for r in e["data"]]
            cursor = e["next_cursor"]
            if not cursor:
                break
        assert got == sorted(((n, sid, app) for app, sid, _, n in rows), reverse=down)
    with pytest.raises(QueryError):
        search.listing(df, Resource.SESSIONS, parse(""), now, "events_count", 2, paging.Cursor("events_count", "4", "s1").encode())
