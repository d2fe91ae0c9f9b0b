"""The search language: lexing, parsing, rendering, typing, cost, older spellings."""

import datetime as dt

import pytest
from hypothesis import given, strategies as st

from lumenq.query import QueryError, Resource, from_legacy, parse, render, resolve
from lumenq.query.catalog import FIELDS, Cost
from lumenq.query.legacy import Allowed, whitelisted
from lumenq.query.resolve import Before, Test as Typed, cost, moment
from lumenq.query.tree import And, Not, Or, Pred, Text, from_json, to_json


def code(f, *a):
    with pytest.raises(QueryError) as e:
        f(*a)
    return e.value.code


def one(q, r=Resource.TRANSACTIONS):
    t = resolve(parse(q), r)
    assert isinstance(t, Typed)
    return t


def test_grouping_and_precedence():
    a, b, c = (Pred(x, "1", False, 0) for x in "abc")
    strip = lambda n: Pred(n.field, n.value, n.quoted) if isinstance(n, Pred) else Not(strip(n.of)) if isinstance(n, Not) else n if isinstance(n, Text) else type(n)(tuple(map(strip, n.of)))
    assert strip(parse("a:1 b:1 OR c:1")) == Or((And((a, b)), c))
    assert strip(parse("a:1 (b:1 or c:1)")) == And((a, Or((b, c))))
    assert strip(parse("!a:1 and !(b:1 c:1)")) == And((Not(a), Not(And((b, c)))))
    assert parse("") == And(()) and parse("  ") == And(())


def test_quotes_and_words():
    assert parse('"a b"') == Text("a b")
    assert parse('m:"a b"') == Pred("m", "a b", True, 0)
    assert parse(r'm:"say \"hi\""') == Pred("m", 'say "hi"', True, 0)
    assert parse("a(b") == Text("a(b") and parse("9:x") == Text("9:x") and parse("name:") == Text("name:")
    assert parse('name:""') == Pred("name", "", True, 0)
    assert parse('"or"') == Text("or")


@pytest.mark.parametrize("q,want", [("(a:1", "unmatched_open_paren"), ("a:1)", "unmatched_close_paren"), ("a:1 OR", "dangling_keyword"), ("OR a:1", "dangling_keyword"), ("a:1 AND", "dangling_keyword"), ("!", "dangling_bang"), ('a:"b', "unterminated_quote"), ("!" * 9 + "a:1", "too_deep"), (" ".join(["a:1"] * 65), "too_many_terms")])
def test_errors(q, want):
    assert code(parse, q) == want


def test_bounds_hold_exactly():
    parse("!" * 8 + "a:1")
    parse(" ".join(["a:1"] * 64))


WORDS = st.text("ab :()\"!\\*é", min_size=1, max_size=6)
TREES = st.recursive(st.one_of(st.builds(Pred, st.sampled_from(["a", "b.c", "$x"]), WORDS, st.just(True)), st.builds(Text, WORDS)), lambda s: st.one_of(st.builds(Not, s), st.builds(lambda x: And(tuple(x)), st.lists(s, min_size=2, max_size=3)), st.builds(lambda x: Or(tuple(x)), st.lists(s, min_size=2, max_size=3))), max_leaves=8)


def bare(n):
    match n:
        case Pred(f, v, q, _):
            return Pred(f, v, q)
        case Not(of):
            return Not(bare(of))
        case And(of) | Or(of):
            return type(n)(tuple(map(bare, of)))
    return n


@given(TREES)
def test_rendering_parses_back(tree):
    try:
        again = parse(render(tree))
    except QueryError as e:
        assert e.code == "too_deep"
        return
    assert bare(again) == bare(tree)
    assert from_json(to_json(again)) == again


def test_operators_and_values():
    assert one("duration:>2s").value == 2000 and one("duration:>2s").op == "gt"
    assert one("duration:<=1h").value == 3_600_000 and one("duration:7").value == 7
    assert one("name:~50%").value == r"%50\%%" and one("name:a*_b").value == r"a%\_b"
    assert one('name:"a*"').op == "eq"
    assert one("op:[http,custom]").value == ("http", "custom")
    assert one("has:url").op == "has"
    r = resolve(parse("http.status:[400..499]"), Resource.TRANSACTIONS)
    assert [(t.op, t.value) for t in r.of] == [("gte", 400), ("lte", 499)]
    assert one("tag:a b=1".replace("a b", "a/b")).path == "a/b" and one("tag.x:1").path == "x" and one("tag:x").path is None
    t = resolve(parse("is:unhandled"), Resource.OCCURRENCES)
    assert (t.field.column, t.value) == ("handled", False)
    assert one("os.version:1*", Resource.OCCURRENCES).path == "os.version" and one("browser.name:x", Resource.OCCURRENCES).path == "runtime.name"


@pytest.mark.parametrize("q,r,want", [("nope:1", Resource.EVENTS, "unknown_field"), ("level:loud", Resource.ISSUES, "bad_enum"), ("duration:2x", Resource.TRANSACTIONS, "bad_value"), ("duration:[1s..]", Resource.TRANSACTIONS, "bad_value"), ("op:>1", Resource.TRANSACTIONS, "bad_op"), ("is:lost", Resource.ISSUES, "bad_shorthand"), ("tag:=1", Resource.EVENTS, "bad_value"), ("http.status:99999999999999999999", Resource.TRANSACTIONS, "bad_value"), ("tag:a=1", Resource.DEVICES, "unknown_field"), ("name:[,]", Resource.EVENTS, "bad_value")])
def test_resolution_errors(q, r, want):
    assert code(resolve, parse(q), r) == want


def test_times():
    assert moment("-7d") == Before(seconds=7 * 86400) == moment("7days") and moment("5m") == Before(seconds=300) and moment("1month") == Before(months=1)
    assert moment("2026-01-02T03:04:05+02:00") == dt.datetime(2026, 1, 2, 1, 4, 5, tzinfo=dt.timezone.utc)
    for bad in ("d", "2026-01-02", "2026-01-02T03:04:05", "mo", "1fortnight"):
        with pytest.raises(ValueError):
            moment(bad)


def test_cost():
    c = lambda q, r=Resource.ISSUES: cost(resolve(parse(q), r))
    assert c("is:resolved") == Cost.INDEXED and c("level:error") == Cost.BOUNDED and c("crash") == Cost.SCAN
    assert c("is:resolved crash") == Cost.INDEXED and c("is:resolved OR crash") == Cost.SCAN and c("!is:resolved") == Cost.BOUNDED
    assert c("tag.a:b") == Cost.BOUNDED and c("has:tag", Resource.EVENTS) == Cost.BOUNDED and c("") == Cost.INDEXED and c("culprit:a*") == Cost.SCAN


def test_older_spellings():
    assert from_legacy(["name:eq:a%20b"]) == Pred("name", "a b", True, 0)
    assert from_legacy(["name:neq:*"], " crash ") == And((Not(Pred("name", "*", True, 0)), Text("crash")))
    assert from_legacy(["tag:contains:k=v"]) == Pred("tag.k", "~v", False, 0) and from_legacy(["tag:eq:a/b=v"]) == Pred("tag", "a/b=v", True, 0)
    assert code(from_legacy, ["name:eq"]) == "bad_value" and code(from_legacy, ["name:like:x"]) == "bad_op" and code(from_legacy, ["tag:eq:k="]) == "bad_value"
    allow = {"level": Allowed("enum", frozenset(["eq"]), ("error",)), "n": Allowed("num", frozenset(["gt"])), "tag": Allowed("tag", frozenset(["eq"]))}
    assert whitelisted(["level:eq:error", "n:gt:5", "tag:eq:a=b"], allow) == [("level", "eq", "error"), ("n", "gt", "5"), ("tag", "eq", "a=b")]
    for bad in ("level:eq:loud", "n:gt:x", "tag:eq:a", "level:neq:error", "zzz:eq:1"):
        code(whitelisted, [bad], allow)


def test_every_field_names_a_type_and_a_column():
    assert all(f.column and f.kind in ("str", "enum", "int", "bool", "duration", "time") and f.resources for f in FIELDS)
