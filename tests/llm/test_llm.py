"""The operators of the llm subpackage against brute force, library encoders and exact counts."""

import datetime as dt
import random
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from compare import plain  # noqa: E402

from lumenq.llm import distinct, packing, percentiles, queries, sentences, tokenizer  # noqa: E402

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
has_files = pytest.mark.skipif(not Path(tokenizer.vocabulary()).exists(), reason="no tokenizer files")


# ---- p1

def test_distinct_sets_unions_and_merge(spark):
    r = random.Random(3)
    rows = [(r.choice(["d1", "d2"]), r.choice(["n1", "n2", None]), "hot" if r.random() < 0.4 else r.choice([None, "", *map(str, range(40))]), str(r.randrange(30)), "clash") for _ in range(2000)]
    df = spark.createDataFrame(rows, "day string, name string, distinct_id string, session_id string, kind string")
    ids, groups = ["distinct_id", "session_id"], {"day": F.col("day"), "name": F.col("name")}
    whole = distinct.pairs(df, ids, groups, buckets=16)
    halves = distinct.merge(distinct.pairs(df.filter("day = 'd1'"), ids, groups, 16), distinct.pairs(df.filter("day = 'd2'"), ids, groups, 16), distinct.pairs(df.filter("day = 'd2'"), ids, groups, 16))
    sets = [("day",), ("day", "name"), ()]
    want = {}
    for d, n, a, b, _ in rows:
        for g, k in (("day", (d, None)), ("day,name", (d, n)), ("all", (None, None))):
            x = want.setdefault((g, *k), (set(), set()))
            x[0].update({a} - {None, ""})
            x[1].add(b)
    for found in (whole, halves):
        got = {(x.grp, x.day, x.name): (x.distinct_id, x.session_id) for x in distinct.grouping_sets(found, ids, ["day", "name"], sets).collect()}
        assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}
        u = {x.grp: (x.distinct_id, x.session_id) for x in distinct.unions(found, ids, {"n1 or d2": (F.col("name") == "n1") | (F.col("day") == "d2"), "none": F.lit(False)}).collect()}
        mine = [x for x in rows if x[1] == "n1" or x[0] == "d2"]
        assert u == {"n1 or d2": (len({x[2] for x in mine} - {None, ""}), len({x[3] for x in mine}))}
    assert distinct.grouping_sets(distinct.pairs(df.limit(0), ids, groups), ids, ["day", "name"], sets).count() == 0


def test_distinct_shuffles_identifiers_by_bucket_once(spark):
    df = spark.createDataFrame([("d", "a")], "day string, distinct_id string")
    plan = distinct.grouping_sets(distinct.pairs(df, ["distinct_id"], {"day": F.col("day")}), ["distinct_id"], ["day"], [("day",), ()])._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 3  # pairs, buckets, counts of groups


@has_data
def test_distinct_counts_rows_without_a_time(spark):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    src = f"(select strftime(timestamp, '%Y-%m-%d') as day, name, app_id, nullif(distinct_id, '') as d, nullif(session_id, '') as s from '{DATA}/js.parquet' where type = 'event' and (distinct_id <> '' or session_id <> ''))"
    by = {",".join(s): ", ".join(s) for s in queries.P1_SETS if s}
    want = {("all", *[None] * 3, *c.execute(f"select count(distinct d), count(distinct s) from {src}").fetchone())}
    for grp, cols in by.items():
        keys = ", ".join(g if g in grp.split(",") else "null" for g in queries.P1_GROUPS)
        want |= {(grp, *r) for r in c.execute(f"select {keys}, count(distinct d), count(distinct s) from {src} group by {cols}").fetchall()}
    found = queries.p1_distinct(spark, DATA)
    got = [tuple(r) for r in found.select("grp", *queries.P1_GROUPS, *queries.IDS).collect()]
    assert set(got) == want and len(got) == len(want)
    assert any(r[0] == "day" and r[1] is None for r in got)
    u = {r.grp: (r.distinct_id, r.session_id) for r in queries.p1_unions(spark, DATA).collect()}
    assert u["built-in events"] == c.execute(f"select count(distinct d), count(distinct s) from {src} where starts_with(name, '$')").fetchone()
    assert u["half of the apps"] == c.execute(f"select count(distinct d), count(distinct s) from {src} where app_id < '8'").fetchone()
    assert u["first week"] == c.execute(f"select count(distinct d), count(distinct s) from {src} where day >= '2023-01-01' and day < '2023-01-08'").fetchone()


# ---- p6

def test_percentiles_within_bound_and_merged(spark):
    r = np.random.default_rng(5)
    values = np.concatenate([r.lognormal(3, 2, 60_000), np.full(20_000, 7.0), [float("nan"), float("inf"), -float("inf"), -5.0]])
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(values)] + [(0, None)] * 5, "day int, v double").repartition(12)
    part = percentiles.partial_sketches(df, "v", {"day": F.col("day")}, k=200)
    got = percentiles.grouping_sets(part, ["day"], [("day",), ()], k=200).collect()
    finite = [[x for i, x in enumerate(values) if i % 7 == d and np.isfinite(x)] for d in range(7)]
    for row in got:
        mine = np.sort(finite[row.day] if row.grp == "day" else np.concatenate(finite))
        assert row.n == len(mine)
        for p, name in zip(percentiles.PERCENTILES, ("p25", "p50", "p75", "p90", "p95", "p99")):
            low, high = np.searchsorted(mine, row[name], "left") / len(mine), np.searchsorted(mine, row[name], "right") / len(mine)
            assert low - p <= percentiles.bound(200) and p - high <= percentiles.bound(200)
    assert percentiles.partial_sketches(df.limit(0), "v", {"day": F.col("day")}).count() == 0


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)], "g string, v double")
    row = percentiles.answers(percentiles.partial_sketches(df, "v", {"g": F.col("g")}), ["g"]).first()
    assert (row.n, row.p50, row.p99) == (101, 50.0, 99.0)


@has_data
def test_percentiles_take_rows_without_a_time(spark):
    src = f"(select * from '{DATA}/flutter.parquet' where isfinite(duration_ms))"
    want = {tuple(r) for r in duckdb.sql(f"select op, http_status, count(*) from {src} group by all").fetchall()}
    every = queries.p6_percentiles(spark, DATA).select("grp", "op", "http_status", "day", "n").collect()
    assert {(r.op, r.http_status, r.n) for r in every if r.grp == "op,http_status"} == want
    assert [r.n for r in every if r.grp == "all"] == [sum(n for *_, n in want)]
    assert sum(r.n for r in every if r.grp == "op,day" and r.day is None) == duckdb.sql(f"select count(*) from {src} where timestamp is null").fetchall()[0][0] > 0
    checked = queries.p6_checked(spark, DATA).collect()
    assert {(r.op, r.http_status, r.n) for r in checked} == want and all(r.within for r in checked)


# ---- p8

SAMPLES = ["", " ", "a", "it's we'll they've I'm you'd can't 'tis '", "''s", " 's", "'sabc'tx", "a  b", "a \n b\n\n", "　x  ", "'ll'", "a" * 500, "=" * 3000, "<|endoftext|>", "１２３ ½ ²", "\t\t'stop", "éa", "\x1c\x1d a\x85b", "مرحبا 'sال", "​b\xa0 c", "日本語のテキスト。", "ภาษาไทย ไม่มี", "👩‍👩‍👧 ok", "İ'S don'T"]


@has_files
def test_ids_equal_the_library_and_decode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer.vocabulary())
    t.encode_special_tokens = True
    m = tokenizer.merger(tokenizer.vocabulary())
    ids, before, starts, n, slices = tokenizer.encode(SAMPLES, m)
    for i, s in enumerate(SAMPLES):
        mine = ids[before[i] : before[i + 1]].tolist()
        assert mine == t.encode(s, add_special_tokens=False).ids, s
        assert m.decode(mine) == s
        cut = [*starts[slices[i] : slices[i + 1]].tolist(), len(s)]
        own = n[slices[i] : slices[i + 1]]
        at = before[i] + np.r_[0, np.cumsum(own)]
        assert all(m.decode(ids[at[k] : at[k + 1]]) == s[cut[k] : cut[k + 1]] for k in range(len(own)))


@has_files
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stldremv1 \n\t　é日.ก!"), max_size=30), max_size=6))
def test_boundaries_equal_the_published_pattern(texts):
    import public_tokenizers
    import regex

    want = [[m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)] for t in texts]
    _, at, before = tokenizer.pretokenize(texts)
    begin = np.r_[0, np.cumsum([len(t) for t in texts])].astype(int)
    assert [(at[before[i] : before[i + 1]] - begin[i]).tolist() for i in range(len(texts))] == want


@has_files
def test_merger_with_a_tiny_cache_gives_the_same():
    small, big = tokenizer.Merger(tokenizer.vocabulary(), cache=3), tokenizer.merger(tokenizer.vocabulary())
    for s in SAMPLES:
        assert tokenizer.encode([s, s], small)[0].tolist() == tokenizer.encode([s, s], big)[0].tolist()


@has_files
def test_token_ids_of_null_empty_repeated(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, r.ids) for r in tokenizer.token_ids(df).collect()), key=repr)
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995]), (None, [87])]
    assert tokenizer.token_ids(df.limit(0)).count() == 0
    assert dict((r.doc_id, r.n_tokens) for r in tokenizer.token_counts(df).collect())[3] == 2


def test_chunks_keep_long_texts_whole():
    assert list(tokenizer.chunks(["a" * 5, "b" * 50, "c", "d"], 10)) == [(0, 1), (1, 2), (2, 4)]


# ---- p9

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_pack_places_each_item_by_the_sum_of_squares(sizes):
    got = packing.pack(np.array(sizes, np.int64), 50)
    level: dict[int, int] = {}
    for s, b in zip(sizes, got.tolist()):
        if not s:
            assert b == 0
            continue

        def total(levels):
            return sum(n * n for h, n in Counter(levels.values()).items() if h < 50)

        options = {x: total({**level, x: h + s}) for x, h in level.items() if h + s <= 50}
        new = max(level, default=-1) + 1
        options[new] = total({**level, new: s})
        assert options[b] == min(options.values())
        level[b] = level.get(b, 0) + s
    assert all(h <= 50 for h in level.values())


def test_pack_items_is_complete_and_tight(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([None, 0, 5000, 2048, 2049]) if r.random() < 0.05 else min(9000, int(r.lognormvariate(5, 1.2)) + 1)) for i in range(4000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n bigint").withColumn("container", F.lit("clash"))
    got = packing.pack_items(df, "doc_id", "n").toPandas()
    assert packing.pack_items(df.limit(0), "doc_id", "n").count() == 0
    whole = got.groupby("doc_id").n_tokens.sum().to_dict()
    assert whole == {i: n or 0 for i, n in sizes}
    assert got.groupby("container").n_tokens.sum().max() <= 2048
    pieces = got.groupby("doc_id").size().to_dict()
    assert all(pieces[i] == max(1, -(-(n or 0) // 2048)) for i, n in sizes)
    used = got[got.n_tokens > 0].container.nunique()
    assert used <= 1.01 * -(-got.n_tokens.sum() // 2048) + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 400), max_size=25), st.sampled_from([8, 50, 10_000]))
def test_a_plan_holds_every_item_once(counts, steps):
    p = packing.plan(counts, 60, steps)
    sizes = np.repeat(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))
    ranks = np.concatenate([np.arange(n) for n in counts.values()] or [np.zeros(0)]).astype(np.int64)
    at = p.lookup(sizes, ranks)
    fill = np.bincount(at, weights=sizes, minlength=p.containers)
    assert len(fill) == p.containers and (fill <= 60).all() and (fill > 0).all()


def test_plans_stay_tight_and_short_as_items_grow():
    r = np.random.default_rng(1)
    shape = np.bincount(np.minimum(2048, (r.lognormal(4.6, 1.0, 20_000) + 1).astype(int)), minlength=2049)
    for times in (1, 100, 10_000):
        counts = {s: int(n) * times for s, n in enumerate(shape) if n}
        p = packing.plan(counts, steps=10_000)
        assert p.containers <= 1.002 * -(-sum(s * n for s, n in counts.items()) // 2048) + 1
        halvings = max(0.0, np.log2(sum(counts.values()) / 10_000))
        assert len(p.start) <= 12_500 + halvings * (2_500 + 2 * 2048) + 2048


def test_one_size_of_a_third_and_keys_that_repeat(spark):
    sizes = [(i % 500 if i % 3 else None, 600 if i % 3 == 0 else i % 90) for i in range(6000)]
    df = spark.createDataFrame(sizes, "k bigint, n bigint").repartition(7)
    got = packing.pack_items(df, "k", "n", steps=200).toPandas()
    assert Counter(got.n_tokens.tolist()) == Counter(n for _, n in sizes) and got.groupby("container").n_tokens.sum().max() <= 2048
    assert got.container.nunique() <= 1.02 * -(-sum(n for _, n in sizes) // 2048) + 1


# ---- p10

def split(text, *corpus, lex=None):
    if lex is None:
        lex = sentences.Lexicon()
    return [text[a:b] for a, b in sentences.Splitter(lex).spans(text)]


LEX = sentences.Lexicon({"Dr": sentences.NEVER, "No": sentences.NEVER, "e.g": sentences.NEVER, "etc": sentences.MAY_END, "Inc": sentences.MAY_END}, {"npm": (10, 5), "However": (20, 10), "Mal": (0, 50), "Die": (50, 5), "Tuesday": (0, 400)})


@pytest.mark.parametrize("text,want", [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
    ("By Dr. Who, No. 7, e.g. this. Next.", ["By Dr. Who, No. 7, e.g. this.", "Next."]),
    ("Web, etc. However, no. Web, etc. and more.", ["Web, etc.", "However, no.", "Web, etc. and more."]),
    ("For Kero Inc. npm failed.", ["For Kero Inc.", "npm failed."]),
    ("Kero Inc. Tuesday sale.", ["Kero Inc. Tuesday sale."]),
    ("Zum 21. Mal neu. Um 21. Die Zeit.", ["Zum 21. Mal neu.", "Um 21.", "Die Zeit."]),
    ("It waited ... and waited… Then it fell.", ["It waited ... and waited…", "Then it fell."]),
    ('He said "No. Why?" and left. She said "Go." Then left.', ['He said "No. Why?" and left.', 'She said "Go."', "Then left."]),
    ("It failed (it should not!), twice. (It did.) Done!!", ["It failed (it should not!), twice.", "(It did.)", "Done!!"]),
    ("v6.1.2 and a.b() at 3.5 s. Ok", ["v6.1.2 and a.b() at 3.5 s.", "Ok"]),
    ("值班人员说：“已经恢复。”第4号。日志里的“满。试！”这句话。", ["值班人员说：“已经恢复。”", "第4号。", "日志里的“满。试！”这句话。"]),
    ("「満杯です。」と記録。復旧しました！", ["「満杯です。」と記録。", "復旧しました！"]),
    ("ทีมงานแก้ไขแล้ว ระบบกลับมา พบ Error ในรุ่น v5 เท่านั้น", ["ทีมงานแก้ไขแล้ว", "ระบบกลับมา", "พบ Error ในรุ่น v5 เท่านั้น"]),
    ("Γιατί το X μόνο στο v6.1; Όλα καλά; Ναι.", ["Γιατί το X μόνο στο v6.1;", "Όλα καλά;", "Ναι."]),
    ("सेवा लौटी। अब ठीक है! लॉग में “भर गई। फिर करें।” वाला संदेश आया।", ["सेवा लौटी।", "अब ठीक है!", "लॉग में “भर गई। फिर करें।” वाला संदेश आया।"]),
    ("Խնդիրը լուծված է։ Տես։", ["Խնդիրը լուծված է։", "Տես։"]),
    ("ችግሩ ተፈቷል። ለምን ታየ፧ አዎ።", ["ችግሩ ተፈቷል።", "ለምን ታየ፧", "አዎ።"]),
    ("1. First. Second.\n\n## Head\n\n• Item one", ["1. First.", "Second.", "## Head", "• Item one"]),
    ("- 1. One thing. Two", ["- 1. One thing.", "Two"]),
    ("It is ok. 🎉 Party. → Next", ["It is ok.", "🎉 Party.", "→ Next"]),
    ("A line\nwraps. Next\r\n \r\nBlock", ["A line\nwraps.", "Next", "Block"]),
    ("Before.\n```\nx. Y. z\n```\nAfter. End", ["Before.", "After.", "End"]),
    ("```\nall code. Here.", []), ("", []), (" \n\t ", []),
])
def test_sentences(text, want):
    assert split(text, lex=LEX) == want


def test_the_document_decides_before_the_corpus():
    text = "He saw the approx. value again. Later approx. Kero came."
    assert split(text)[0] == "He saw the approx. value again."


def test_plain_use_in_the_document_overrules_the_corpus():
    lex = sentences.Lexicon({"fig": sentences.NEVER, "Dr": sentences.NEVER})
    assert split("We ate a fig. Then a fig fell. The fig is sweet.", lex=lex) == ["We ate a fig.", "Then a fig fell.", "The fig is sweet."]
    assert len(split("See fig. Then see it, fig. and more.", lex=lex)) == 1  # nothing plain: the corpus
    assert split("See Dr. Kero, as Dr Kero says, or Dr Kero.", lex=lex) == ["See Dr. Kero, as Dr Kero says, or Dr Kero."]  # a name behind it


def test_long_words_are_shown_by_more_occurrences():
    once = "It was supplementar. and more. In supplementar. Kero came."
    assert split(once)[0] == "It was supplementar."
    assert split("It was supplementar. one, " * 3 + "in supplementar. Kero came.")[0].startswith("It was supplementar. one, It")
    assert sentences.classify("Dr", 3, 5, 0, 0) and sentences.classify("univers", 3, 0, 0, 0) is None and sentences.classify("univers", 9, 2, 0, 0)


def test_words_are_counted_whole():
    a, b = "x" * 60 + "1", "x" * 60 + "2"
    tally = sentences.Tally()
    tally.add(f"One {a} and {b}. we see {a}")
    counts = tally.counts()
    assert counts["t", a, "m"] == 2 and counts["t", b, "m"] == 1 and counts["p", b, "we"] == 1


def test_text_of_another_language_leaves_sentences_as_they_are(spark):
    texts = ["Siehe Abb. 4 und Tab. Drei, vgl. auch oben. Zum 21. Mal neu.", "Abb. 5, Abb. und mehr. Die Zeit ist um.", "Siehe Abb. oder Tab. und mehr, vgl. alles."] * 4
    small = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    more = spark.range(100, 2_100).select(F.col("id").alias("doc_id"), F.lit("The server failed again. It was restored at noon. " * 20).alias("text"))
    key = lambda df: sorted(map(tuple, df.filter("doc_id < 100").collect()))
    assert key(sentences.sentences(small)) == key(sentences.sentences(small.unionByName(more)))


@has_data
def test_a_joined_lexicon_gives_the_same_sentences(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).select("doc_id", "text", F.lit("clash").alias("digest"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(sentences.sentences(docs, most=10)) == key(sentences.sentences(docs)) != key(sentences.sentences(docs, lexicon=sentences.Lexicon()))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab A.!?…\"'“”()« »。「」 \n\r`#-1;ก้ฯ"), max_size=80))
def test_every_visible_character_is_in_one_sentence(text):
    spans = sentences.Splitter(LEX).spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a, b)}
    inside = {i for a, b in sentences.blocks(text) for i in range(a, b) if not text[i].isspace()}
    assert {i for i in covered if not text[i].isspace()} == inside


def test_corpus_lexicon_finds_classes(spark):
    texts = ["According to Dr. Kero, it works. However, no. Web, app, etc. However, fine."] * 8 + ["It broke, etc. and more. See Dr. Kero."] * 8 + ["npm failed again.", "We use npm."] * 6 + ["Web, app, etc."] * 6 + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    lex = sentences.corpus_lexicon(df)
    assert lex.abbreviations["Dr"] == sentences.NEVER and lex.abbreviations["etc"] == sentences.MAY_END and lex.small_start("npm") and "works" not in lex.abbreviations
    tally = sentences.Tally()
    for t in texts:
        tally.add(t or "")
    counts = tally.counts()
    assert lex.starts["However"] == (counts["t", "However", "s"], counts["t", "However", "m"])
    rows = sentences.sentences(df).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts) - 2)) and sentences.sentences(df.limit(0)).count() == 0


def test_a_larger_corpus_keeps_rare_abbreviations(spark):
    rare = [(i, "See Mrk. Kero and qty. 4 of it, approx. all.") for i in range(6)]
    small = spark.createDataFrame(rare, "doc_id bigint, text string")
    more = spark.range(16).select(F.col("id").alias("doc_id"), F.repeat(F.lit("filler "), F.lit(250_000)).alias("text"))
    few, many = sentences.corpus_lexicon(small), sentences.corpus_lexicon(small.unionByName(more))
    assert few.abbreviations and few.abbreviations == many.abbreviations
    assert few.starts.items() <= many.starts.items()


@pytest.mark.parametrize("text", ["...", "日本語" * 20, "x" * 60, "日本語" * 20 + "。" + "文" * 50 + "。"])
def test_texts_without_words_have_sentences(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    spans = [(r.start_char, r.end_char) for r in sentences.sentences(df).collect()]
    assert sorted(spans) == sentences.Splitter(sentences.Lexicon()).spans(text) and spans


# ---- queries

@has_data
@has_files
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_llm_queries(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.toArrow().to_pylist())
    assert got
    if name in queries.SQL:
        c = duckdb.connect()
        c.execute("set timezone='UTC'")
        for p in Path(DATA).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        cur = c.execute(queries.SQL[name])
        names = [x[0] for x in cur.description]
        assert got == sorted(repr([plain(r[names.index(k)]) for k in cols]) for r in cur.fetchall())


def test_days_are_utc():
    assert dt.datetime(2023, 1, 1, tzinfo=dt.timezone.utc).strftime("%Y-%m-%d") == "2023-01-01"
