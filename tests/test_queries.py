"""Every query with SQL against DuckDB on the smallest tables; the contract of the entry module."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from compare import plain  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CORE = [q for q in entry.oracle_sql() if not q.startswith(("p1_", "p6_", "p8_", "p9_", "p10_"))]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.toArrow().to_pylist())
    cur = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["fingerprint", "pii_scan", "stream_ingest"])
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("src", ["js", "node"])
def test_kept_rows_are_whole(spark, src):
    rows = entry.queries()[f"p7_kept_{src}"](spark, DATA)
    before = spark.read.parquet(f"{DATA}/{src}.parquet")
    assert rows.schema.simpleString() == before.schema.simpleString()
    text = lambda df: sorted(repr([plain(x) for x in r.values()]) for r in df.toArrow().to_pylist())
    removed = entry.queries()["p7_found"](spark, DATA).filter(f"src = '{src}'")
    assert text(rows) == text(before.join(removed, "delivery_id", "left_anti").select(before.columns)) and removed.count()


def test_core_does_not_import_the_subpackage():
    for p in (ROOT / "lumenq").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lumenq.llm" not in p.read_text(), p
    assert importlib.util.find_spec("lumenq")
