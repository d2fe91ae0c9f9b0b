"""Queries of the problems tagged llm (p1, p6, p8, p9, p10), with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenq.llm import distinct, packing, percentiles, sentences, tokenizer
from lumenq.session import written
from lumenq.sources.tables import table

IDS = ("distinct_id", "session_id")
P1_GROUPS = ("day", "name", "app_id")
P1_SETS = (("day",), ("name",), ("app_id",), ("day", "name"), ("day", "app_id"), ("name", "app_id"), ("day", "name", "app_id"), ())
P6_GROUPS = ("op", "http_status", "app_id", "day")
P6_SETS = (P6_GROUPS, ("op", "http_status", "day"), ("op", "app_id", "day"), ("op", "http_status"), ("op", "day"), ("op",), ())


def tokenizer_file() -> str:
    """The vocabulary; the folder is LUMENQ_TOKENIZERS, or where the public files usually lie."""
    return tokenizer.vocabulary(os.environ.get("LUMENQ_TOKENIZERS", tokenizer.TOKENIZERS))


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def _p1_pairs(spark: SparkSession, d: str, rows: str = "true") -> DataFrame:
    """Event rows without a client time have a null day, which is a value of its own."""
    events = table(spark, d, "js").filter("type = 'event'").filter(rows)
    return distinct.pairs(events, IDS, {"day": _day("timestamp"), "name": F.col("name"), "app_id": F.col("app_id")})


def p1_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct.grouping_sets(_p1_pairs(spark, d), IDS, P1_GROUPS, P1_SETS)


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from the partial results of two halves of the table by time of receipt."""
    halves = [_p1_pairs(spark, d, f"received_at {c} timestamp'2023-01-09 00:00:00'") for c in ("<", ">=")]
    return distinct.grouping_sets(distinct.merge(*halves), IDS, P1_GROUPS, P1_SETS)


def p1_unions(spark: SparkSession, d: str) -> DataFrame:
    """Unions of groups that no grouping set has; rows without a client time are in those that don't ask for a day."""
    day, name = F.col("day"), F.col("name")
    wanted = {
        "first week": (day >= "2023-01-01") & (day < "2023-01-08"),
        "second week": (day >= "2023-01-08") & (day < "2023-01-15"),
        "built-in events": name.startswith("$"),
        "own events": ~name.startswith("$"),
        "screens or page views on weekends": name.isin("$screen", "$pageview") & F.dayofweek(F.to_date(day)).isin(1, 7),
        "half of the apps": F.col("app_id") < "8",
    }
    return distinct.unions(_p1_pairs(spark, d), IDS, wanted)


def _p6_partials(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a time are sketched under a null day, a value of its own."""
    return percentiles.partial_sketches(table(spark, d, "flutter"), "duration_ms", {"op": F.col("op"), "http_status": F.col("http_status"), "app_id": F.col("app_id"), "day": _day("timestamp")})


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.grouping_sets(_p6_partials(spark, d), P6_GROUPS, P6_SETS)


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """(op, http_status, n, within): whether each percentile's true rank, counted in the whole table, is within the stated
    error, once."""
    by = ["op", "http_status"]
    found = percentiles.answers(percentiles.merged(_p6_partials(spark, d), by), by)
    names = found.columns[3:]
    q = found.select(*[F.col(c).alias(f"q_{c}") for c in by], "n", F.array(*names).alias("q"))
    rows = table(spark, d, "flutter").select(*by, F.col("duration_ms").alias("v")).filter("abs(v) < double('infinity') and not isnan(v)")
    j = rows.join(q, (rows.op.eqNullSafe(q.q_op)) & (rows.http_status.eqNullSafe(q.q_http_status)))
    counts = [F.count_if(F.col("v") < F.col("q")[i]).alias(f"lt{i}") for i in range(len(names))] + [F.count_if(F.col("v") <= F.col("q")[i]).alias(f"le{i}") for i in range(len(names))]
    c = j.groupBy(*by, "n").agg(*counts)
    e = percentiles.bound()
    ok = [(F.col(f"lt{i}") / F.col("n") <= p + e) & (F.col(f"le{i}") / F.col("n") >= p - e) for i, p in enumerate(percentiles.PERCENTILES)]
    return c.select(*by, "n", F.forall(F.array(*ok), lambda x: x).alias("within"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"), path=tokenizer_file())


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_offsets(table(spark, d, "documents"), path=tokenizer_file())


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) of each document, decoded from its ids."""
    return tokenizer.decoded(p8_ids(spark, d), path=tokenizer_file())


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), path=tokenizer_file())


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, whole): whether a document's pieces are its tokens, end to end, each in a container that is not too full
    and, but for the last piece, in one of its own."""
    packed = written(p9_containers(spark, d), "packed")
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count_if(F.col("n_tokens") > 0).alias("inside"))
    pieces = packed.join(full, "container").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("first_token")).alias("firsts"), F.max("piece").alias("top"), F.max("fill").alias("fill"),
        F.count_if((F.col("n_tokens") == packing.CAPACITY) & (F.col("inside") == 1)).alias("own"), F.count_distinct("piece").alias("distinct"))
    n = tokenizer.token_counts(table(spark, d, "documents"), path=tokenizer_file())
    c, top = F.lit(packing.CAPACITY), F.col("top")
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("pieces") == top + 1) & (F.col("distinct") == top + 1) & (F.col("firsts") == c * top * (top + 1) / 2) & (F.col("fill") <= c) & (F.col("own") >= top)
    return n.join(pieces, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """(documents, tight): whether the containers are at most 1 % and one more than the tokens need at least."""
    packed = p9_containers(spark, d)
    n = packed.agg(F.count_distinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("container").alias("last"))
    return n.select("documents", (F.col("last") + 1 <= 1.01 * F.ceil(F.col("tokens") / packing.CAPACITY) + 1).alias("tight"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_distinct, p1_merged, p1_unions, p6_percentiles, p6_checked, p8_ids, p8_offsets, p8_decoded, p9_containers, p9_checked, p9_fill, p10_found)}

_JS = "(select strftime(timestamp at time zone 'UTC', '%Y-%m-%d') as day, name, app_id, nullif(distinct_id, '') as distinct_id, nullif(session_id, '') as session_id from js where type = 'event' and (distinct_id <> '' or session_id <> ''))"
_COUNTS = "count(distinct distinct_id) as distinct_id, count(distinct session_id) as session_id"
_UNION = {
    "first week": "day >= '2023-01-01' and day < '2023-01-08'",
    "second week": "day >= '2023-01-08' and day < '2023-01-15'",
    "built-in events": "starts_with(name, '$')",
    "own events": "not starts_with(name, '$')",
    "screens or page views on weekends": "name in ('$screen', '$pageview') and isodow(cast(day as date)) in (6, 7)",
    "half of the apps": "app_id < '8'",
}

SQL = {
    "p1_distinct": "select case when grp = '' then 'all' else grp end as grp, day, name, app_id, distinct_id, session_id from (select concat_ws(',', case when grouping(day) = 0 then 'day' end, case when grouping(name) = 0 then 'name' end, case when grouping(app_id) = 0 then 'app_id' end) as grp, day, name, app_id, "
    + f"{_COUNTS} from {_JS} group by grouping sets ((day), (name), (app_id), (day, name), (day, app_id), (name, app_id), (day, name, app_id), ()))",
    "p1_unions": " union all ".join(f"select '{k}' as grp, {_COUNTS} from {_JS} where {c} having count(*) > 0" for k, c in _UNION.items()),
    "p6_checked": "select op, http_status, count(*) as n, true as within from flutter where isfinite(duration_ms) group by all",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p9_checked": "select doc_id, true as whole from documents",
    "p9_fill": "select count(distinct doc_id) as documents, true as tight from documents",
}
SQL["p1_merged"] = SQL["p1_distinct"]
