"""CSV: guarded export, and store reports (gzip, UTF-16LE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    s = c.cast("string")
    return F.when(s.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def write(df: DataFrame, path: str) -> None:
    """One CSV part per task, quoted where needed (quotes doubled), strings guarded, nulls empty."""
    cols = [guarded(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*cols).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def store_report(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """A store's report; .gz files are unpacked by their name, rows that don't fit the schema come out null."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", encoding.upper().startswith("UTF-16")).option("mode", "PERMISSIVE").csv(path)


def daily_metrics(reports: DataFrame) -> DataFrame:
    """(app_id, store, day, installs, uninstalls); a missing day is missing, not 0. A later report of a day replaces it."""
    last = F.max_by(F.struct("installs", "uninstalls"), "reported_at")
    return reports.groupBy("app_id", "store", "day").agg(last.alias("x")).select("app_id", "store", "day", "x.installs", "x.uninstalls")
