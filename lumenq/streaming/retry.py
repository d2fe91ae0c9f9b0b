"""Rows that could not be processed: parked for another attempt if the cause may pass, else dead letters."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, functions as F

BACKOFF_S = 30
ATTEMPTS = 5
# Parts of messages of causes that may pass.
PASSING = ("timed out", "timeout", "connection refused", "connection reset", "connection closed", "temporarily unavailable", "deadlock", "could not serialize")


def transient(error: BaseException) -> bool:
    """Whether the error, or one it came from, may pass by itself; what can't be decoded or analysed never does."""
    seen: BaseException | None = error
    while seen is not None:
        if isinstance(seen, (ConnectionError, TimeoutError)):
            return True
        if isinstance(seen, (AnalysisException, UnicodeError, ValueError)) and not isinstance(seen, PySparkException):
            return False
        if any(p in str(seen).lower() for p in PASSING):
            return True
        seen = seen.__cause__ or (None if seen.__suppress_context__ else seen.__context__)
    return False


def park(rows: DataFrame, reason: str, now_us: int) -> DataFrame:
    """(value, attempts, due_us, reason): ``rows`` (value, and attempts if they were parked before) due after a pause that
    doubles with each attempt."""
    n = (F.col("attempts") if "attempts" in rows.columns else F.lit(0)) + 1
    return rows.select("value", n.alias("attempts"), (F.lit(now_us) + F.pow(F.lit(2), n - 1).cast("bigint") * BACKOFF_S * 1_000_000).alias("due_us"), F.lit(reason).alias("reason"))


def due(parked: DataFrame, now_us: int, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(due, later, dead): dead are those due that have had all their attempts."""
    now = F.col("due_us") <= now_us
    over = F.col("attempts") >= attempts
    return parked.filter(now & ~over), parked.filter(~now), parked.filter(now & over)
