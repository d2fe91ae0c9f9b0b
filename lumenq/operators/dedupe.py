"""Problem 7: messages delivered more than once.

One hash aggregation by identifier picks each message's first delivery with ``min_by``; Spark combines it on the
map side, so a message delivered a million times crosses the network once per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenq.functions.ids import packed_order
from lumenq.session import written


def first_deliveries(df: DataFrame, ident: Column, received: str = "received_at", key: str = "delivery_id", valid: Column | None = None) -> DataFrame:
    """(ident, first_key, copies): per identifier the key of its first row by (received, key).

    Rows whose identifier is null are not in the result; ``valid`` says the same by a cheaper test, if there is one,
    since the optimizer would compute ``ident`` twice, for the filter and for its value. A null ``received`` sorts last; ``key`` must be a
    non-null bigint, unique per delivery (rows that repeat a key are the same delivery).
    """
    rows = df.filter(ident.isNotNull() if valid is None else valid)
    rows = rows.select(ident.alias("ident"), F.col(key).alias("k"), packed_order(F.unix_micros(received), F.col(key)).alias("o"))
    return rows.groupBy("ident").agg(F.min_by("k", "o").alias("first_key"), F.count(F.lit(1)).alias("copies"))


def removed_deliveries(df: DataFrame, ident: Column, received: str = "received_at", key: str = "delivery_id", valid: Column | None = None) -> DataFrame:
    """(key) of every row with an identifier that is not the identifier's first delivery.

    The surplus rows are found by an anti-join on the delivery key, which is unique, and not on the identifier,
    of which one may hold a third of all rows: no task gets more than its share.
    """
    first = first_deliveries(df, ident, received, key, valid).select(F.col("first_key").alias(key))
    return df.filter(ident.isNotNull() if valid is None else valid).select(key).join(first, key, "left_anti")


BITS = 1 << 26  # of a filter: 8 MB, whatever is filtered
_BLOCK = 1 << 15  # bits of one of Spark's bitmaps


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(BITS))


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(block, bits): a filter of BITS bits, one for the hash of each key; at most BITS / 2^15 rows of 4 KB."""
    at = keys.select(_place(key).alias("p"))
    return at.groupBy(F.floor(F.col("p") / _BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(_BLOCK))).alias("bits"))


def keep_first(df: DataFrame, ident: Column, received: str = "received_at", key: str = "delivery_id", valid: Column | None = None) -> DataFrame:
    """``df`` with exactly one row per identifier: the first by (received, key); rows without identifier all stay.

    Keys of the removed rows are found first, from identifiers and keys alone, and written. Whole rows stay where they
    are if a bitmap of fixed size, sent to every task, says that their key is none of these; only the others, the removed
    ones and those that share a bit with one, are shuffled and joined with the keys. With very many keys the bitmap fills
    up and more rows take that way; the result is the same.

    ``key`` is a bigint, unique per delivery: of rows that repeat a key one stays. Columns may have any name and type. An
    empty table gives an empty table.
    """
    gone = written(removed_deliveries(df, ident, received, key, valid), "removed")
    again = written(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "repeated")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"), _place(key).alias("p"))
    rows = rows.join(F.broadcast(_bitmap(gone.union(again), key)), F.floor(F.col("p") / _BLOCK) == F.col("block"), "left")
    q = F.pmod("p", F.lit(_BLOCK)).cast("int")
    byte = F.conv(F.hex(F.substr("bits", F.floor(q / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, F.pmod(q, F.lit(8))) == 1, F.lit(False))
    maybe = rows.filter(hit).select("row", "k").join(gone.select(F.col(key).alias("k")), "k", "left_anti")
    if not again.isEmpty():
        maybe = maybe.dropDuplicates(["k"])
    return rows.filter(~hit).select("row.*").unionByName(maybe.select("row.*"))
