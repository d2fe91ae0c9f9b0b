"""Problem 9: filling containers of fixed capacity, by sum-of-squares packing.

N(h) is the number of open containers filled to h. An item of size s goes to the open level, or the new container,
that makes the sum of N(h)^2 smallest afterwards; full containers don't count. Most items are taken in mixed order,
the last fifth from the largest to the smallest.

What the rule needs to know of a corpus is how many items there are of each size, ``capacity`` numbers whatever the
corpus. So the packing is planned once for the whole corpus from these counts, and the items, numbered within their size
by a distributed rank, look their containers up in the plan. A plan has a fixed number of steps: of many items, bundles
of 2^k of one size are placed in 2^k containers at a time, then the rest of each size in smaller and smaller bundles,
down to single items, into the containers still open.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumenq.llm import tokenizer
from lumenq.session import written

CAPACITY = 2048
STEPS = 100_000  # placements of the largest bundles in a plan
RANGES = 4096  # parts in which the items of a size are numbered side by side


class Packer:
    """Open containers by level; ``place`` puts one item, or a bundle of them, where the sum of squares gets smallest."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.big = capacity, np.int64(1) << 40
        self.count = np.zeros(capacity + 1, np.int64)
        self.gain = np.ones(capacity + 1, np.int64)  # change of the sum when a level gains a container
        self.gain[capacity] = 0
        self.loss = np.full(capacity + 1, self.big)  # and when it loses one
        self.loss[0] = 0  # a new container
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _set(self, h: int) -> None:
        n = self.count[h]
        self.gain[h] = 2 * n + 1
        self.loss[h] = 1 - 2 * n if n else self.big

    def place(self, s: int, bundle: int = 1) -> int:
        """The container (of a bundle: the first of ``bundle`` in a row) of an item of size ``s``."""
        change = self.loss[: self.capacity - s + 1] + self.gain[s:]
        h = self.capacity - s - int(change[::-1].argmin())  # of equal changes the fullest container
        if h:
            b = self.at[h].pop()
            self.count[h] -= 1
            self._set(h)
        else:
            b, self.made = self.made, self.made + bundle
        t = h + s
        if t < self.capacity:
            self.at[t].append(b)
            self.count[t] += 1
            self._set(t)
        return b

    def halve(self, bundle: int) -> None:
        """Open bundles of ``bundle`` containers become twice as many of half the width."""
        for h, open_ in enumerate(self.at):
            if open_:
                self.at[h] = [x for b in open_ for x in (b + bundle // 2, b)]
                self.count[h] *= 2
                self._set(h)


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, for sizes in [0, capacity] in the order given; items of size 0 go to the first."""
    p = Packer(capacity)
    return np.array([p.place(s) if s else 0 for s in sizes.tolist()], np.int64)


@dataclass(frozen=True)
class Plan:
    """The items of a size with ranks from ``start`` to the next start lie in containers ``first`` + rank - start.

    Entries are sorted by (size, start); ``offset[s]`` is the first entry of size s. A plan has about STEPS entries
    for the widest bundles and, for each smaller power of two, at most a quarter of it and two a size: 7 MB for a billion
    items, 12 MB for 10^12.
    """

    offset: np.ndarray
    start: np.ndarray
    first: np.ndarray
    containers: int

    def lookup(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The containers of items; those of size 0 are in the first."""
        out = np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        s = size[order]
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else []
        for a, z in zip(cuts, np.r_[cuts[1:], len(s)] if len(s) else []):
            v = int(s[a])
            if v:
                low, high = self.offset[v], self.offset[v + 1]
                r = rank[order[a:z]]
                k = low + np.searchsorted(self.start[low:high], r, "right") - 1
                out[order[a:z]] = self.first[k] + r - self.start[k]
        return out


def _order(counts: Mapping[int, int], last: bool) -> list[int]:
    """Sizes as often as ``counts`` says: mixed, since the rule finds sizes that fill each other up when all of them come
    along; of single items the ``last`` fifth from the largest to the smallest, which closes what is still open."""
    sizes = np.repeat(np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))
    sizes = np.random.default_rng(len(sizes)).permutation(np.sort(sizes))
    k = len(sizes) * 4 // 5 if last else len(sizes)
    return [*sizes[:k].tolist(), *np.sort(sizes[k:])[::-1].tolist()]


def plan(counts: Mapping[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """The packing of ``counts[s]`` items of each size s in [1, capacity]."""
    left = {s: n for s, n in counts.items() if n and 0 < s < capacity}
    bundle = 1
    while sum(n // (2 * bundle) for n in left.values()) >= steps // 2:
        bundle *= 2
    p, widest = Packer(capacity), bundle
    found: dict[int, list[tuple[int, int]]] = {s: [] for s in left}
    placed = dict.fromkeys(left, 0)
    while bundle:
        share = 0.8 if bundle == widest else 0.5  # the rest goes in smaller bundles
        for s in _order({s: int((n - placed[s]) * (share if bundle > 1 else 1)) // bundle for s, n in left.items()}, bundle == 1):
            found[s].append((placed[s], p.place(s, bundle)))
            placed[s] += bundle
        if bundle > 1:
            p.halve(bundle)
        bundle //= 2
    whole = counts.get(capacity, 0)
    if whole:  # full ones, one after another
        found[capacity] = [(0, p.made)]
    sizes = [len(found.get(s, ())) for s in range(capacity + 1)]
    flat = [x for s in range(capacity + 1) for x in found.get(s, ())]
    return Plan(np.r_[0, np.cumsum(sizes)], np.array([a for a, _ in flat], np.int64), np.array([b for _, b in flat], np.int64), p.made + whole)


def _assign(planned: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = planned.lookup(b.column("n").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("k", "piece", "first", "n")] + [pa.array(at, pa.int64())], names=["k", "piece", "first", "n", "container"])

    return run


def pack_items(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """(key, piece, first_token, n_tokens, container): every item once, in one container.

    Only items larger than ``capacity`` are divided, into full containers and one rest, numbered by ``piece``. Items
    of size 0 or null lie in the first container and take no room. ``key`` is a bigint, unique for an exact account; rows that
    repeat a key are items of their own. An empty table gives an empty table; other columns are not read.

    Keys and sizes are written once, so that counts and ranks are of the same items whatever is computed again. A size
    that a third of all items have is numbered in ``RANGES`` parts.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    sized = written(df.select(F.col(key).alias("k"), n.alias("whole")), "sizes")
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("whole") - 1) / capacity), F.lit(0)).cast("bigint"))
    items = sized.select("k", "whole", F.explode(pieces).alias("piece"))
    items = items.select("k", "piece", (F.col("piece") * capacity).alias("first"), F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).alias("n"), F.pmod(F.xxhash64("k", "piece"), F.lit(RANGES)).alias("part"))
    of_part = items.groupBy("n", "part").agg(F.count(F.lit(1)).alias("c"))
    counts = {r["n"]: r["c"] for r in of_part.groupBy("n").agg(F.sum("c").alias("c")).toArrow().to_pylist()}  # a row a size
    before = F.sum("c").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = of_part.select("n", "part", F.coalesce(before, F.lit(0)).alias("before"))
    w = Window.partitionBy("n", "part").orderBy("k", "piece")
    ranked = items.withColumn("own", F.row_number().over(w) - 1).join(starts, ["n", "part"]).withColumn("rank", F.col("before") + F.col("own"))
    out = ranked.select("k", "piece", "first", "n", "rank").mapInArrow(_assign(plan(counts, capacity, steps)), "k bigint, piece bigint, first bigint, n bigint, container bigint")
    return out.select(F.col("k").alias(key), "piece", F.col("first").alias("first_token"), F.col("n").alias("n_tokens"), "container")


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``pack_items`` of texts by their number of tokens; null and empty texts have 0."""
    return pack_items(tokenizer.token_counts(df, key, text, path), key, "n_tokens", capacity)
