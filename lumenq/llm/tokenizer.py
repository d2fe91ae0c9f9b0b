"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer.

Pre-tokenisation runs over arrays of code points, without a regular expression: each code point has a class, classes
become symbols of a small automaton, and the automaton's transition functions are composed by an associative scan
(blocks first, then block prefixes, then a replay of each block from its known state). The slices between the
boundaries feed a cache of merged pairs; the slices not yet in it are merged together, round by round, as arrays.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKENIZERS = "/opt/tokenizers"
CHUNK = 1_000_000  # code points taken through the arrays at once
CACHE = 400_000  # slices kept per worker

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE = range(6)
# symbols: a class with the lookahead that the boundary rules need; +N_SYM at the start of a text
S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_BLANK_LAST, S_RUN, S_SHORT, S_LONG, S_PAD = range(9)
N_SYM = 9
# states: what the text before a position ends with
Q_START, Q_LETTER, Q_NUMBER, Q_OTHER, Q_PENDING, Q_RUN, Q_ONE, Q_TWO, Q_ENDED = range(9)
N_STATE = 9


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, from its Unicode properties."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary before) by symbol and state."""
    nxt, cut = np.zeros((2 * N_SYM, N_STATE), np.uint8), np.zeros((2 * N_SYM, N_STATE), bool)
    joins = {S_LETTER: (Q_LETTER, {Q_LETTER, Q_PENDING}), S_NUMBER: (Q_NUMBER, {Q_NUMBER, Q_PENDING}), S_OTHER: (Q_OTHER, {Q_OTHER, Q_PENDING}), S_SPACE_LAST: (Q_PENDING, set()), S_BLANK_LAST: (Q_RUN, set()), S_RUN: (Q_RUN, {Q_RUN})}
    for q in range(N_STATE):
        for s, (to, with_) in joins.items():
            nxt[s, q], cut[s, q] = to, q not in with_
        for s, to in ((S_SHORT, Q_ONE), (S_LONG, Q_TWO)):  # an apostrophe that may open a contraction, at a slice's start only
            inside = q in (Q_OTHER, Q_PENDING)
            nxt[s, q], cut[s, q] = (Q_OTHER, False) if inside else (to, True)
        nxt[S_PAD, q] = q
    nxt[S_LETTER, Q_TWO], cut[S_LETTER, Q_TWO] = Q_ONE, False
    nxt[S_LETTER, Q_ONE], cut[S_LETTER, Q_ONE] = Q_ENDED, False
    for s in range(N_SYM):  # at a text's start the state before doesn't matter
        nxt[s + N_SYM], cut[s + N_SYM] = nxt[s, Q_START], True
    return nxt, cut


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points; ``first`` marks the first of each text."""
    n = len(points)
    kind = classes()[points]
    ahead = np.full(n + 2, -1, np.int64)
    ahead[:n] = points
    ends = np.ones(n + 2, bool)  # a text ends before this position
    ends[:n] = first
    one = np.where(ends[1 : n + 1], -1, ahead[1 : n + 1])
    two = np.where(ends[1 : n + 1] | ends[2 : n + 2], -1, ahead[2 : n + 2])
    sym = np.choose(kind, [S_OTHER, S_LETTER, S_NUMBER, S_RUN, S_RUN, S_OTHER]).astype(np.uint8)
    space = (kind == SPACE) | (kind == BLANK)
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= one >= 0  # spaces at a text's end stay together
    sym[last & (kind == SPACE)] = S_SPACE_LAST
    sym[last & (kind == BLANK)] = S_BLANK_LAST
    at = np.flatnonzero(kind == QUOTE)
    a, b = one[at], two[at]
    c = ord
    sym[at[np.isin(a, [c("s"), c("t"), c("m"), c("d")])]] = S_SHORT
    sym[at[((a == c("r")) & (b == c("e"))) | ((a == c("v")) & (b == c("e"))) | ((a == c("l")) & (b == c("l")))]] = S_LONG
    return sym + first.astype(np.uint8) * N_SYM


def scan(sym: np.ndarray, block: int = 256) -> np.ndarray:
    """Boundary before each position. Function composition is associative, so blocks are composed side by side."""
    n = len(sym)
    nxt, cut = automaton()
    rows = -(-n // block)
    grid = np.full(rows * block, S_PAD, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # position in the block first
    flat = nxt.reshape(-1).astype(np.intp)
    base = grid.astype(np.intp) * N_STATE
    f = np.broadcast_to(np.arange(N_STATE), (rows, N_STATE))
    for j in range(block):  # each block's function, from state before to state after
        f = flat[base[j][:, None] + f]
    step = 1
    while step < rows:  # inclusive prefixes of the block functions by doubling
        f = np.concatenate([f[:step], np.take_along_axis(f[step:], f[:-step], axis=1)])
        step *= 2
    state = np.zeros(rows, np.intp)
    state[1:] = f[:-1, Q_START]
    out, cuts = np.zeros((block, rows), bool), cut.reshape(-1)
    for j in range(block):
        at = base[j] + state
        out[j] = cuts[at]
        state = flat[at]
    return out.T.reshape(-1)[:n]


class Merger:
    """Pair merging with a bounded cache of slices, for one vocabulary file of merges."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # the printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 up
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        self.width = max(vocab.values()) + 1
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made
        self.length = np.zeros(self.width, np.int64)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self.limit = cache
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.lens, self.pool, self.used = [], [], [], 0
        self._arrays = None

    NONE = 1 << 40

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.rank[i], self.NONE)

    def merge(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of all slices: in each round every slice merges its pair of lowest rank, wherever it stands."""
        ids = self.byte_id[np.frombuffer(b"".join(slices), np.uint8)]
        lens = np.fromiter(map(len, slices), np.int64, len(slices))
        seg = np.repeat(np.arange(len(slices)), lens)
        done_ids, done_seg = [], []
        rank = np.full(len(ids), self.NONE)
        if len(ids) > 1:
            rank[:-1] = np.where(seg[:-1] == seg[1:], self.ranks(ids[:-1], ids[1:]), self.NONE)
        while len(ids):
            heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            low = np.minimum.reduceat(rank, heads)
            count = np.diff(np.r_[heads, len(ids)])
            ended = np.repeat(low == self.NONE, count)
            if ended.any():
                done_ids.append(ids[ended])
                done_seg.append(seg[ended])
                keep = ~ended
                ids, seg, rank = ids[keep], seg[keep], rank[keep]
                low, count = low[low != self.NONE], count[low != self.NONE]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, count)
            p = np.flatnonzero(hit)
            # of a run of overlapping pairs (aaa) every other one merges, from the left
            run = np.r_[True, np.diff(p) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(p)), 0))
            p = p[(np.arange(len(p)) - first) % 2 == 0]
            ids[p] = self.made[rank[p]]
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            now = np.cumsum(keep)[p] - 1
            ids, seg, rank = ids[keep], seg[keep], rank[keep]
            for q in (now, now[now > 0] - 1):
                ends = q == len(ids) - 1
                q, z = q[~ends], q[ends]
                rank[q] = np.where(seg[q] == seg[q + 1], self.ranks(ids[q], ids[q + 1]), self.NONE)
                rank[z] = self.NONE
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(slices), np.int64)
        all_seg = np.concatenate(done_seg)
        order = np.argsort(all_seg, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(all_seg, minlength=len(slices))

    def learn(self, slices: list[str]) -> None:
        new = list(dict.fromkeys(s for s in slices if s not in self.at))
        if len(self.at) + len(new) > self.limit:
            self.clear()
            new = list(dict.fromkeys(slices))
        if not new:
            return
        ids, lens = self.merge([s.encode() for s in new])
        base = len(self.at)
        self.at.update((s, base + i) for i, s in enumerate(new))
        self.starts.append(self.used + np.cumsum(lens) - lens)
        self.lens.append(lens)
        self.pool.append(ids.astype(np.int32))
        self.used += len(ids)
        self._arrays = None

    def lookup(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices one after another, ids per slice)."""
        if not slices:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.learn(slices)
        if self._arrays is None:
            self.starts, self.lens, self.pool = ([np.concatenate(x)] for x in (self.starts, self.lens, self.pool))
            self._arrays = self.starts[0], self.lens[0], self.pool[0]
        starts, lens, pool = self._arrays
        i = np.fromiter(map(self.at.__getitem__, slices), np.int64, len(slices))
        n = lens[i]
        offset = np.repeat(starts[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return pool[offset], n

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[int(i)] for i in ids).decode("utf-8", errors="replace")


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    return os.path.join(folder, f"{name}.json")


def pretokenize(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(texts joined, slice starts in it with the final end, index of each non-empty text's first slice by text).

    Third: for each text the number of slices before it (length texts + 1).
    """
    whole = "".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.r_[0, np.cumsum(lens)]
    if not len(whole):
        return whole, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[begin[:-1][lens > 0]] = True
    starts = np.flatnonzero(scan(symbols(points, first)))
    return whole, np.r_[starts, len(points)], np.searchsorted(starts, begin)


def encode(texts: list[str], m: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids before each text, slice starts within their text, ids of each slice, slices before each text)."""
    whole, at, before = pretokenize(texts)
    bounds = at.tolist()
    slices = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
    ids, n = m.lookup(slices)
    total = np.r_[0, np.cumsum(n)]
    text_of = np.repeat(np.arange(len(texts)), np.diff(before))
    begin = np.r_[0, np.cumsum([len(t) for t in texts])]
    return ids, total[before], at[:-1] - begin[text_of] if len(slices) else at[:0], n, before


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` code points; a longer text is a range of its own, whole."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def shipped(spark: SparkSession, path: str) -> str:
    """The vocabulary sent along with the job, so that executors need no copy of their own; returns its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _encoder(name: str, want: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(SparkFiles.get(name))
        for b in batches:
            keys = b.column(0)
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in chunks(texts):
                ids, before, starts, n, slices = encode(texts[a:z], m)
                key = keys.slice(a, z - a)
                if want == "count":
                    cols = [key, pa.array(np.diff(before), pa.int64())]
                elif want == "ids":
                    cols = [key, pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids, pa.int32()))]
                else:
                    cols = [key, pa.ListArray.from_arrays(pa.array(slices, pa.int32()), pa.array(starts, pa.int32())), pa.ListArray.from_arrays(pa.array(slices, pa.int32()), pa.array(n, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    return run


def _map(df: DataFrame, key: str, text: str, path: str, want: str, cols: list[tuple[str, str]]) -> DataFrame:
    rows = df.select(F.col(key).alias("c0"), F.col(text).alias("c1"))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(_encoder(shipped(df.sparkSession, path), want), ", ".join([f"c0 {kind}", *(f"c{i + 1} {t}" for i, (_, t) in enumerate(cols))]))
    return out.select(F.col("c0").alias(key), *[F.col(f"c{i + 1}").alias(n) for i, (n, _) in enumerate(cols)])


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens; the empty list for empty and null texts.

    One output row per input row: repeated rows and null keys stay. Texts are encoded whole, whatever their length.
    An empty table gives an empty table; other columns are not read.
    """
    return _map(df, key, text, path or vocabulary(), "ids", [("ids", "array<int>")])


def decoded(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text of each row's ids; the empty text for null and empty lists."""
    name = shipped(df.sparkSession, path or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(SparkFiles.get(name))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["c0", "text"])

    rows = df.select(F.col(key).alias("c0"), F.col(ids).alias("c1"))
    return rows.mapInArrow(run, f"c0 {rows.schema[0].dataType.simpleString()}, text string").withColumnRenamed("c0", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): 0 for empty and null texts."""
    return _map(df, key, text, path or vocabulary(), "count", [("n_tokens", "bigint")])


def token_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, starts, n_ids): of each pre-token its first code point in the text and its number of ids.

    With the ids this leads from any id back to its place in the text.
    """
    return _map(df, key, text, path or vocabulary(), "offsets", [("starts", "array<int>"), ("n_ids", "array<int>")])
