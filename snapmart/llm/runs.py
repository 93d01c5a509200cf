"""Periodic runs of words: stretches that repeat one root at least so many times.

For a stretch of text the suffix trees of its words and of their reversal are built online. A tour
of a tree visits the leaves in order; the depth at which it turns between two neighbouring leaves
is what their suffixes share, so the least such depth between any two leaves, from a table of
minima, is their longest common extension in constant time. The order of the leaves gives the
longest Lyndon word at every position, for the order of words and for its opposite. Every run has
such a Lyndon word as its root, so each of them is a candidate that is extended to both sides.

Trees are built where a run can lie: inside of a run every triple of words, but for the first, has
occurred no further back than the period, so stretches of triples that recur within a distance,
long enough for that distance, bound all runs. No run is lost, prose without repeats costs a sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmart.llm.words import shingles, word_hashes

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


class SuffixTree:
    """Suffix tree of numbers from 1 up, closed by a 0 that occurs nowhere else.

    ``order`` holds the suffixes in ascending order, ``opposite`` in the order of the reversed
    alphabet; in both a suffix comes before those that it begins.
    """

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.size, self.width = len(s), max(s) + 1
        self._grow(s)
        self._children()
        self.order, turns = self._tour(self.ascending)
        self.rank = np.empty(self.size, np.int64)
        self.rank[self.order] = np.arange(self.size)
        self.minima = [np.array(turns, np.int32)]
        width = 1
        while 2 * width <= self.size:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _grow(self, s: list[int]) -> None:
        """Left to right: each new symbol extends all leaves at once; the active point walks over
        the suffixes that are not leaves yet, along suffix links."""
        n, width = len(s), self.width
        child: dict[int, int] = {}
        start, end, link = [0], [0], [0]
        node = edge = length = open_suffixes = 0
        for i, c in enumerate(s):
            open_suffixes += 1
            unlinked = 0
            while open_suffixes:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = start[below]
                    reach = end[below] - first
                    if length >= reach:
                        node, edge, length = below, edge + reach, length - reach
                        continue
                    if s[first + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    child[middle * width + c] = middle + 1
                    child[middle * width + s[first + length]] = below
                    start += [first, i]
                    end += [first + length, n]
                    link += [0, 0]
                    start[below] = first + length
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        self.start, self.end, self.child = start, end, child

    def _children(self) -> None:
        """Children of each node in both orders, as slices of one list."""
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        below = np.fromiter(self.child.values(), np.int64, len(self.child))
        parent, symbol = np.divmod(keys, self.width)
        up = np.lexsort((symbol, parent))
        down = np.lexsort((np.where(symbol == 0, -self.width, -symbol), parent))
        self.first = np.searchsorted(parent[up], np.arange(len(self.start) + 1)).tolist()
        self.ascending, self.descending = below[up].tolist(), below[down].tolist()
        self.child = {}

    def _tour(self, children: list[int]) -> tuple[np.ndarray, list[int]]:
        """Suffixes in the order of their leaves, and the depth of the turn before each leaf."""
        first, start, end, n = self.first, self.start, self.end, self.size
        order, turns, turn = [], [], 0
        stack, depths, came = [0], [0], [0]
        while stack:
            node, depth, back = stack.pop(), depths.pop(), came.pop()
            if back >= 0:
                turn = back
            a, b = first[node], first[node + 1]
            if a == b:
                order.append(n - depth)
                turns.append(turn)
                continue
            for below in children[b - 1:a:-1]:
                stack.append(below)
                depths.append(depth + end[below] - start[below])
                came.append(depth)
            below = children[a]
            stack.append(below)
            depths.append(depth + end[below] - start[below])
            came.append(-1)
        return np.array(order, np.int64), turns

    def opposite(self) -> np.ndarray:
        rank = np.empty(self.size, np.int64)
        rank[self._tour(self.descending)[0]] = np.arange(self.size)
        return rank

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j (unequal places) share."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out


def _lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position: up to the next smaller suffix."""
    ranks, out, waiting = rank.tolist(), [0] * len(rank), []
    for i, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            j = waiting.pop()
            out[j] = i - j
        waiting.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the maximal runs of at least ``least`` symbols and ``times`` periods."""
    n = len(symbols)
    if n < least:
        return []
    coded = (np.unique(symbols, return_inverse=True)[1].ravel() + 1).tolist()
    tree = SuffixTree(coded)
    places, roots = [], []
    for rank in (tree.rank, tree.opposite()):
        root = _lyndon(rank)[:-1]
        at = np.flatnonzero((root > 0) & (root * times <= n))
        places.append(at)
        roots.append(root[at])
    i, p = np.concatenate(places), np.concatenate(roots)
    if not len(i):
        return []
    right = tree.extension(i, i + p)
    longest = right + p
    del tree
    back = SuffixTree(coded[::-1])
    left = np.zeros(len(i), np.int64)
    inner = i > 0
    left[inner] = back.extension(n - i[inner], n - i[inner] - p[inner])
    start, end = i - left, i + longest
    keep = (end - start >= times * p) & (end - start >= least)
    return sorted(set(zip(start[keep].tolist(), end[keep].tolist(), p[keep].tolist(), strict=True)))


def _windows(words: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Stretches that together hold every run, with a word to spare on either side."""
    n, triples = len(words), shingles(words, 3)
    order = np.argsort(triples, kind="stable")
    again = np.flatnonzero(triples[order[1:]] == triples[order[:-1]])
    later, earlier = order[again + 1], order[again]
    back = np.full(len(triples) + 2, n, np.int64)  # distance back to the same triple; fences around
    back[later + 1] = later - earlier
    found, far = [], 1
    while far * times < 2 * n and len(later):
        period = far // 2 + 1  # the smallest period of this round; the largest is ``far``
        edges = np.flatnonzero(np.diff((back <= far).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        long = last - first >= max(least - min(far, least), (times - 1) * period) - 2
        found += [(max(0, a - far - 1), min(n, b + 3)) for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True)]
        far *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def word_runs(words: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in a sequence of word hashes."""
    n, out = len(words), []
    if n < least:
        return out
    for a, b in _windows(words, times, least):
        for start, end, period in runs_of(words[a:b], times, least):
            # a stretch that an inner edge cuts is not a whole run
            if (start or not a) and (b == n or end < b - a):
                out.append((start + a, end + a, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _found(times: int, least: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf.text:
                words = (text or b"").split()  # bytes part at 0x20 and 0x09 to 0x0D
                runs = word_runs(word_hashes(text, lower=False), times, least)
                step = np.zeros(len(words) + 1, np.int64)
                for start, end, period in runs:
                    step[start + period] += 1
                    step[end] -= 1
                kept = words
                if runs:
                    kept = [w for w, inside in zip(words, np.cumsum(step)[:-1], strict=True) if not inside]
                rows.append((len(words), [{"start": a, "length": b - a, "period": p} for a, b, p in runs], b" ".join(kept)))
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "n_words": [r[0] for r in rows], "runs": [r[1] for r in rows],
                "collapsed": [r[2] for r in rows],
            })

    return run


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of ``docs(doc_id, text)``.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D, compared by 64-bit hashes. ``runs``
    (start, length, period, by start, then period) are the stretches with smallest period q, of at
    least ``least`` words and ``times`` q, that no neighbouring word continues. ``collapsed`` is
    the text with one copy of each root left, words parted by single spaces. Null and empty texts
    have no words and no runs; a text of any length is searched whole, in one task, in memory that
    grows with its periodic stretches. Rows that repeat an id are each answered; an empty table
    gives no rows, extra columns are not read.
    """
    if times < 2 or least < 6:
        raise ValueError("runs of under two periods or six words are not looked for")
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInPandas(
        _found(times, least), SCHEMA)
    return found.withColumn("collapsed", F.decode("collapsed", "UTF-8"))


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with planted runs: in every tenth document (by crc32 of its id) the words from some
    place on repeat. Rows without an id or without words stay as they are."""
    mixed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.withColumn("_h", mixed).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    placed = words.withColumns({"_n": F.size("_words").cast("long"), "_g": F.floor(F.col("_h") / 10)}).withColumn(
        "_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))
    ).withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)))
    index = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)
    tail = F.array_join(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", index(i).cast("int"))), " ")
    return placed.withColumn("text", F.when(F.col("_n") > 0, tail).otherwise(F.col("text"))).select(*[f"`{c}`" for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """One row of numbers and digests for each row of :func:`periodic_runs`."""
    longest = F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))
    best = F.get(longest, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
