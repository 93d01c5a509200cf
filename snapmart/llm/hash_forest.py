"""Nearest neighbours by inner product from a forest of sorted hash strings.

Each tree gives every vector a string of bits, one random hyperplane a bit, and keeps the strings
in order, so the vectors that share a prefix with a query lie side by side. A search descends to
the longest match in every tree, then ascends in all trees at once, one bit at a time, until the
prefixes hold enough candidates; all of them are scored exactly. How many are enough is measured:
a bounded sample of queries is searched exactly, and the least budget that finds ``target`` of
their neighbours is taken.

Trees are stored as ranges of their order. A range ends only where both halves hold the whole
budget, so no search has to leave the range that it descends to; a range that is still too large
(near copies, or data without any structure) is dealt out in blocks that every query of it visits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from snapmart.llm.shared import stored
from snapmart.llm.words import mix


@dataclass(frozen=True)
class Search:
    """``k`` neighbours, ``trees`` of ``bits``-bit strings (60 at most), ``sample`` queries searched
    exactly for the budget, ``target`` share of their neighbours found, ``least`` candidates at
    least, blocks of ``points`` and ``queries``."""

    k: int = 20
    trees: int = 16
    bits: int = 48
    sample: int = 200
    target: float = 0.95
    least: int = 512
    points: int = 1 << 16
    queries: int = 1 << 13
    seed: int = 11


class Planes:
    """Random hyperplanes through the middle of the vectors.

    Inner products become distances by one more coordinate, which lifts every vector to the
    greatest norm; queries are scaled to that norm and get 0.
    """

    def __init__(self, search: Search, norm: float, mean: np.ndarray):
        random = np.random.Generator(np.random.PCG64(search.seed))
        self.trees, self.bits, self.norm = search.trees, search.bits, norm
        self.normals = random.standard_normal((search.trees * search.bits, len(mean)))
        self.offsets = self.normals @ mean
        self.powers = 2.0 ** np.arange(search.bits - 1, -1, -1)

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Bit strings as integers: a row for each tree."""
        out = np.empty((self.trees, len(x)), np.int64)
        for i in range(0, len(x), 4096):
            part = lifted(x[i:i + 4096], self.norm, query)
            bit = (part @ self.normals.T > self.offsets).reshape(len(part), self.trees, self.bits)
            out[:, i:i + 4096] = (bit @ self.powers).T.astype(np.int64)
        return out


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    own = np.sqrt((x * x).sum(1))
    if query:
        return np.hstack([x * (norm / own)[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - own * own, 0))[:, None]])


def matrix(column: pd.Series) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return np.stack(column.to_numpy()).astype(np.float64)


def _ranges(order: np.ndarray, keys: np.ndarray, level, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of a sorted array lie that share ``level`` bits with each key."""
    free = np.int64(bits) - level
    low = (keys >> free) << free
    return np.searchsorted(order, low), np.searchsorted(order, low + (np.int64(1) << free))


def _shared_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return bits - np.frexp((a ^ b).astype(np.float64))[1]


def _exactly(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed in one fixed order."""
    return (x * y).sum(1)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its ``k`` nearest rows, ties to the smaller id."""
    out = []
    for i in range(0, len(q), max(1, (1 << 22) // max(len(x), 1))):
        part = q[i:i + max(1, (1 << 22) // max(len(x), 1))]
        rough = part @ x.T
        last = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(part), -np.inf)
        slack = 1e-12 * (1 + np.abs(last)) * np.sqrt((part * part).sum(1)).clip(1)
        for row, least, one in zip(rough, last - np.where(np.isfinite(last), slack, 0), part, strict=True):
            near = np.flatnonzero(row >= least)
            score = _exactly(x[near], one[None, :])
            order = np.lexsort((ids[near], -score))[:k]
            out.append((near[order], score[order]))
    return out


# ---- usable vectors --------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Left out: rows without an id, vectors that are null, empty, zero or hold a null or non-finite
    component, and vectors of another length than most have. An id names one row: of several
    with one id the least vector is taken.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite)
        & F.exists("vector", lambda v: v != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    dims = usual[0]["dims"] if usual else 1
    return rows.filter(F.size("vector") == dims).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _middle(points: DataFrame) -> tuple[int, float, np.ndarray]:
    """Rows, greatest norm, mean of the lifted vectors (rounded, so that every run has the same)."""
    norm = points.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)))).first()[0]
    if norm is None:
        return 0, 1.0, np.zeros(2)

    def sums(batches):
        for pdf in batches:
            total = lifted(matrix(pdf.vector), norm, False).sum(0)
            yield pd.DataFrame({"place": np.arange(len(total)), "total": total, "n": len(pdf)})

    found = points.select("vector").mapInPandas(sums, "place int, total double, n long").groupBy("place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    ).orderBy("place").collect()
    n = found[0]["n"]
    return n, norm, np.round([r["total"] / n for r in found], 6)


# ---- how many candidates are enough ----------------------------------------------------------


def budget(points: DataFrame, queries: DataFrame, planes: Planes, search: Search) -> int:
    """The least number of candidates with which the sampled queries find their neighbours.

    The sample, ``search.sample`` queries in the order of a hash of their id, is compared with
    every point. A neighbour is found where it shares enough bits with the query in some tree.
    """
    picked = queries.orderBy(F.xxhash64("query"), "query").limit(search.sample).toPandas()
    if not len(picked):
        return search.least
    q, ids, bits, k = matrix(picked.vector), picked["query"].to_numpy(), search.bits, search.k
    q_keys = planes.keys(q, True)
    levels = np.arange(bits + 1)

    def compared(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, own = matrix(pdf.vector), pdf.vec_id.to_numpy()
            keys, held = planes.keys(x, False), np.zeros((len(q), bits + 1), np.int64)
            for t in range(planes.trees):
                order = np.sort(keys[t])
                low, high = _ranges(order, q_keys[t][:, None], levels[None, :], bits)
                held += high - low
            yield pd.DataFrame({
                "row": np.repeat(np.arange(len(q)), bits + 1), "level": np.tile(levels, len(q)), "held": held.ravel(),
                "vec_id": -1, "score": 0.0,
            })
            for i, (near, score) in enumerate(_best(q, x, own, k + 1)):
                shared = _shared_bits(keys[:, near], q_keys[:, i][:, None], bits).max(0)
                other = own[near] != ids[i]
                yield pd.DataFrame({"row": i, "level": shared[other], "held": 0, "vec_id": own[near][other], "score": score[other]})

    rows = stored(points.mapInPandas(compared, "row int, level int, held long, vec_id long, score double"))
    sums = rows.filter("held > 0").groupBy("row", "level").agg(F.sum("held").alias("held")).toPandas()
    nearest = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    true = rows.filter("held = 0 and score is not null and vec_id >= 0").withColumn(
        "rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).toPandas()
    held = np.zeros((len(q), bits + 1), np.int64)
    held[sums.row, sums.level] = sums.held
    enough = int(held[:, 0].max())
    size = search.least
    while size < enough:
        stop = (held >= size).sum(1) - 1  # counts never grow with the level
        found = true.level.to_numpy() >= stop[true.row.to_numpy()]
        if not len(found) or found.mean() >= search.target:
            return size
        size = size * 5 // 4
    return enough


# ---- ranges of each tree ---------------------------------------------------------------------


@dataclass
class Layout:
    """Per tree the first key of each range and its number of point and query blocks; groups of
    work are numbered through."""

    starts: list[np.ndarray]
    points: list[np.ndarray]
    queries: list[np.ndarray]
    first: list[np.ndarray]


def layout(points: DataFrame, queries: DataFrame, planes: Planes, search: Search, size: int, step: int = 6) -> Layout:
    """Cut every tree's order into ranges: (first key, depth) -> rows, halved while both halves keep
    ``size`` points. There are at most ``trees * points / size`` ranges."""
    bits = search.bits
    total = points.count(), queries.count()
    done: list[tuple[int, int, int, int]] = []  # tree, first key, points, queries
    active = {(t, 0): total for t in range(search.trees)}
    for depth in range(0, bits, step):
        small = {cell: n for cell, n in active.items() if n[0] <= search.points or n[0] < 2 * size}
        done += [(t, start << (bits - depth), *n) for (t, start), n in small.items()]
        active = {cell: n for cell, n in active.items() if cell not in small}
        if not active:
            break
        now = min(depth + step, bits)
        cells = {t: np.array(sorted(c for tree, c in active if tree == t), np.int64) for t in range(search.trees)}

        def counted(is_query: bool, depth=depth, now=now, cells=cells):
            def run(batches):
                for pdf in batches:
                    keys = planes.keys(matrix(pdf.vector), is_query) if len(pdf) else np.zeros((planes.trees, 0), np.int64)
                    for t in range(planes.trees):
                        inside = keys[t][np.isin(keys[t] >> (bits - depth), cells[t])] >> (bits - now)
                        cell, n = np.unique(inside, return_counts=True)
                        yield pd.DataFrame({"tree": t, "cell": cell, "p": 0 if is_query else n, "q": n if is_query else 0})
            return run

        schema = "tree int, cell long, p long, q long"
        found = points.mapInPandas(counted(False), schema).union(queries.mapInPandas(counted(True), schema)).groupBy(
            "tree", "cell").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()
        counts = {(r["tree"], r["cell"]): (r["p"], r["q"]) for r in found}
        held = {now: counts}
        for d in range(now - 1, depth, -1):
            up: dict[tuple[int, int], tuple[int, int]] = {}
            for (t, c), (p, q) in held[d + 1].items():
                a, b = up.get((t, c >> 1), (0, 0))
                up[t, c >> 1] = a + p, b + q
            held[d] = up
        held[depth] = active
        after: dict[tuple[int, int], tuple[int, int]] = {}
        waiting = [(depth, t, c) for t, c in active]
        while waiting:
            d, t, c = waiting.pop()
            n = held[d][t, c]
            halves = [held[d + 1].get((t, 2 * c + i), (0, 0)) for i in (0, 1)] if d < now else []
            if d == now:
                after[t, c] = n
            elif n[0] > search.points and min(h[0] for h in halves) >= size:
                waiting += [(d + 1, t, 2 * c), (d + 1, t, 2 * c + 1)]
            else:
                done.append((t, c << (bits - d), *n))
        active = after
    done += [(t, start, *n) for (t, start), n in active.items()]
    out, first = Layout([], [], [], []), 0
    for t in range(search.trees):
        mine = sorted(x[1:] for x in done if x[0] == t)
        out.starts.append(np.array([x[0] for x in mine], np.int64))
        out.points.append(np.array([max(1, -(-x[1] // search.points)) for x in mine], np.int64))
        out.queries.append(np.array([max(1, -(-x[2] // search.queries)) for x in mine], np.int64))
        each = out.points[-1] * out.queries[-1]
        out.first.append(first + np.cumsum(each) - each)
        first += int(each.sum())
    return out


def _dealt(planes: Planes, plan: Layout, is_query: bool, vectors: bool):
    """Rows of (group, key, id, level, vector) for each tree and block that a row belongs to."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf.vector)
            raw = np.array([v.tobytes() for v in x], object) if vectors else None
            ids = (pdf["query"] if is_query else pdf.vec_id).to_numpy()
            level = pdf["level"].to_numpy() if is_query and vectors else np.full(len(ids), -1)
            mixed = mix(ids.astype(np.uint64))
            for t, keys in enumerate(planes.keys(x, is_query)):
                leaf = np.searchsorted(plan.starts[t], keys, "right") - 1
                rows, columns = plan.points[t][leaf], plan.queries[t][leaf]
                copies = rows if is_query else columns
                block = (mixed % (columns if is_query else rows).astype(np.uint64)).astype(np.int64)
                which = np.repeat(np.arange(len(ids)), copies)
                copy = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, column = (copy, block[which]) if is_query else (block[which], copy)
                out = {"grp": plan.first[t][leaf][which] + row * columns[which] + column, "key": keys[which],
                       "id": ids[which], "level": level[which] if is_query else -1, "is_query": is_query}
                yield pd.DataFrame(out | ({"vector": raw[which]} if vectors else {}))
    return run


def _level_counts(bits: int):
    names = [f"c{level}" for level in range(bits + 1)]

    def run(pdf):
        points, asks = pdf[~pdf.is_query], pdf[pdf.is_query]
        low, high = _ranges(np.sort(points.key.to_numpy()), asks.key.to_numpy()[:, None], np.arange(bits + 1)[None, :], bits)
        return pd.DataFrame(dict(zip(names, (high - low).T, strict=True)) | {"query": asks.id.to_numpy()})[["query", *names]]

    return run


def _candidates(bits: int, k: int):
    def run(pdf):
        pdf = pdf.sort_values(["key", "id"])
        points, asks = pdf[~pdf.is_query], pdf[pdf.is_query]
        found = []
        if len(points) and len(asks):
            x = np.frombuffer(b"".join(points.vector), np.float64).reshape(len(points), -1)
            q = np.frombuffer(b"".join(asks.vector), np.float64).reshape(len(asks), -1)
            ids, names = points.id.to_numpy(), asks.id.to_numpy()
            low, high = _ranges(points.key.to_numpy(), asks.key.to_numpy(), asks.level.to_numpy().astype(np.int64), bits)
            _, where = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
            where = where.ravel()
            order = np.argsort(where, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                a, b = low[same[0]], high[same[0]]
                if b > a:
                    for name, (near, score) in zip(names[same], _best(q[same], x[a:b], ids[a:b], k), strict=True):
                        found.append(pd.DataFrame({"query": name, "vec_id": ids[a:b][near], "score": score}))
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.concat(found) if found else empty

    return run


# ---- the search ------------------------------------------------------------------------------


def nearest(
    vectors: DataFrame, every: int = 20, search: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``search.k`` nearest rows found for each row whose id is
    divisible by ``every``, by inner product, ties to the smaller id; the query itself is left out.

    :func:`usable` says which rows take part; an empty table gives no rows. Extra columns are not
    read. Equal vectors are searched once: of each vector only the ``k + 1`` smallest ids can
    be among anyone's nearest, and queries that hold the same vector share one search. Results are
    approximate in which rows are found, exact in score and order.
    """
    rows = stored(usable(vectors, id_col, vector_col))
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    points = stored(rows.withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= search.k + 1).drop("_n"))
    asking = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = stored(asking.groupBy("vector").agg(F.min("vec_id").alias("query")))
    n, norm, mean = _middle(points)
    planes = Planes(search, norm, mean)
    size = budget(points, queries, planes, search) if n else search.least
    plan = layout(points, queries, planes, search, size)

    bits, k = search.bits, search.k
    fields = "grp long, key long, id long, level long, is_query boolean"
    narrow = points.mapInPandas(_dealt(planes, plan, False, False), fields).union(
        queries.mapInPandas(_dealt(planes, plan, True, False), fields))
    counts = T.StructType([T.StructField("query", T.LongType())] + [
        T.StructField(f"c{level}", T.LongType()) for level in range(bits + 1)])
    held = narrow.groupBy("grp").applyInPandas(_level_counts(bits), counts)
    stop = F.coalesce(*[F.when(F.sum(f"c{level}") >= size, F.lit(level)) for level in range(bits, 0, -1)], F.lit(0))
    levels = held.groupBy("query").agg(stop.alias("level"))
    asks = stored(queries.join(levels, "query"))

    wide = points.mapInPandas(_dealt(planes, plan, False, True), fields + ", vector binary").union(
        asks.mapInPandas(_dealt(planes, plan, True, True), fields + ", vector binary"))
    found = stored(wide.groupBy("grp").applyInPandas(_candidates(bits, k + 1), "query long, vec_id long, score double"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    members = asking.join(queries, "vector").select(F.col("vec_id").alias("query_id"), "query")
    mine = F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return members.join(lists, "query").select("query_id", F.posexplode(mine).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")
