"""Ranked retrieval over sketches of coordinatewise maxima.

Each document folds the impacts of its terms into a vector: a term's hash picks a few coordinates,
each of which keeps the greatest impact that falls on it, so the least of a term's coordinates is
never below its impact. For a document of known length the impact only grows
with the term's count, so the greatest count is kept and the vector needs no corpus statistics.
A batch of documents looks up the coordinates of all query terms at once; times the terms' weights
this bounds every item's score from above. Documents are then scored exactly in descending order of
their bound until no bound exceeds the score of an item's last place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.shared import stored
from snapmart.llm.words import letter_words

SCALE = 1_000_000_000
#: a count of this size stands for itself and all larger ones
FULL = 255
HASHES = 4
INDEX = "doc_id long, n long, sketch binary, terms binary, counts binary"


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of its weight: grows with its count in the document."""
    return (SCALE * tf) // (1000 * tf + 8 * m)


def coordinates(terms: np.ndarray) -> list[np.ndarray]:
    """The coordinates of each term, to be taken modulo a sketch's size (a power of two)."""
    low, high = (terms & np.uint64(0xFFFFFFFF)).astype(np.int64), (terms >> np.uint64(32)).astype(np.int64) | 1
    return [low + k * high for k in range(HASHES)]


def sketch_of(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """Greatest counts in a vector of 16 to 32 coordinates for each distinct term, 64 at least: a
    term that a document lacks finds all its coordinates taken in about one case of a thousand."""
    size = max(64, 1 << (16 * max(len(terms), 1) - 1).bit_length())
    out, most = np.zeros(size, np.uint8), np.minimum(counts, FULL).astype(np.uint8)
    for at in coordinates(terms):
        np.maximum.at(out, at & (size - 1), most)
    return out.tobytes()


def _indexed(batches):
    for pdf in batches:
        rows = []
        for text in pdf.text:
            words = letter_words(text)
            terms, counts = np.unique(words, return_counts=True)
            counts = counts.astype(np.uint32)
            rows.append((len(words), sketch_of(terms, counts), terms.tobytes(), counts.tobytes()))
        yield pd.DataFrame({"doc_id": pdf.doc_id} | {
            name: [r[k] for r in rows] for k, name in enumerate(("n", "sketch", "terms", "counts"))})


def indexed(docs: DataFrame) -> DataFrame:
    """A row for each document: terms in all, the sketch, distinct terms (64-bit hashes, sorted) and
    their counts. Written once to the shared folder; its parts are read as columns."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInPandas(_indexed, INDEX), "zstd")


class Batch:
    """The terms of a block of items: hashes in order, and for each item the places of its terms."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([t for _, t in items] or [np.zeros(0, np.uint64)]))
        self.places = [np.searchsorted(self.terms, t) for _, t in items]

    def weights(self, df: np.ndarray, n: int) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _held(batch: Batch):
    """How many documents of the task hold each term of the batch."""
    def run(batches):
        df = np.zeros(len(batch.terms), np.int64)
        for pdf in batches:
            for begin in range(0, len(pdf), 512):
                terms = np.frombuffer(b"".join(pdf.terms.iloc[begin:begin + 512]), np.uint64)
                at = np.minimum(np.searchsorted(batch.terms, terms), len(batch.terms) - 1)
                df += np.bincount(at[batch.terms[at] == terms], minlength=len(df))
        yield pd.DataFrame({"place": np.flatnonzero(df), "df": df[df > 0]})

    return run


def _ranked(batch: Batch, weights: np.ndarray, n_docs: int, n_terms: int, k: int, rows: int = 256):
    """The task's ``k`` best documents for each item, as (item, doc_id, score, part)."""
    table = np.zeros((len(batch.terms), len(batch.ids)))
    for item, places in enumerate(batch.places):
        table[places, item] = weights[places]

    def exact(item: int, terms: np.ndarray, counts: np.ndarray, m: int) -> int:
        places = batch.places[item]
        at = np.minimum(np.searchsorted(terms, batch.terms[places]), len(terms) - 1)
        tf = np.where(terms[at] == batch.terms[places], counts[at], 0).astype(np.int64)
        return int((weights[places] * impacts(tf, np.int64(m))).sum())

    def run(batches):
        best: list[list[tuple[int, int]]] = [[] for _ in batch.ids]  # (-score, doc_id), best first
        wanted = [(at & 0xFFFFFFFF).astype(np.uint32) for at in coordinates(batch.terms)]
        last = np.zeros(len(batch.ids))  # the score that a document has to reach
        for pdf in batches:
            pdf = pdf[pdf.n > 0]
            for begin in range(0, len(pdf), rows):
                part = pdf.iloc[begin:begin + rows]
                n = part.n.to_numpy()
                m = 10 + (90 * n * n_docs) // n_terms
                peak = np.empty((len(part), len(batch.terms)), np.uint8)
                for i, raw in enumerate(part.sketch):
                    sketch = np.frombuffer(raw, np.uint8)
                    places = [sketch[at & np.uint32(len(sketch) - 1)] for at in wanted]
                    peak[i] = np.minimum(np.minimum(places[0], places[1]), np.minimum(places[2], places[3]))
                row, place = np.nonzero(peak)
                tf = peak[row, place].astype(np.int64)
                tf[tf == FULL] = 1 << 31
                most = np.zeros(peak.shape)
                most[row, place] = impacts(tf, m[row])
                bound = most @ table  # whole numbers below 2 ** 53: exact
                ids, terms, counts = part.doc_id.to_numpy(), part.terms.to_list(), part.counts.to_list()
                for item in np.flatnonzero((bound >= np.maximum(last, 1)).any(0)):
                    column = bound[:, item]
                    able = np.flatnonzero(column >= max(last[item], 1))
                    for row in able[np.argsort(-column[able], kind="stable")]:
                        if column[row] < last[item]:
                            break
                        score = exact(
                            item, np.frombuffer(terms[row], np.uint64), np.frombuffer(counts[row], np.uint32), int(m[row]))
                        if score > 0:
                            best[item] = sorted([*best[item], (-score, int(ids[row]))])[:k]
                            if len(best[item]) == k:
                                last[item] = -best[item][-1][0]
        rows_out = [(item, doc, -less) for item, found in enumerate(best) for less, doc in found]
        yield pd.DataFrame(rows_out, columns=["item", "doc_id", "score"]).astype(np.int64)

    return run


def _item_terms(batches):
    for pdf in batches:
        yield pd.DataFrame({"item_id": pdf.item_id, "terms": [np.unique(letter_words(t)).tobytes() for t in pdf.text]})


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z as a-z, compared by 64-bit
    hashes. With N documents that hold a term, L terms in all, n of a document, df documents that
    hold a term and tf its count: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + 90 n N div L,
    score = sum of w * (10^9 tf div (1000 tf + 8 m)) over an item's distinct terms. Equal scores go
    by ascending doc_id.

    Null and empty texts hold no terms: such documents are in no result, such items have no rows.
    Every row of ``docs`` is a document, so a repeated row takes a place of its own; rows without a
    doc_id are left out of ranks but count as documents. Items that share an id are one item with
    the terms of all, and null is an id. Texts are taken whole. Items are searched in blocks whose
    terms take about ``block_bytes``; every block passes over all documents.
    """
    spark = docs.sparkSession
    index = indexed(docs)
    n_docs, n_terms = index.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = stored(items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInPandas(
        _item_terms, "item_id long, terms binary"))
    blocks = -(-(wanted.agg(F.sum(F.octet_length("terms"))).first()[0] or 0) // block_bytes)
    out = None
    for block in range(blocks if n_docs else 0):
        mine = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        united: dict[int | None, list[np.ndarray]] = {}
        for row in mine:
            united.setdefault(row["item_id"], []).append(np.frombuffer(row["terms"], np.uint64))
        batch = Batch([(i, np.unique(np.concatenate(t))) for i, t in united.items()])
        if not len(batch.terms):
            continue
        df = np.zeros(len(batch.terms), np.int64)
        held = index.select("terms").mapInPandas(_held(batch), "place int, df long").groupBy("place").agg(F.sum("df").alias("df"))
        for row in held.collect():
            df[row["place"]] = row["df"]
        search = _ranked(batch, batch.weights(df, n_docs), n_docs, n_terms, k)
        found = index.filter("doc_id is not null").mapInPandas(search, "item long, doc_id long, score long")
        names = spark.createDataFrame(list(enumerate(batch.ids)), "item long, item_id long")
        # two steps, so that what many tasks have found for one item does not meet in one task at once
        order = [F.desc("score"), F.asc("doc_id")]
        some = Window.partitionBy("item", "part").orderBy(*order)
        whole = Window.partitionBy("item").orderBy(*order)
        best = (
            found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
            .withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        )
        out = best if out is None else out.union(best)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return empty if out is None else out
