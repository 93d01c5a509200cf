"""Word n-gram language model as a weighted backoff automaton, trained and applied by blocks.

Texts are dealt into blocks of bounded size by a hash. Each block asks for the counts of just the
n-grams it holds; n-grams are dealt into shards by their hash, where the counts of all blocks meet.
A block sends its sorted n-grams once, with its own training counts, and gets back the totals in
the same order, so the n-grams themselves travel one way only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.shared import stored, text_bytes
from snapmart.llm.words import MULTIPLIER, mix, word_hashes

START, END = np.uint64(0x5151515151515151), np.uint64(0xE1E1E1E1E1E1E1E1)
PRIORS = tuple(4.0**k for k in range(9))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 5, is 1; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _pack(x: np.ndarray) -> bytes:
    """Bytes by place, then compressed: high bytes of small numbers vanish."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Block:
    """Token sequences of a block's texts, end to end, with start and end marks."""

    def __init__(self, texts, order: int):
        sequences = [np.concatenate(([START], word_hashes(t, lower=True), [END])) for t in texts]
        self.tokens = np.concatenate(sequences)
        lengths = np.array([len(s) for s in sequences])
        self.first = np.cumsum(lengths) - lengths
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(self.tokens)) - self.first[self.doc]
        self.grams = []  # per order: hash of the n-gram that ends at each place, where there is one
        gram = mix(self.tokens)
        for k in range(1, order + 1):
            if k > 1:
                before = np.roll(gram, 1)
                gram = mix(before * MULTIPLIER + self.tokens + np.uint64(k))
            self.grams.append(gram)

    def known(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of order k, sorted, each place's index among them, and the places."""
        places = np.flatnonzero(self.place >= k - 1)
        values, index = np.unique(self.grams[k - 1][places], return_inverse=True)
        return values, index, places


def _shard(values: np.ndarray, shards: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _requests(order: int, shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, out = Block(pdf.text, order), []
        learns = ~pdf.held_out.to_numpy(bool)
        for k in range(1, order + 1):
            values, index, places = block.known(k)
            count = np.bincount(index, weights=learns[block.doc[places]], minlength=len(values)).astype(np.uint32)
            cuts = np.searchsorted(_shard(values, shards), np.arange(shards + 1))
            for s in range(shards):
                if cuts[s] < cuts[s + 1]:
                    part = values[cuts[s]:cuts[s + 1]]
                    steps = np.diff(part, prepend=np.uint64(0))
                    out.append((s, int(pdf.block.iloc[0]), k, _pack(steps), _pack(count[cuts[s]:cuts[s + 1]])))
        return pd.DataFrame(out, columns=["shard", "block", "k", "grams", "counts"])

    return run


def _totals(order: int):
    start = mix(np.array([START]))[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(1, order + 1):
            asked = pdf[pdf.k == k].sort_values("block")
            if not len(asked):
                continue
            parts = [np.cumsum(_unpack(g, np.uint64), dtype=np.uint64) for g in asked.grams]
            counts = np.concatenate([_unpack(c, np.uint32) for c in asked.counts])
            values, index = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(index, weights=counts, minlength=len(values)).astype(np.int64)
            words = (total > 0) & (values != start)
            answer = np.split(total[index], np.cumsum([len(p) for p in parts])[:-1])
            for j, (block, shard, totals) in enumerate(zip(asked.block, asked.shard, answer, strict=True)):
                own = k == 1 and j == 0  # a shard's own sums travel with one of its rows
                out.append((block, k, shard, _pack(totals), int(words.sum()) if own else 0,
                            int(total[words].sum()) if own else 0))
        return pd.DataFrame(out, columns=["block", "k", "shard", "totals", "types", "tokens"])

    return run


def _traverse(order: int, types: int, tokens: int, priors: tuple[float, ...]):
    """Scores of a block's texts under each prior, and their leave-one-out scores.

    States are the contexts with training counts, arcs the n-grams with counts. At each token the
    traversal stands in the state of the longest known context. A state with count c and failure
    weight m / (c + m) has for an arc with count a the weight (a + m * q) / (c + m), where q is the
    next shorter state's weight of the same word; a word without an arc takes the failure weight
    and goes on in the shorter state. The state of no context gives (c + 1/2) / (N + (V + 1) / 2).
    """
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base", "scores", "left_out"])
        block = Block(docs.text, order)
        learns = ~docs.held_out.to_numpy(bool)
        counts = []
        for k in range(1, order + 1):
            own = answers[answers.k == k].sort_values("shard")
            values, index, places = block.known(k)
            total = np.concatenate([_unpack(t, np.int64) for t in own.totals])
            at = np.zeros(len(block.tokens), np.int64)
            at[places] = total[index]
            counts.append(at)
        word = block.place > 0
        rows = np.flatnonzero(word)
        doc = block.doc[rows]
        edges = np.searchsorted(doc, np.arange(len(docs)))
        by_doc = lambda x: np.add.reduceat(x, edges)
        one = learns[doc].astype(np.float64)  # what leaving out the token itself takes from its counts
        norm = tokens + 0.5 * (types + 1)
        base = (counts[0][rows] + 0.5) / norm
        scores, left_out = [], []
        for prior in priors:
            p, q = base, (np.maximum(counts[0][rows] - one, 0) + 0.5) / (norm - 1)
            for k in range(2, order + 1):
                deep = block.place[rows] >= k - 1
                state = np.where(deep, counts[k - 2][rows - 1], 0)
                arc = np.where(deep, counts[k - 1][rows], 0)
                p = np.where(state > 0, (arc + prior * p) / (state + prior), p)
                less, alone = np.maximum(arc - one, 0), np.maximum(state - one, 0)
                q = np.where(alone > 0, (less + prior * q) / (alone + prior), q)
            scores.append(by_doc(np.log10(p)))
            left_out.append(by_doc(np.log10(q)))
        return pd.DataFrame({
            "doc_id": docs.doc_id.to_numpy(), "held_out": ~learns, "n_tokens": by_doc(np.ones(len(rows), np.int64)),
            "n_known": by_doc((counts[0][rows] > 0).astype(np.int64)), "base": by_doc(np.log10(base)),
            "scores": list(np.stack(scores, 1)), "left_out": list(np.stack(left_out, 1)),
        }).astype({"doc_id": "Int64"})

    return run


def scored(
    docs: DataFrame, order: int = 2, priors: tuple[float, ...] = PRIORS, block_bytes: int = 6 << 20
) -> DataFrame:
    """Log10 probability of every row of ``docs(doc_id, text)`` under a model of the training rows.

    Training rows are those with crc32(doc_id as text) mod 5 other than 1. Words are runs of
    characters other than space and 0x09-0x0D, A-Z lower-cased; an end mark closes each text and
    counts as a token. The base model smooths single words by 1/2; the automaton adds contexts of
    up to ``order - 1`` words. Its prior is the one of ``priors`` under which the training texts
    are most probable when each token is left out of the counts that predict it.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior. Null and
    empty texts are an end mark alone. Repeated rows are learnt and scored each; a null doc_id
    belongs to the training rows. An empty table gives an empty result; other columns are ignored.
    """
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    asked = source.groupBy("block").applyInPandas(
        _requests(order, blocks), "shard int, block int, k int, grams binary, counts binary"
    )
    answers = stored(asked.groupBy("shard").applyInPandas(
        _totals(order), "block int, k int, shard int, totals binary, types long, tokens long"
    ))
    size = answers.agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = size[0] or 0, size[1] or 0
    found = stored(source.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _traverse(order, types, tokens, priors),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, scores array<double>, "
        "left_out array<double>",
    ))
    sums = [F.sum(F.get("left_out", F.lit(k))).alias(str(k)) for k in range(len(priors))]
    fit = found.filter("not held_out").agg(*sums).first()
    best = max(range(len(priors)), key=lambda k: fit[k] if fit[k] is not None else -float("inf"))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.get("scores", F.lit(best)).alias("score"), F.lit(priors[best]).alias("prior"),
    )
