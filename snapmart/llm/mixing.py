"""Mixing of sources to target weights by a temperature on their token shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from snapmart.llm.shared import same, stored


def token_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(counted: DataFrame) -> DataFrame:
    """``source, tokens, share`` of the sources that have tokens; null is a source."""
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    everything = totals.agg(F.sum("tokens").alias("all_tokens"))
    return totals.join(F.broadcast(everything)).select(  # a single row
        "source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share")
    )


def weighted(shares: DataFrame, exponent: float) -> tuple[DataFrame, float]:
    """Shares to the power ``exponent`` as weights that sum to 1, and the sum they had before."""
    powered = F.pow(F.col("share"), F.lit(float(exponent)))
    total = shares.agg(F.sum(powered)).first()[0] or 1.0
    return shares.withColumn("weight", powered / total), total


def _state(shares: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and the largest repetition of a source, for each exponent, in one pass."""
    found = {}
    aggs = []
    for k, e in enumerate(exponents):
        p = F.pow(F.col("share"), F.lit(e))
        aggs += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log("share")).alias(f"l{k}"),
                 F.max(p / F.col("tokens")).alias(f"r{k}")]
    row = shares.agg(*aggs).first()
    for k, e in enumerate(exponents):
        z = row[f"z{k}"]
        found[e] = (math.log(z) - e * row[f"l{k}"] / z, row[f"r{k}"] / z * budget)
    return found


def fitted_exponent(
    shares: DataFrame, budget: float, entropy: float | None = None, repetition: float | None = None,
    parts: int = 16, passes: int = 6,
) -> float:
    """Exponent within [0, 1] by bisection: the greatest one whose weights have at least the target
    entropy (nats), raised where needed until no source is repeated more often than ``repetition``.

    Entropy and repetition both fall as the exponent grows. Each pass evaluates ``parts`` points of
    the bracket at once, which is that many bisections of it in one job over the source table.
    Exponent 1 gives the sources' own shares, 0 equal weights. A target entropy beyond the sources'
    own count gives 0, and a repetition limit that even the own shares exceed gives 1.
    """
    def search(good) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(passes):
            points = [low + (high - low) * k / parts for k in range(parts + 1)]
            state = _state(shares, points, budget)
            fits = [good(*state[p]) for p in points]
            edge = next((k for k in range(parts) if fits[k] != fits[k + 1]), None)
            if edge is None:
                return (1.0, 1.0) if fits[0] else (0.0, 0.0)
            low, high = points[edge], points[edge + 1]
        return low, high

    exponent = 1.0
    if entropy is not None:
        state = _state(shares, [1.0], budget)[1.0]
        exponent = 1.0 if state[0] >= entropy else search(lambda h, _: h >= entropy)[0]
    if repetition is not None and _state(shares, [exponent], budget)[exponent][1] > repetition:
        at_one = _state(shares, [1.0], budget)[1.0][1]
        exponent = 1.0 if at_one > repetition else max(exponent, search(lambda _, r: r > repetition)[1])
    return exponent


def mixed(
    docs: DataFrame, budget: float | None = None, entropy_share: float = 0.95, repetition: float = 4.0,
    block_tokens: int = 500_000, seed: int = 11,
) -> DataFrame:
    """The documents drawn for the mix: a row per document and pass over its source.

    The token ``budget`` (default: all tokens there are) is shared out by weights whose entropy is
    ``entropy_share`` of the greatest possible, so far as no source is passed over more than
    ``repetition`` times. Each source's documents fall into blocks of about ``block_tokens`` tokens
    by a hash; every pass takes the blocks in a new order, and documents in a new order within a
    block, until the source's budget is met: a document is drawn if the tokens before it in its
    source's sequence are below the budget. So a source exceeds its budget by less than one
    document.

    Returns the columns of ``docs`` plus mix_epoch (pass, from 0), mix_block, mix_start (tokens of
    the source before this draw), mix_weight. Documents without tokens are never drawn. Null is a
    source of its own. Repeated rows are drawn each, and so are rows that share an id and a text
    but differ in any other column (maps aside, which Spark does not hash). An empty table gives an empty result. A column
    of ``docs`` with a name of these four is replaced.
    """
    new = ("mix_epoch", "mix_block", "mix_start", "mix_weight")
    columns = [c for c in docs.columns if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    key = F.xxhash64("doc_id", "text")
    # names the row: rows that share an id and a text but differ elsewhere are drawn each for itself
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in columns if not isinstance(docs.schema[c].dataType, MapType)])
    source = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), whole.alias("whole"),
        token_count(F.col("text")).alias("tokens"),
    )
    counted = stored(source.groupBy("doc_id", "key", "whole", "source", "tokens").agg(F.count(F.lit(1)).alias("rows"))
                     .filter("tokens > 0"))
    shares = stored(source_shares(counted.select("source", (F.col("tokens") * F.col("rows")).alias("tokens"))))
    size = shares.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    budget = float(size[0] or 0) if budget is None else float(budget)
    exponent = 1.0
    if size[1]:
        exponent = fitted_exponent(shares, budget, entropy_share * math.log(size[1]), repetition)
    plan = weighted(shares, exponent)[0].select(
        F.col("source").alias("plan_source"), "weight", (F.col("weight") * budget).alias("source_budget"),
        F.col("tokens").alias("source_tokens"),
        F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("blocks"),
    )
    plan = stored(plan)
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    placed = each.join(plan, same(each.source, plan.plan_source)).withColumn(
        "block", F.pmod(F.xxhash64("key", "copy", F.lit(seed)), F.col("blocks"))
    )
    placed = stored(placed.select("doc_id", "key", "whole", "copy", "source", "tokens", "block"))
    # one row per pass and block: where the block begins in the source's sequence
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("source_budget") / F.col("source_tokens")) - 1, F.lit(0)).cast("int"))
    rounds = blocks.join(plan, same(blocks.source, plan.plan_source)).select(
        "source", "block", F.col("tokens").alias("block_size"), "weight", "source_budget", "source_tokens",
        F.explode(passes).alias("epoch"),
    )
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    before = F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = rounds.withColumn("begin", before + F.col("epoch") * F.col("source_tokens"))
    rounds = stored(rounds.filter("begin < source_budget").select(
        F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "begin", "weight", "source_budget"
    ))
    drawn = placed.join(rounds, same(placed.source, rounds.s) & (placed.block == rounds.b))
    inside = Window.partitionBy("source", "block", "epoch").orderBy(
        F.xxhash64("key", "copy", "epoch", F.lit(seed)), "key", "doc_id", "whole", "copy"
    ).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begin") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    drawn = stored(drawn.withColumn("start", start).filter("start < source_budget").select(
        F.col("doc_id").alias("i"), F.col("key").alias("k"), F.col("whole").alias("w"), "epoch", "block", "start", "weight"
    ))
    # rows that repeat another in every column share its key: the draws of all of them are attached to one
    again = counted.filter("rows > 1").select(F.col("doc_id").alias("ia"), F.col("key").alias("ka"), F.col("whole").alias("wa"))
    full = docs.select(row.alias("row"), F.col("doc_id").alias("k1"), key.alias("k2"), whole.alias("k3"))
    alike = lambda i, k, w: same(F.col("k1"), F.col(i)) & (F.col("k2") == F.col(k)) & (F.col("k3") == F.col(w))
    marked = full.join(again, alike("ia", "ka", "wa"), "left")
    single = marked.filter("ka is null").select("row", "k1", "k2", "k3")
    copies = marked.filter("ka is not null").select("row", "k1", "k2", "k3").dropDuplicates(["k1", "k2", "k3"])
    out = single.union(copies).join(drawn, alike("i", "k", "w"))
    return out.select(
        *[F.col("row")[c].alias(c) for c in columns], F.col("epoch").alias("mix_epoch"),
        F.col("block").alias("mix_block"), F.col("start").alias("mix_start"),
        F.round("weight", 9).alias("mix_weight"),
    )
