"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmart.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """Component of every node of ``links(a, b)``: columns ``unit`` and ``label``, the least node.

    Alternates two star contractions until no link changes: each node's larger neighbours move to
    the least node around it, then its smaller ones do. Depth halves each time. Each round is a
    grouped minimum and a join on the node, so a node with very many links is split by adaptive
    execution. Self-links, both directions and repeated links are harmless; nulls are dropped.
    """
    edges = stored(
        links.filter("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), "m")
        edges = stored(small.filter("u != m").select("u", F.col("m").alias("v")).distinct())
    return edges.select(F.explode(F.array("u", "v")).alias("unit"), F.col("v").alias("label")).distinct()
