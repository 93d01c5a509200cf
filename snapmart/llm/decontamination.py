"""Benchmark decontamination by spaced seeds, with column functions only."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.shared import same, stored

#: positions marked 1 must be equal for a hit, those marked 0 are ignored; together they hit every
#: alignment with 80 % equal tokens in a window of 20, or in an item of 5 to 19 (see ``hits_all``)
MASKS = ("1111", "11011", "11101", "10111")
#: more tokens at once, so fewer hits by chance; they hit every such window of 20
HEAVY = ("1101111", "111010011", "10110111")
#: patterns that ``hits_all`` tries at most
PATTERNS = 20_000


@lru_cache(maxsize=None)
def hits_all(masks: tuple[str, ...], width: int, unequal: int) -> bool:
    """Whether some mask fits on equal tokens of a window of ``width``, wherever ``unequal`` are not equal."""
    if comb(width, unequal) > PATTERNS:
        return False
    at = [int(m, 2) << s for m in masks for s in range(width - len(m) + 1)]
    return all(
        any(not bits & m for m in at) for bits in (sum(1 << k for k in c) for c in combinations(range(width), unequal))
    )


def masks_for(width: int, share: int, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks that hit every alignment with ``share`` percent equal tokens in a window of ``width``.

    ``HEAVY``, else the fewest of ``masks`` from the first on, where all patterns prove it; else a
    run of tokens: with u unequal ones, the others form u + 1 runs, so one has a (u + 1)th of them.
    """
    unequal = width - -(-width * share // 100)
    for tried in (HEAVY, *(masks[:k] for k in range(1, len(masks) + 1))):
        if hits_all(tried, width, unequal):
            return tried
    return ("1" * -(-(width - unequal) // (unequal + 1)),)


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, in lower case; empty for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(df: DataFrame, keep: list[str], masks: dict[str, Column], place: str) -> DataFrame:
    """A row per place and mask that fits there: ``keep``, the place of its first token and its seed.

    A mask is laid where its condition is true.
    """
    at = df.select(*keep, F.posexplode("tokens").alias(place, "_"))
    seeds = []
    for k, (mask, wanted) in enumerate(masks.items()):
        picked = [F.get("tokens", F.col(place) + j) for j, bit in enumerate(mask) if bit == "1"]
        fits = F.col(place) + len(mask) <= F.size("tokens")
        seeds.append(F.when(fits & wanted, F.xxhash64(F.lit(k), *picked)))
    return at.select(*keep, place, F.explode(F.array(*seeds)).alias("seed")).filter("seed is not null")


def _overlap() -> list[Column]:
    """The document's tokens where the item lies on it, the item's own there, and the item's length."""
    n = F.size("wanted")
    cut = F.greatest(-F.col("shift"), F.lit(0))  # of the item's tokens before the document's start
    length = F.greatest(n - cut, F.lit(0))
    there = F.slice("tokens", F.greatest(F.col("shift"), F.lit(0)) + 1, length)
    return [there.alias("there"), F.slice("wanted", cut + 1, length).alias("here"), n.alias("n")]


def _best() -> Column:
    """The greatest sum of ``width`` neighbours in ``equal``; what lies outside counts 0."""
    def step(acc: Column, k: Column) -> Column:
        gone = F.when(k >= F.col("width"), F.get("equal", F.greatest(k - F.col("width"), F.lit(0)))).otherwise(0)
        now = acc.now + F.get("equal", k) - gone
        return F.struct(now.alias("now"), F.greatest(acc.best, now).alias("best"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size("equal") - 1), start, step).best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 20,
    share: int = 80, least_tokens: int = 5, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Pairs of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` that overlap.

    Texts become runs of letters and digits in lower case. A pair is reported if in some alignment
    of both texts some ``window`` tokens of the item (all of a shorter one) have at least ``share``
    percent equal tokens in the document. Masks propose alignments, and those of ``masks_for`` miss
    none that reaches the share. Items below ``least_tokens`` are left out, since such few words
    occur by chance. Seeds are broadcast up to ``broadcast_rows`` rows of
    a few numbers each, and joined by a shuffle above.

    Returns doc_id, item_id, n_equal and n_window (of the best window) and first_word (the place
    in the document where the aligned item begins, counted from 0; negative if the item's head
    lies before the document). Rows that repeat a doc_id count as one document, repeated items
    with one item_id as one item. Null and empty texts overlap with nothing; empty tables give an
    empty result; other columns are ignored.
    """
    return (
        _overlaps(docs, benchmark, masks, window, share, least_tokens, broadcast_rows)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("best", F.col("width"), (-F.col("shift")).alias("s"))).alias("b"))
        .select("doc_id", "item_id", F.col("b.best").cast("long").alias("n_equal"),
                F.col("b.width").cast("long").alias("n_window"), (-F.col("b.s")).cast("long").alias("first_word"))
    )


def _key(df: DataFrame) -> Column:
    return F.xxhash64(df.doc_id, df.text)


def _overlaps(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 20,
    share: int = 80, least_tokens: int = 5, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Every alignment that reaches the share: doc_id, key (of doc_id and text), item_id, shift, width, best."""
    items = benchmark.select(F.col("item_id"), token_hashes(F.col("text")).alias("tokens"))
    items = stored(
        items.filter(F.size("tokens") >= least_tokens).distinct()
        .withColumn("item", F.xxhash64("item_id", "tokens"))
    )
    width = F.least(F.size("tokens"), F.lit(window))
    widths = [r.w for r in items.select(width.alias("w")).distinct().collect()]  # at most ``window`` numbers
    uses: dict[str, list[int]] = {}
    for w in sorted(widths):
        for mask in masks_for(w, share, masks):
            uses.setdefault(mask, []).append(w)
    if not uses:
        uses = {masks[0]: []}
    of_item = {mask: width.isin(ws) for mask, ws in uses.items()}
    seeds = stored(_windows(items, ["item", "tokens"], of_item, "item_at").select("item", "item_at", "seed").distinct())
    small = seeds.count() <= broadcast_rows
    near = F.broadcast if small else (lambda df: df)

    # the hash of a row only names candidates; what is reported is compared token by token
    source = docs.select("doc_id", "text", _key(docs).alias("key"))
    hits = stored(
        _windows(source.select("key", token_hashes(F.col("text")).alias("tokens")), ["key", "tokens"],
                 dict.fromkeys(uses, F.lit(True)), "at")
        .join(near(seeds), "seed")
        .select("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    )
    wanted = items.select("item", "item_id", F.col("tokens").alias("wanted"))
    found = source.join(hits.select("key").distinct(), "key", "left_semi")
    aligned = (
        found.select("doc_id", "key", token_hashes(F.col("text")).alias("tokens"))
        .join(hits.join(near(wanted), "item"), "key")
        .select("doc_id", "key", "item_id", "shift", *_overlap())
    )
    equal = F.zip_with("there", "here", lambda a, b: F.when(a == b, 1).otherwise(0))
    width = F.least(F.lit(window), F.col("n")).alias("width")
    # explodes of one value, so that Spark works it out once and not in every place that uses it
    marked = aligned.select("doc_id", "key", "item_id", "shift", width, F.explode(F.array(equal)).alias("equal"))
    best = marked.select("doc_id", "key", "item_id", "shift", "width", F.explode(F.array(_best())).alias("best"))
    return best.filter(F.col("best") * 100 >= F.col("width") * share)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item; all columns as they are."""
    bad = _overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    bad = stored(bad.distinct())
    return docs.join(bad, same(docs.doc_id, bad["_id"]) & (_key(docs) == bad["_key"]), "left_anti")
