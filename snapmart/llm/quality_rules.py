"""Quality rules with thresholds from quantile sketches of each language and source.

A sketch is a histogram over bins that keep the top seven bits of a value, so a quantile is right
within 1/64 of its size. Sketches merge by adding counts: exact, whatever the order of merging.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.shared import same, stored, text_key
from snapmart.llm.words import SPACE, shingles, spans, word_hashes

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

#: metric -> (lower fence used, upper fence used, least slack on either side of the quartiles)
FENCES = {
    "word_length": (True, True, 60),
    "symbols": (False, True, 100),
    "dup_lines": (False, True, 300),
    "repeats": (False, True, 300),
}


def _measures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = np.frombuffer(text, np.uint8)
    words = word_hashes(text, lower=False)
    chars = int((~SPACE[raw] & ((raw & 0xC0) != 0x80)).sum())
    symbols = int(_SYMBOLS[raw].sum())
    lines = [line for line in text.split(b"\n") if line.split()]
    repeats = 0
    if len(words) > 3:
        _, which, count = np.unique(shingles(words, 3), return_inverse=True, return_counts=True)
        twice = np.append(count[which] > 1, [False, False])
        repeats = int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def _measured(batches):
    for pdf in batches:
        found = np.array([_measures(text) for text in pdf.text], np.int64).reshape(-1, 5)
        yield pd.DataFrame({
            "doc_id": pdf.doc_id, "key": pdf.key, "lang": pdf.lang, "source": pdf.source, "n_words": found[:, 0],
            "word_chars": found[:, 1], "n_symbols": found[:, 2], "n_dup_lines": found[:, 3],
            "n_repeat_words": found[:, 4], "n_lines": [t.count(b"\n") + 1 if t else 0 for t in pdf.text],
        })


def sketch_bin(value: Column) -> Column:
    """The value with all but its top seven bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, metrics: dict[str, Column], by: list[str]) -> DataFrame:
    """Counts per group, metric and bin: the mergeable form."""
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), sketch_bin(v.cast("long")).alias("bin")) for m, v in metrics.items()
    ]))
    return measured.select(*by, each.alias("e")).groupBy(*by, "e.metric", "e.bin").agg(
        F.count(F.lit(1)).alias("rows")
    )


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows and lower and upper quartile of each metric, from merged sketches."""
    merged = sketch.groupBy(*by, "metric", "bin").agg(F.sum("rows").alias("rows"))
    group = Window.partitionBy(*by, "metric")
    upto = F.sum("rows").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"upto": upto, "total": F.sum("rows").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bin")))
    return ranked.groupBy(*by, "metric").agg(
        F.max("total").alias("total"), at(25).alias("q1"), at(75).alias("q3")
    )


def quality_verdicts(docs: DataFrame, parent_rows: int = 20, reach: int = 3) -> DataFrame:
    """Measures and verdict of every row of ``docs(doc_id, text, lang, source)``.

    A document fails the base rules with under 50 words or with over half of its words in repeated
    3-word windows. Of those that pass, one is kept while each metric lies between the quartiles
    widened by ``reach`` times their distance, at least by the metric's slack: mean word length
    (hundredths), symbols per 1000 words, repeated lines per 1000, words in repeats per 1000.
    Quartiles come from all documents that pass the base rules, of the same language and source.
    The bounds of a language are averaged with those of all documents, these counting as
    ``parent_rows`` documents, and the bounds of a language and source likewise with those of the
    language. So a small group leans on its parent, and no number of rows turns a verdict by itself.

    Null and empty texts have no words and fail. Null languages and sources are groups of their
    own. Repeated rows each get a row. An empty table gives an empty result; other columns are
    ignored.
    """
    return _verdicts(docs, parent_rows, reach).drop("key", "lang", "source")


def _verdicts(docs: DataFrame, parent_rows: int = 20, reach: int = 3) -> DataFrame:
    """:func:`quality_verdicts` with the hash of the text, language and source, to find the row again."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        text_key(docs).alias("key"),
    )
    measured = stored(source.mapInPandas(
        _measured, "doc_id long, key long, lang string, source string, n_words long, word_chars long, "
        "n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    ))
    words = F.greatest("n_words", F.lit(1))
    per_mille = lambda n, of: F.floor(F.col(n) * 1000 / of)
    metrics = {
        "word_length": F.floor(F.col("word_chars") * 100 / words),
        "symbols": per_mille("n_symbols", words),
        "dup_lines": per_mille("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        "repeats": per_mille("n_repeat_words", words),
    }
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = measured.withColumn("base_failed", failed)
    finest = stored(sketches(judged.filter("not base_failed"), metrics, ["lang", "source"]))
    low = lambda df: F.greatest(F.col("q1") - F.greatest((F.col("q3") - F.col("q1")) * reach, df), F.lit(0))
    high = lambda df: F.col("q3") + F.greatest((F.col("q3") - F.col("q1")) * reach, df)

    def limits(by: list[str], level: int) -> DataFrame:
        found = quartiles(finest, by)
        slack = F.create_map(*[F.lit(x) for m, f in FENCES.items() for x in (m, f[2])])[F.col("metric")]
        bounds = found.withColumns({"low": low(slack), "high": high(slack)})
        aggs = [F.max("total").alias(f"rows{level}")]
        for m in FENCES:
            for end in ("low", "high"):
                aggs.append(F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}{level}"))
        return bounds.groupBy(*by).agg(*aggs)

    groups = finest.select("lang", "source").distinct()
    pairs = limits(["lang", "source"], 2)
    langs = limits(["lang"], 1)
    everything = limits([], 0).withColumn("one", F.lit(1))
    found = (
        groups.alias("g").withColumn("one", F.lit(1))
        .join(pairs.alias("p"), same(F.col("g.lang"), F.col("p.lang")) & same(F.col("g.source"), F.col("p.source")))
        .join(langs.alias("l"), same(F.col("g.lang"), F.col("l.lang")))
        .join(everything, "one")
    )
    blend = lambda rows, own, parent: (F.col(rows) * own + parent_rows * parent) / (F.col(rows) + parent_rows)
    chosen = {}
    for m in FENCES:
        for end in ("low", "high"):
            of_all, of_lang, of_pair = (F.col(f"{m}_{end}{k}") for k in range(3))
            chosen[f"{m}_{end}"] = blend("rows2", of_pair, blend("rows1", of_lang, of_all))
    table = stored(found.select(
        F.col("g.lang").alias("lang_"), F.col("g.source").alias("source_"), *[c.alias(n) for n, c in chosen.items()]
    ))
    inside = F.lit(True)
    for m, (lower, upper, _) in FENCES.items():
        if lower:
            inside = inside & (metrics[m] >= F.col(f"{m}_low"))
        if upper:
            inside = inside & (metrics[m] <= F.col(f"{m}_high"))
    joined = judged.join(
        table, same(judged.lang, table.lang_) & same(judged.source, table.source_), "left"
    )
    return joined.select(
        "doc_id", "key", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def keep_by_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by itself; all columns as they are."""
    kept = stored(_verdicts(docs).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
    ).distinct())
    alike = (
        same(docs.doc_id.cast("long"), kept["_id"]) & (text_key(docs) == kept["_key"])
        & same(docs.lang.cast("string"), kept["_lang"]) & same(docs.source.cast("string"), kept["_source"])
    )
    return docs.join(kept, alike, "left_semi")
