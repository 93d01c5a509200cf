"""Quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.shared import stored
from snapmart.llm.words import SPACE, letter_words, word_hashes

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]] = True


def target(labels: DataFrame) -> DataFrame:
    """``doc_id, good``: 1 for good quality that is not toxic; the worst of a document's labels."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good"))
    return rows.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))


def fold(doc_id: Column) -> Column:
    """A number from 0 to 4 that depends on the id alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(5)).cast("int")


def _distinct_words(batches):
    for pdf in batches:
        for text, good in zip(pdf.text, pdf.good, strict=True):
            yield pd.DataFrame({"word": np.unique(letter_words(text)).view(np.int64), "good": good})


def vocabulary(texts: DataFrame, words: int) -> list[int]:
    """Hashes of the ``words`` words whose document frequencies differ most between the classes."""
    seen = texts.mapInPandas(_distinct_words, "word long, good int")
    counts = seen.groupBy("word").agg(F.sum("good").alias("g"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    total = texts.agg(F.sum("good"), F.count(F.lit(1))).first()
    g, n = float(total[0] or 0), float(total[1] or 1)
    rate = F.col("n") / n
    z = (F.col("g") - g * rate) / F.sqrt(g * (1 - g / n) * rate * (1 - rate) + 1)
    best = counts.orderBy(F.abs(z).desc(), "word").limit(words).select("word").collect()  # at most ``words``
    return sorted(r.word for r in best)


def _text_view(vocabulary: list[int]):
    known = np.sort(np.array(vocabulary, np.int64).view(np.uint64))

    def run(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), len(known) + 5), np.float32)
            for row, text in zip(out, pdf.text, strict=True):
                if not text:
                    continue
                raw = np.frombuffer(text, np.uint8)
                words, plain = word_hashes(text, lower=True), letter_words(text)
                if len(known) and len(plain):
                    at = np.minimum(np.searchsorted(known, plain), len(known) - 1)
                    hits = np.bincount(at[known[at] == plain], minlength=len(known))
                    row[:-5] = np.log1p(hits)
                solid = max(int((~SPACE[raw]).sum()), 1)
                row[-5:] = (
                    _UPPER[raw].sum() / solid, _MARKS[raw].sum() / solid,
                    len(np.unique(words)) / max(len(words), 1), solid / max(len(words), 1) / 10,
                    np.log1p(len(words)) / 10,
                )
            yield pdf[["doc_id", "meta"]].assign(view=list(out)).astype({"doc_id": "Int64"})

    return run


def _metadata(docs: DataFrame) -> Column:
    """Language, source and length as numbers; nulls are values of their own."""
    bit = lambda c, n: [(F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)) == k).cast("float") for k in range(n)]  # noqa: E731, E501
    length = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.array(*bit("lang", 8), *bit("source", 32), (length / 10).cast("float"),
                   F.pow(length / 10, 2).cast("float"))


def _logit(model: LogisticRegressionModel, vector: Column) -> Column:
    """The model's linear score, as a column."""
    weights = F.lit([float(w) for w in model.coefficients])
    return F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(float(model.intercept)), lambda s, x: s + x)


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    vectors = rows.select(array_to_vector(F.col(view).cast("array<double>")).alias("features"), "label", "weight")
    return LogisticRegression(maxIter=25, regParam=1e-3, weightCol="weight").fit(vectors)


def _calibrated(rows: DataFrame, logit: Column) -> tuple[float, float]:
    """Platt's slope and intercept from labelled rows outside of training; the slope is not negative."""
    one = rows.select(array_to_vector(F.array(logit)).alias("features"), F.col("good").cast("double").alias("label"))
    model = LogisticRegression(maxIter=25).fit(one)
    return max(float(model.coefficients[0]), 0.0), float(model.intercept)


def quality_scores(
    docs: DataFrame, labels: DataFrame, rounds: int = 3, sure: float = 0.98, words: int = 128,
    sample: int = 20_000, pseudo_weight: float = 0.3,
) -> DataFrame:
    """Probability that each row of ``docs(doc_id, text, lang, source, n_chars)`` is good.

    Good means quality 1 and not toxic in ``labels(doc_id, quality, toxic)``. The text view holds
    counts of the ``words`` words that tell the classes apart best, chosen on at most ``sample``
    labelled documents (those with the least hashes), and shares of characters and words; the
    metadata view holds language, source and length. In each round both views are fitted on the
    labels of folds 2-4 and on the pseudo-labels that the other view gives to unlabelled documents
    with calibrated probability above ``sure`` or below 1 - ``sure``. Fold 0 calibrates, fold 1 is
    left out of everything (held_out), for tests. The combined log-odds are the sum of both
    calibrated views less the prior's.

    Returns doc_id, held_out, p_text, p_metadata, score, kept (score at least 1/2). All rows are
    scored, repeated ones each. Null and empty texts have an empty text view; nulls in metadata are
    values of their own. Without labels of both classes in the training folds and in fold 0, all
    scores are null and all rows kept. An empty table gives an empty result.
    """
    known = stored(target(labels).withColumn("fold", fold(F.col("doc_id"))))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        _metadata(docs).alias("meta"),
    )
    both = known.filter("fold != 1").groupBy((F.col("fold") == 0).alias("c")).agg(F.countDistinct("good").alias("n"))
    if len([r for r in both.collect() if r.n == 2]) < 2:
        nothing = F.lit(None).cast("double")
        return source.select(
            "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), nothing.alias("p_text"),
            nothing.alias("p_metadata"), nothing.alias("score"), F.lit(True).alias("kept"),
        )
    picked = stored(known.filter("fold > 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(
        F.col("doc_id").alias("id"), "good"))
    texts = source.join(F.broadcast(picked), source.doc_id == F.col("id")).select("text", "good")
    chosen = vocabulary(stored(texts), words)
    views = source.mapInPandas(_text_view(chosen), "doc_id long, meta array<float>, view array<float>")
    rows = stored(views).join(known.select(F.col("doc_id").alias("id"), "good", "fold"), F.col("doc_id") == F.col("id"), "left")
    rows = stored(rows.select("doc_id", "meta", "view", "good", "fold"))

    given = rows.filter("good is not null and fold > 1").select(
        "view", "meta", F.col("good").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    held = rows.filter("good is not null and fold = 0")
    free = rows.filter("good is null")
    extra = {"view": None, "meta": None}
    for _ in range(rounds):
        p, logits = {}, {}
        for view in ("view", "meta"):
            train = given if extra[view] is None else given.union(extra[view])
            logit = _logit(_fit(train, view), F.col(view))
            slope, shift = _calibrated(held, logit)
            logits[view] = logit * slope + shift
            p[view] = 1 / (1 + F.exp(-logits[view]))
        for view, other in (("view", "meta"), ("meta", "view")):
            label = F.when(p[other] > sure, 1.0).when(p[other] < 1 - sure, 0.0)
            extra[view] = free.select("view", "meta", label.alias("label"), F.lit(pseudo_weight).alias("weight")).filter(
                "label is not null")
    prior = given.agg(F.avg("label")).first()[0]
    total = logits["view"] + logits["meta"] - float(np.log(prior / (1 - prior)))
    score = 1 / (1 + F.exp(-total))
    return rows.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), p["view"].alias("p_text"),
        p["meta"].alias("p_metadata"), score.alias("score"),
    ).withColumn("kept", F.col("score") >= 0.5)
