"""Groups of sets whose Jaccard similarity reaches a threshold, found by banded MinHash.

Units are distinct sets. Candidates share a band. A candidate pair passes a sequential Bayesian
test on its signatures, then an exact comparison of both full sets. No bucket is expanded into all
its pairs: every member is first compared with the heads of its buckets, where a bucket's head is
the member that meets most others over all of its own buckets, so the middle of a group of copies.
What these links leave apart is compared in full in small buckets, and by an exact prefix join in
large ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.components import components
from snapmart.llm.shared import stored


@dataclass(frozen=True)
class Rule:
    """Link if ``den * |A & B| >= num * |A | B|``.

    ``miss`` is the posterior probability of a link under which the signature test gives a pair
    up, ``step`` the number of signature values that it looks at before each decision. Buckets
    with up to ``small`` members are compared in full.
    """

    num: int = 85
    den: int = 100
    bands: int = 25
    rows: int = 5
    miss: float = 1e-9
    step: int = 25
    small: int = 32

    def needed(self) -> list[tuple[int, int]]:
        """(values seen, least number of equal ones to go on).

        With a uniform prior, P(J >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
        """
        t, out, size = self.num / self.den, [], self.bands * self.rows
        for n in range(self.step, size + 1, self.step):
            below, m = 0.0, -1
            while below < self.miss and m < n:
                m += 1
                below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def tuned(t: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values so that a pair of similarity ``t`` shares one at this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - t**rows))


def _signature_test(rule: Rule):
    needed = rule.needed()

    def run(batches):
        for pdf in batches:
            n = np.minimum(pdf.na, pdf.nb), np.maximum(pdf.na, pdf.nb)
            alive = np.flatnonzero(rule.den * n[0].to_numpy() >= rule.num * n[1].to_numpy())
            if len(alive):
                a = np.frombuffer(b"".join(pdf.sa.iloc[alive]), np.uint16).reshape(len(alive), -1)
                b = np.frombuffer(b"".join(pdf.sb.iloc[alive]), np.uint16).reshape(len(alive), -1)
                equal, seen = np.zeros(len(alive), int), 0
                for upto, least in needed:
                    equal = equal + (a[:, seen:upto] == b[:, seen:upto]).sum(1)
                    go = equal >= least
                    alive, a, b, equal, seen = alive[go], a[go], b[go], equal[go], upto
            yield pdf.iloc[alive][["a", "b"]]

    return run


def _exact_test(rule: Rule):
    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf.xa, pdf.xb, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(rule.den * common >= rule.num * (len(x) + len(y) - common))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _verified(pairs: DataFrame, units: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links: the signature test if there is one, then full sets."""
    likely = pairs
    if "sig" in units.columns:
        narrow = units.select("unit", "n", "sig")
        signed = pairs.join(narrow.toDF("a", "na", "sa"), "a").join(narrow.toDF("b", "nb", "sb"), "b")
        likely = signed.mapInPandas(_signature_test(rule), "a long, b long")
    both = likely.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    return stored(both.mapInPandas(_exact_test(rule), "a long, b long"))


def _labelled(df: DataFrame, labels: DataFrame, unit: str, label: str) -> DataFrame:
    return df.join(labels.toDF(unit, label), unit, "left").withColumn(label, F.coalesce(label, unit))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of all links so far once ``links`` come to them: only what these tie together is worked out."""
    ends = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb")
    groups = stored(components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))))
    if groups.isEmpty():
        return labels
    new = groups.join(labels.select("unit"), "unit", "left_anti")
    old = labels.join(groups.toDF("label", "to"), "label", "left").select("unit", F.coalesce("to", "label").alias("label"))
    return stored(old.unionByName(new))


def _prefix_pairs(crowd: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of ``crowd(unit, label)`` with different labels that can be links, found exactly.

    Elements are ordered from rare to frequent. Two linked sets share an element early in both
    orders, and the place of the first shared one bounds their overlap.
    """
    def elements(batches):
        for pdf in batches:
            for unit, label, raw in zip(pdf.unit, pdf.label, pdf["set"], strict=True):
                x = np.frombuffer(raw, np.int64)
                yield pd.DataFrame({"unit": unit, "label": label, "n": len(x), "x": x})

    each = stored(crowd.join(sets, "unit").mapInPandas(elements, "unit long, label long, n long, x long"))
    common = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy("df", "x")) - 1
    early = each.join(common, "x").withColumn("place", place).filter(
        (F.col("df") > 1) & (F.col("place") * rule.den <= F.col("n") * (rule.den - rule.num))
    ).select("unit", "label", "n", "x", "place")
    early = stored(early)
    a = early.toDF("a", "la", "na", "x", "pa")
    b = early.toDF("b", "lb", "nb", "x", "pb")
    fits = F.expr(
        f"la != lb and (na < nb or (na = nb and a < b)) and {rule.den} * na >= {rule.num} * nb and "
        f"least(na - pa, nb - pb) * {rule.num + rule.den} >= {rule.num} * (na + nb)"
    )
    return a.join(b, "x").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(units: DataFrame, sets_of: Callable[[DataFrame], DataFrame], rule: Rule) -> DataFrame:
    """``unit`` and ``label`` of every unit that has a link; the label is the group's least unit.

    ``units``: unit (long, distinct), n (set size), keys (band keys) and, for the
    signature test, sig (binary, 16-bit values); without it pairs are compared exactly at once.
    ``sets_of(df of unit)`` gives those units' sets: unit, set (binary, sorted 64-bit values).
    """
    keyed = units.select("unit", F.explode("keys").alias("key"))
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    crowd = stored(keyed.join(members, "key"))
    weights = crowd.groupBy("unit").agg(F.sum("members").alias("weight"))
    crowd = crowd.join(weights, "unit")
    heads = crowd.groupBy("key").agg(F.max(F.struct("weight", "unit")).alias("head"))
    crowd = stored(crowd.drop("weight").join(heads, "key"))
    there = crowd.select("unit").distinct()
    sets = stored(sets_of(there))
    units = units.drop("keys")
    if "sig" in units.columns:
        units = stored(units.join(there, "unit"))

    stars = crowd.filter("unit != head.unit")
    first = stored(stars.groupBy(F.col("unit").alias("b")).agg(F.max("head").alias("h")).select(
        F.col("h.unit").alias("a"), "b"))
    stars = stars.select("unit", F.col("head.unit").alias("head"))
    labels = stored(components(_verified(first, units, sets, rule)))

    apart = _labelled(_labelled(stars, labels, "unit", "lu"), labels, "head", "lh").filter("lu != lh")
    second = apart.select(F.col("head").alias("a"), F.col("unit").alias("b")).distinct()
    second = stored(second.join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        labels = _joined(labels, _verified(second, units, sets, rule))

    crowd = stored(_labelled(crowd, labels, "unit", "label"))
    mixed = crowd.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = stored(crowd.join(mixed.filter("low != high").select("key"), "key"))
    small = mixed.filter(F.col("members") <= rule.small).select("key", "unit", "label")
    third = small.toDF("key", "a", "la").join(small.toDF("key", "b", "lb"), "key").filter("a < b and la != lb").select("a", "b")
    large = stored(mixed.filter(F.col("members") > rule.small).select("unit", "label").distinct())
    if not large.isEmpty():
        third = third.union(_prefix_pairs(large, sets, rule))
    third = stored(third.distinct().join(first.union(second), ["a", "b"], "left_anti"))
    return labels if third.isEmpty() else _joined(labels, _verified(third, units, sets, rule))
