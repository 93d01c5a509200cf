"""Near-duplicate documents by MinHash with sequential Bayesian verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmart.llm.near import Rule, near_groups
from snapmart.llm.shared import same, stored, text_key
from snapmart.llm.words import MinHash, set_hash, shingles, word_hashes


def _signed(rule: Rule, size: int):
    maker = MinHash(rule.bands, rule.rows)

    def run(batches):
        for pdf in batches:
            n, units, sigs, keys = [], [], [], []
            for text in pdf.text:
                found = np.unique(shingles(word_hashes(text, lower=True), size))
                n.append(len(found))
                if not len(found):
                    units.append(None), sigs.append(None), keys.append(None)
                    continue
                signature = maker.signature(found)
                units.append(set_hash(found))
                sigs.append(signature.astype(np.uint16).tobytes())
                keys.append(maker.keys(signature))
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "key": pdf.key, "n": n, "unit": pd.array(units, dtype="Int64"), "sig": sigs, "keys": keys,
            })

    return run


def _sets(size: int):
    def run(batches):
        for pdf in batches:
            found = [np.unique(shingles(word_hashes(text, lower=True), size)) for text in pdf.text]
            yield pd.DataFrame({"unit": [set_hash(x) if len(x) else 0 for x in found],
                                "set": [x.tobytes() for x in found]})

    return run


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), shingle: int = 5) -> DataFrame:
    """Group of near-duplicates of every row of ``docs(doc_id, text)``; other columns are ignored.

    Two documents are linked if the sets of their ``shingle``-word runs (A-Z lower-cased; all words
    if there are fewer) reach the rule's similarity. Returns doc_id, n_shingles, component_id (the
    least doc_id reachable over links) and kept (doc_id = component_id), a row for each input row.

    Documents without words (null, empty, blank) are linked with nothing. Equal sets form one unit
    before banding, so copies cost one row each. Rows that repeat a doc_id are judged by their
    texts and share the id's verdict; a null doc_id belongs to its group, whose id is the least
    non-null one. An empty table gives an empty result.
    """
    signed, members = _grouped(docs, rule, shingle)
    ids = members.groupBy("label").agg(F.min("first").alias("component_id"))
    of_unit = stored(members.join(ids, "label").select("unit", "component_id"))
    component = F.when(F.col("unit").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        signed.select("doc_id", F.col("n").alias("n_shingles"), "unit").join(of_unit, "unit", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", same(F.col("doc_id"), F.col("component_id")))
    )


def _grouped(docs: DataFrame, rule: Rule, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows with the hash of their text and their unit; units with their least doc_id and label."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                         text_key(docs).alias("key"))
    signed = stored(source.mapInPandas(
        _signed(rule, shingle), "doc_id long, key long, n long, unit long, sig binary, keys array<long>"
    ))
    classes = stored(
        signed.filter("unit is not null").groupBy("unit")
        .agg(F.min("doc_id").alias("first"), F.min("n").alias("n"))
    )
    # one row of each class; any of its rows has the same signature
    unique = signed.filter("unit is not null").join(
        classes.select("unit", "first"),
        (signed.unit == classes.unit) & same(signed.doc_id, classes["first"]), "left_semi"
    ).select("unit", "n", "sig", "keys").dropDuplicates(["unit"])

    def sets_of(needed: DataFrame) -> DataFrame:
        ids = classes.join(needed, "unit").select(F.col("first").alias("id")).distinct()
        texts = source.join(ids, same(source.doc_id, ids.id), "left_semi").select("text")
        found = texts.mapInPandas(_sets(shingle), "unit long, set binary")
        return found.join(needed, "unit", "left_semi").dropDuplicates(["unit"])

    groups = near_groups(unique, sets_of, rule)
    members = classes.join(groups, "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    return signed, members


def without_near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns as they are.

    Rows are judged, not ids: rows that share a doc_id, or have none, are told apart by their texts.
    The row that stays is the group's least by doc_id (null last), set of word runs, hash of the
    text and hash of the other columns. A text without words is in no group: all rows of it stay,
    but those that repeat a doc_id and text count once.
    """
    signed, members = _grouped(docs, rule)
    order = F.struct(F.col("first").isNull(), F.col("first"), F.col("unit"))
    heads = members.groupBy("label").agg(F.min(order).alias("head")).select("head.unit", "head.first")
    counted = signed.groupBy("unit", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    least = (
        counted.join(heads, (counted.unit == heads.unit) & same(counted.doc_id, heads["first"]), "left_semi")
        .groupBy("unit", "doc_id").agg(F.min(F.struct("key", "rows")).alias("row"))
        .select("doc_id", "row.key", "row.rows")
    )
    blank = counted.filter("unit is null").select(
        "doc_id", "key", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.col("rows")).alias("rows")
    )
    kept = stored(least.unionByName(blank).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("rows").alias("_rows")))
    # rows of no pair below stay as they are; whole rows move for pairs that repeat only, while they are few
    twice = stored(kept.filter("_rows > 1"))
    pairs = signed.select(F.col("doc_id").alias("id"), "key").distinct()
    gone = pairs.join(kept, same(pairs.id, kept["_id"]) & (pairs.key == kept["_key"]), "left_anti").toDF("_id", "_key")
    gone = stored(gone.unionByName(twice.select("_id", "_key")))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    of = lambda table: same(docs.doc_id.cast("long"), table["_id"]) & (text_key(docs) == table["_key"])
    once = docs.join(gone, of(gone), "left_anti")
    again = docs.join(twice, of(twice)).select(
        twice["_id"].alias("id"), twice["_key"].alias("key"), F.struct(*columns).alias("row"))
    again = stored(again.withColumn("tie", F.xxhash64(F.to_json("row"))))
    first = again.groupBy("id", "key").agg(F.min("tie").alias("tie")).select(
        F.col("id").alias("id_"), F.col("key").alias("key_"), F.col("tie").alias("tie_"))
    alike = same(again.id, first.id_) & (again.key == first.key_) & (again.tie == first.tie_)
    one = again.join(first, alike, "left_semi").dropDuplicates(["id", "key"])
    return once.unionByName(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))
