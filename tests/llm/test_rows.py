"""Stages judge rows: different texts under one null or repeated doc_id each get their own verdict."""

from __future__ import annotations

import random

import pytest

from snapmart.llm import decontamination, near_dedup, quality_rules
from tests.llm.helpers import SCHEMA, clashing

rnd = random.Random(4)
PROSE = [" ".join(f"word{rnd.randrange(10**4)}" for _ in range(80)) for _ in range(6)]


@pytest.mark.parametrize("shared", [None, 7])
def test_near_duplicates_of_one_id(spark, shared):
    rows = [(shared, t, "en", "a", len(t)) for t in PROSE[:4]]
    rows += [rows[0], (shared, PROSE[1] + " end", "en", "b", 0), (3, PROSE[2], "en", "a", 1), (9, PROSE[4], "en", "a", 1)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = [(r.doc_id, r.text, r.source) for r in near_dedup.without_near_duplicates(df).collect()]
    assert len(got) == 5 and {g[1] for g in got} - {PROSE[1] + " end"} >= {PROSE[0], PROSE[2], PROSE[3], PROSE[4]}
    assert (3, PROSE[2], "a") in got and len({t[:500] for _, t, _ in got}) == 5


def test_the_row_that_stays_is_fixed(spark):
    rows = [(None, PROSE[0], "en", s, 1) for s in "abcdefgh"]
    found = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows[parts % 5:] + rows[:parts % 5], SCHEMA).repartition(parts)
        found |= {tuple(r) for r in near_dedup.without_near_duplicates(df).collect()}
    assert len(found) == 1


@pytest.mark.parametrize("shared", [None, 7])
def test_contaminated_rows_of_one_id(spark, shared):
    rows = [(shared, PROSE[0]), (shared, PROSE[1]), (shared, None)]
    bench = spark.createDataFrame([(1, PROSE[1][80:400])], "item_id long, text string")
    clean = decontamination.without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(clean.collect(), key=str) == sorted([rows[0], rows[2]], key=str)


@pytest.mark.parametrize("shared", [None, 7])
def test_quality_of_rows_of_one_id(spark, shared):
    rows = [(shared, PROSE[0], None, "a", 1), (shared, "too short", None, "a", 1), (shared, None, "en", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in quality_rules.keep_by_quality(df).collect()] == rows[:1]


def test_whole_rows_stay_in_place_while_few_go(spark):
    """The rows that go decide the last join, not those that stay: whole rows are not shuffled for a few copies."""
    own = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "a", 1) for k in range(1500)]
    rows = [*own, (9000, own[3][1], "en", "a", 1), own[5], (5, own[5][1], "en", "b", 2), (None, own[7][1], "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        out = near_dedup.without_near_duplicates(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.doc_id, r.text) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(k, t) for k, t, *_ in own]
    assert "LeftAnti, BuildRight" in plan
