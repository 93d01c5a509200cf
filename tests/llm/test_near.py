"""Near-duplicates, repeated paragraphs and components against all pairs."""

from __future__ import annotations

import random

import pytest

from snapmart.llm import near, near_dedup, paragraphs
from snapmart.llm.components import components
from snapmart.llm.near import Rule, near_groups
from tests.llm.helpers import SCHEMA, clashing, documents, shingle_set, words


def least_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def linked(x, y, num, den):
    return bool(x) and bool(y) and den * len(x & y) >= num * len(x | y)


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)]
    links += [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(7, 7), (5, None)]
    rnd.shuffle(links)
    got = {r.unit: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == least_reachable({n for e in real for n in e}, real)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates(spark, small):
    """``small=1`` sends every mixed bucket through the exact prefix join."""
    rows = documents()
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = near_dedup.near_duplicates(df, Rule(small=small)).collect()
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if linked(sets[a], sets[b], 85, 100)]
    label = least_reachable(ids, links)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert len(set(label.values())) < len(ids) - 30


def test_later_links_only_tie_groups_together(spark, monkeypatch):
    """No link is worked out twice: what comes later is given between the groups that are there."""
    given = []

    def counting(links):
        given.append({frozenset((r.a, r.b)) for r in links.collect() if r.a != r.b})
        return components(links)

    monkeypatch.setattr(near, "components", counting)
    rnd = random.Random(2)
    units = [(k, 1, sorted(rnd.sample(range(60), 3))) for k in range(1, 61)]
    # odd and even units are alike among themselves only
    sets_of = lambda df: df.selectExpr("unit", "cast(repeat(cast(unit % 2 as string), 8) as binary) as set")
    got = near_groups(spark.createDataFrame(units, "unit long, n long, keys array<long>"), sets_of, Rule()).collect()
    links = [(a, b) for a, _, x in units for b, _, y in units if a < b and a % 2 == b % 2 and {*x} & {*y}]
    assert {r.unit: r.label for r in got} == least_reachable({k for e in links for k in e}, links)
    assert len(given) > 1 and all(given) and sum(map(len, given)) == len(set().union(*given))


def test_one_of_each_group_stays(spark):
    rows = documents(2)
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    kept = near_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    wanted = {r.doc_id for r in near_dedup.near_duplicates(df).collect() if r.kept}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f g"), (4, "A b c d e f g"), (None, None), (9, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=str) == sorted(
        [(None, 4, False), (4, 4, True), (None, None, True), (9, 9, True)], key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_dedup.without_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_bounds():
    bounds = Rule().needed()
    assert [n for n, _ in bounds] == [25, 50, 75, 100, 125]
    assert all(0 < m < 0.85 * n for n, m in bounds)


def test_long_text(spark):
    rnd = random.Random(5)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(900_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 5_000_000)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles == len(shingle_set(long)) and got[3].n_shingles == 1


def brute_paragraphs(rows, least):
    units = {}
    for doc_id, text, *_ in rows:
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            if len(words(line)) >= least:
                units[(doc_id, k)] = (shingle_set(line), at, at + len(line))
            at += len(line) + 1
    keys = sorted(units)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if linked(units[a][0], units[b][0], 80, 100)]
    label = least_reachable(keys, links)
    size = {}
    for k in keys:
        size[label[k]] = size.get(label[k], 0) + 1
    return {(k[0], k[1], units[k][1], units[k][2], len(units[k][0]), *label[k], size[label[k]], label[k] != k)
            for k in keys if size[label[k]] > 1}


def test_repeated_paragraphs(spark):
    rows = documents(4)
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {tuple(r) for r in paragraphs.repeated_paragraphs(df).collect()}
    wanted = brute_paragraphs(rows, 20)
    assert got == wanted and any(r[-1] for r in wanted)


def test_paragraphs_are_cut(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"head\n{line}\ntail"), (2, f"other\n{line}"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in paragraphs.without_repeats(df).collect()} == {1: rows[0][1], 2: "other", 3: None}
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_of_units_without_links(spark):
    units = spark.createDataFrame([], "unit long, n long, sig binary, keys array<long>")
    sets_of = lambda df: df.selectExpr("unit", "cast(null as binary) as set")
    assert near_groups(units, sets_of, Rule()).count() == 0
