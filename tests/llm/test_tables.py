"""URL lists, mixing, classifier and pipeline."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from snapmart.llm import cotraining, mixing, queries, url_filters
from tests.llm.helpers import SCHEMA, clashing, documents, words

SF = "/root/testdata/sf0.001"


def test_url_keys(spark):
    urls = {
        "https://User@Blog.X.example.com:8080/en/a/b?q=1#t": [
            "blog.x.example.com", "x.example.com", "example.com", "blog.x.example.com/en", "blog.x.example.com/en/a"],
        "http://example.com": ["example.com"], "ftp://example.com/x": None, "": None, "nonsense": None, None: None,
        "http://localhost/a": ["localhost", "localhost/a"],
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("keys", url_filters.list_keys(F.col("url")))
    assert {r.url: r.keys for r in df.collect()} == urls


def test_url_list_as_of(spark):
    rnd = random.Random(2)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(60))
    keys = ["example.com", "a.example.com", "b.example.com", "example.com/x", "a.example.com/x/y", "other.org", "A.Example.com"]
    entries = [(rnd.choice(keys), day(), rnd.choice(["add", "remove"])) for _ in range(120)]
    entries += entries[:5] + [(None, day(), "add"), ("other.org", None, "add"), ("other.org", day(), "what")]
    urls = ["http://a.example.com/x/y/z", "http://b.example.com/x", "http://example.com/q", "https://other.org/", "bad", None]
    captures = [(i, rnd.choice(urls), rnd.choice([day(), day(), None])) for i in range(300)] + [(1, urls[0], day())] * 3
    covers = {
        urls[0]: ["a.example.com", "example.com", "a.example.com/x", "a.example.com/x/y"],
        urls[1]: ["b.example.com", "example.com", "b.example.com/x"], urls[2]: ["example.com", "example.com/q"],
        urls[3]: ["other.org"], "bad": [], None: [],
    }
    listed = defaultdict(dict)
    for key, when, action in entries:
        if key and when and action in ("add", "remove"):
            listed[key.lower()][when] = listed[key.lower()].get(when, False) or action == "add"

    def since(key, at):
        start = None
        for when in sorted(listed[key]):
            if when <= at:
                start = (start or when) if listed[key][when] else None
        return start

    wanted = []
    for i, url, at in captures:
        active = [(-len(k), k, since(k, at)) for k in covers[url] if at and since(k, at)]
        best = min(active) if active else (0, None, None)
        wanted.append((i, at, len(active), best[1], best[2], bool(active)))
    df = clashing(spark.createDataFrame(captures, "page_id long, url string, fetched date"))
    got = url_filters.evaluated(df, spark.createDataFrame(entries, "key string, day date, action string"))
    rows = [(r.page_id, r.fetched, r.n_entries, r.entry, r.since, r.blocked) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(wanted, key=str)
    none = spark.createDataFrame([], "key string, day date, action string")
    assert url_filters.evaluated(df, none).filter("blocked").count() == 0
    assert url_filters.evaluated(df.limit(0), none).count() == 0


def weights_at(tokens, exponent):
    total = sum(tokens.values())
    p = {s: (t / total) ** exponent for s, t in tokens.items()}
    z = sum(p.values())
    return {s: x / z for s, x in p.items()}


def test_exponent(spark):
    tokens = {"a": 9000, "b": 900, "c": 90, None: 10}
    shares = mixing.source_shares(spark.createDataFrame(list(tokens.items()), "source string, tokens long"))
    entropy = lambda e: -sum(w * math.log(w) for w in weights_at(tokens, e).values())
    for target in (0.6, 1.0, 1.3):
        e = mixing.fitted_exponent(shares, 10_000, entropy=target)
        assert entropy(e) == pytest.approx(target, abs=1e-4)
    assert mixing.fitted_exponent(shares, 10_000, entropy=9.0) == 0
    assert mixing.fitted_exponent(shares, 10_000, entropy=0.01) == 1
    e = mixing.fitted_exponent(shares, 10_000, entropy=1.3, repetition=4.0)
    most = max(w * 10_000 / tokens[s] for s, w in weights_at(tokens, e).items())
    assert most == pytest.approx(4.0, abs=1e-3)
    assert mixing.fitted_exponent(shares, 100_000, repetition=4.0) == 1


def test_mix_of_rows_that_share_id_and_text(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "t", 5), (2, "d e f", "en", "s", 5), (2, "d e f", "de", "s", 5),
            (3, "g h", "en", "s", 3), (3, "g h", "en", "s", 3), (None, "i j", None, None, 3), (None, "i j", "xx", None, 3)]
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA), budget=21.0, entropy_share=0.0).collect()
    assert len({(r.source, r.mix_start) for r in out}) == len(out)  # each draw is one row
    for source in {r[3] for r in rows}:
        mine = [tuple(r)[:5] for r in out if r.source == source and r.mix_epoch == 0]
        budget = next(r.mix_weight for r in out if r.source == source) * 21
        if sum(len(words(r[1])) for r in rows if r[3] == source) <= budget + 1e-6:
            assert sorted(mine, key=str) == sorted((r for r in rows if r[3] == source), key=str)
        assert set(mine) <= set(rows)


def test_mix_meets_budgets(spark):
    rows = documents(11)
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = mixing.mixed(df, entropy_share=0.98, block_tokens=400)
    assert out.columns[:len(df.columns)] == df.columns
    got = out.collect()
    size = [(r[0], r[1], r[3], len(words(r[1]))) for r in rows if words(r[1])]
    tokens = defaultdict(int)
    for _, _, s, n in size:
        tokens[s] += n
    drawn = defaultdict(list)
    for r in got:
        drawn[r.source].append((r.mix_start, len(words(r.text)), r.mix_epoch, r.doc_id))
    assert set(drawn) == set(tokens)
    for s, picks in drawn.items():
        picks.sort()
        weight = next(r.mix_weight for r in got if r.source == s)
        budget, at = weight * sum(tokens.values()), 0
        for start, n, _, _ in picks:
            assert start == at  # the draws follow each other without a gap
            at += n
        assert picks[-1][0] < budget + 1e-3 <= at + 1e-3 + picks[-1][1]
        for epoch in range(max(p[2] for p in picks)):  # each full pass holds every document once
            assert sorted(p[3] for p in picks if p[2] == epoch) == sorted(d for d, _, q, _ in size if q == s)
    assert sum({r.source: r.mix_weight for r in got}.values()) == pytest.approx(1, abs=1e-6)
    again = mixing.mixed(df.repartition(5), entropy_share=0.98, block_tokens=400).collect()
    key = lambda r: (r.doc_id, r.mix_epoch, r.mix_block, r.mix_start)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, "en", "a", 0)], SCHEMA)).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = cotraining.quality_scores(docs, labels)
    assert found.count() == docs.count()
    held = found.filter("held_out").join(cotraining.target(labels), "doc_id")
    assert held.selectExpr("avg(cast((kept and good = 1) or (not kept and good = 0) as int))").first()[0] > 0.95


def test_classifier_without_labels(spark):
    df = clashing(spark.createDataFrame(documents(1), SCHEMA))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality long, toxic long")
    got = cotraining.quality_scores(df, labels).collect()
    assert len(got) == df.count() and all(r.kept and r.score is None for r in got)
    assert cotraining.quality_scores(df.limit(0), labels).count() == 0


def test_classifier_takes_nulls(spark):
    rows = documents(1)
    good = {r[0] for r in rows[::2]}
    labels = [(r[0], int(r[0] in good), 0) for r in rows] + [(1, 0, 1)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = cotraining.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    assert got.count() == len(rows) and got.filter("score is null or score < 0 or score > 1").count() == 0


def test_all_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, corpus_pipeline.stored(stage(spark, at, SF))
        if name != "temperature mixing":
            assert at.columns == docs.columns and at.count() <= before.count()
    ids = at.select("doc_id").distinct()
    assert ids.join(docs, "doc_id", "left_anti").count() == 0 and at.count() > 0


def test_pipeline_takes_an_empty_table(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
    assert at.count() == 0
