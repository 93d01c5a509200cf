"""Ranked search, periodic runs and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapmart.llm import hash_forest, max_sketch, runs
from snapmart.llm.words import mix
from tests.llm.helpers import SCHEMA, UPPER, clashing, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


# ---- ranked search ---------------------------------------------------------------------------


def brute_ranks(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(UPPER))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, counts, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in wanted if counts[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -less) for r, (less, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def items_of(rows):
    rnd = random.Random(3)
    full = [t for _, t, *_ in rows if t and len(t) > 40]
    items = [(i, " ".join(rnd.sample(rnd.choice(full).split(), 12)) + " nowhere-found") for i in range(25)]
    return items + [(100, None), (101, ""), (102, "?! "), (None, "one a b"), (3, "One é"), (3, "One é"), (103, "one")]


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_ranks_equal_brute_force(spark, block):
    rows = [*documents(2), (None, "one two", "en", "a", 7), (5000, "one " * 700, "en", "a", 1)]
    items = items_of(rows)
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    found = max_sketch.ranked(docs, clashing(spark.createDataFrame(items, ITEMS)), block_bytes=block).collect()
    assert sorted(map(tuple, found), key=str) == brute_ranks([(d, t) for d, t, *_ in rows], items)


def test_ranks_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], ITEMS)
    assert max_sketch.ranked(docs.limit(0), items).count() == 0
    assert max_sketch.ranked(docs, items.limit(0)).count() == 0
    assert max_sketch.ranked(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
    assert max_sketch.ranked(docs, items.withColumn("text", F.lit(" "))).count() == 0


def test_sketch_never_underestimates():
    random_ = np.random.default_rng(1)
    terms = np.unique(random_.integers(0, 1 << 63, 3000, dtype=np.uint64))
    counts = random_.integers(1, 400, len(terms)).astype(np.uint32)
    sketch = np.frombuffer(max_sketch.sketch_of(terms, counts), np.uint8)
    least = np.min([sketch[at & (len(sketch) - 1)] for at in max_sketch.coordinates(terms)], axis=0)
    assert (least >= np.minimum(counts, max_sketch.FULL)).all()
    absent = random_.integers(0, 1 << 63, 20000, dtype=np.uint64)
    taken = np.min([sketch[at & (len(sketch) - 1)] for at in max_sketch.coordinates(absent)], axis=0) > 0
    assert taken.mean() < 0.005


# ---- periodic runs ---------------------------------------------------------------------------


def brute_runs(w, times=4, least=6):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                if all(any(w[k] != w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                    out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = (None if doc_id is None else zlib.crc32(str(doc_id).encode())), len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force_on_random_words():
    rnd = random.Random(5)
    for _ in range(1500):
        n, k = rnd.randint(0, 60), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.randint(1, k) for _ in range(n)]
        if rnd.random() < 0.6 and n > 6:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [rnd.randint(1, k) for _ in range(rnd.choice([0, 10]))]
        times, least = rnd.choice([(4, 6), (4, 6), (2, 6), (3, 9)])
        assert runs.word_runs(mix(np.array(w, np.uint64)), times, least) == brute_runs(w, times, least)


def test_runs_of_documents(spark):
    rnd = random.Random(8)
    rows = [(d, t) for d, t, *_ in documents(4)]
    rows += [(None, "x y " * 9), (7001, "a " * 6), (7002, "a " * 5), (7003, "a\x0bb\x1c \n" * 4), (7004, "é ß " * 8 + "  end")]
    rows += [(7100 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 80)))) for i in range(60)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    found = runs.digest(runs.periodic_runs(runs.with_repeated_tails(docs)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((brute_row(*r) for r in rows), key=str)


def test_runs_of_a_very_long_text_and_of_no_rows(spark):
    rnd = random.Random(2)
    w = [f"w{rnd.randint(0, 3000)}" for _ in range(60000)]
    root = [f"r{i}" for i in range(900)]
    w[20000:20000 + 9000] = root * 10
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(20000, 9000, 900)]
    assert row["collapsed"].split() == w[:20900] + w[29000:]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=1)


# ---- nearest neighbours ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def brute_nearest(rows, k=20, every=20):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float32).astype(float)
    out = {}
    for q in ids[ids % every == 0]:
        score = (x * x[ids == q][0]).sum(1)
        other = ids != q
        order = np.lexsort((ids[other], -score[other]))[:k]
        out[q] = list(zip(ids[other][order].tolist(), score[other][order].tolist(), strict=True))
    return out


def clustered(n, dims=24, seed=0, scale=False):
    random_ = np.random.default_rng(seed)
    centres = random_.standard_normal((40, dims)) * 3
    x = centres[random_.integers(0, 40, n)] + random_.standard_normal((n, dims))
    if scale:
        x *= random_.uniform(0.2, 3, (n, 1))
    return {i: row.astype(np.float32).tolist() for i, row in enumerate(x)}


def searched(spark, rows, **how):
    df = spark.createDataFrame(list(rows), VECTORS).repartition(3)
    out = {}
    for r in hash_forest.nearest(clashing(df), **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_with_ranges_and_blocks(spark, scale):
    rows = clustered(3000, scale=scale)
    small = hash_forest.Search(points=256, queries=16, least=64, sample=60)
    found, true = searched(spark, rows.items(), search=small), brute_nearest(rows)
    assert found.keys() == true.keys() and all(len(v) == 20 for v in found.values())
    hits = [len({i for i, _ in found[q]} & {i for i, _ in true[q]}) / 20 for q in true]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(v) for q, v in true.items()}
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(exact[q].get(i, s) - s) < 1e-9 for i, s in near)


def test_a_full_budget_is_exact_with_copies_ties_and_odd_rows(spark):
    rows = clustered(300, dims=6, seed=4)
    for i in range(0, 160):
        rows[i] = rows[0]  # more copies than neighbours asked for, queries among them
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [float("nan")] * 6), (1080, [1.0]),
           (None, [1.0] * 6), (1100, []), (1120, [float("inf")] * 6), (2, rows[2])]
    found = searched(spark, [*rows.items(), *odd], search=hash_forest.Search(least=1 << 20))
    true = brute_nearest(rows)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in true.items()}


def test_few_and_no_vectors(spark):
    assert searched(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]) == {0: [(1, 0.5), (2, -1.0)]}
    assert searched(spark, [(20, [1.0, 2.0])]) == {}
    assert searched(spark, [(1, [1.0, 2.0])]) == {}
    assert searched(spark, [(1, None)]) == {}
    assert hash_forest.nearest(spark.createDataFrame([], VECTORS)).count() == 0
