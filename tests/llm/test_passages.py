"""Repeated passages inside lines and in wrapped text against all runs of words."""

from __future__ import annotations

import random

import pandas as pd

from snapmart.llm import paragraphs
from tests.llm.helpers import WORD, words


def covered(rows, size):
    """Words of each row in a run that occurs at two places, and in one that is not its first place."""
    places = {}
    for doc_id, text in rows:
        w = words(text)
        for p in range(len(w) - size + 1):
            places.setdefault(tuple(w[p:p + size]), []).append((doc_id, p))
    out = {True: set(), False: set()}
    for found in places.values():
        if len(found) > 1:
            for k, (doc_id, p) in enumerate(sorted(found)):
                out[k > 0] |= {(doc_id, j) for j in range(p, p + size)}
    return out


def test_runs_anywhere(spark):
    rnd = random.Random(9)
    prose = lambda n: [f"é{rnd.randrange(900)}" for _ in range(n)]
    passages = [prose(n) for n in (50, 51, 81, 140)]
    rows = []
    for k in range(24):
        part = passages[k % 4] if k < 20 else prose(49)
        text = prose(rnd.randint(0, 60)) + part + prose(rnd.randint(0, 60))
        rows.append((k, (" " if k % 3 else "\n").join(text).replace("\n", "\n" if k % 2 else " \t")))
    rows += [(50, " ".join(passages[1] + prose(9) + passages[1])), (51, " ".join(["same"] * 90)), (52, None), (53, "")]
    twice = prose(60)
    rows += [(54, " ".join(twice + prose(40) + twice).upper()), (55, rows[20][1][:200])]
    alike = prose(40)
    rows += [(60, " ".join(alike)), (61, " ".join([*alike[:-1], "other"]))]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(5)
    wanted, texts, got = covered(rows, 50), dict(rows), {True: set(), False: set()}
    for r in paragraphs.repeated_runs(df).collect():
        inside = [j for j, m in enumerate(WORD.finditer(texts[r.doc_id])) if r.start <= m.start() and m.end() <= r.end]
        assert len(inside) == r.n_words and r.occurrences > 1
        got[r.removed] |= {(r.doc_id, j) for j in inside}
    assert got == wanted and len(wanted[True]) > 1000
    assert {r.kind for r in paragraphs.repeated_passages(df).collect()} == {"paragraph", "run"}
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0


def test_wrapped_paragraphs_with_changes(spark):
    text = [f"w{k}" for k in range(90)]
    other = [*text[:40], "x", *text[41:]]
    wrap = lambda w, n: "\n".join(" ".join(w[k:k + n]) for k in range(0, len(w), n))
    rows = [(1, "A head.\n\n" + wrap(text, 9) + "\n\nend"), (2, wrap(other, 12)), (3, wrap(text[:15], 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.paragraph, r.start, r.end, r.removed) for r in paragraphs.repeated_paragraphs(df).collect()}
    assert got == {(1, 2, 9, len(rows[0][1]) - 5, False), (2, 0, 0, len(rows[1][1]), True)}
    assert {r.doc_id: r.text for r in paragraphs.without_repeats(df).collect()} == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_paragraphs_are_signed_in_the_pass_that_finds_them(spark, monkeypatch):
    """Every text is cut into paragraphs once for places and band keys, and once more for the sets asked for."""
    cut = spark.sparkContext.accumulator(0)
    of = paragraphs.Paragraphs.of

    class Counting(paragraphs.Paragraphs):
        def of(self, text):
            cut.add(len(text))
            return of(self, text)

    monkeypatch.setattr(paragraphs, "Paragraphs", Counting)
    rnd = random.Random(3)
    prose = [" ".join(f"w{rnd.randrange(10**5)}" for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(prose), (90, prose[3]), (91, f"{prose[4]}\n\n{prose[4]}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.kept_doc_id, r.removed) for r in paragraphs.repeated_paragraphs(df).collect())
    assert got == [(3, 0, 3, False), (4, 0, 4, False), (90, 0, 3, True), (91, 0, 4, True), (91, 2, 4, True)]
    assert sum(map(len, prose)) < cut.value < 1.5 * sum(map(len, prose))


def test_spots_of_a_slice_come_together():
    texts = ["é one\n\n two", "", "ß  three é"]
    asked = pd.DataFrame({"key": [5, 6, 7], "text": [t.encode() for t in texts], "asked": [[2, 0], [], [1, 2]]})
    slices = list(paragraphs._spots([asked]))
    assert len(slices) == 1
    assert slices[0].values.tolist() == [[5, 2, 8, 11], [5, 0, 0, 1], [7, 1, 3, 8], [7, 2, 9, 10]]


def test_tables_that_are_done_with_are_deleted(spark, monkeypatch):
    """Band keys and the blocks of all texts are gone when the result is there; the result does not need them."""
    tables, stored = [], paragraphs.stored
    monkeypatch.setattr(paragraphs, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    text = " ".join(f"w{k}" for k in range(70))
    found = paragraphs.repeated_passages(spark.createDataFrame([(1, text), (2, f"head\n{text}")], "doc_id long, text string"))
    folder = lambda df: spark._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    left = [df.columns for df in tables if folder(df).exists()]
    assert sum("keys" in c for c in left) == 0 and sum("anchor" in c and "at" in c for c in left) == 1
    assert {(r.kind, r.doc_id, r.removed) for r in found.collect()} == {(k, d, d == 2) for k in ("paragraph", "run") for d in (1, 2)}
