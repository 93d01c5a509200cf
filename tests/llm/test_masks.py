"""The masks against the 80 % rule alone."""

from __future__ import annotations

import itertools
import random

import pytest

from snapmart.llm import decontamination
from tests.llm.test_text_scans import tokens


@pytest.mark.parametrize("width", range(5, 21))
def test_masks_miss_no_pattern(width):
    for masks in (decontamination.masks_for(width, 80), decontamination.MASKS):
        for bad in itertools.combinations(range(width), width // 5):
            equal = "".join("0" if k in bad else "1" for k in range(width))
            assert any(
                all(e == "1" for e, m in zip(equal[p:], mask, strict=False) if m == "1")
                for mask in masks for p in range(width - len(mask) + 1)
            ), (masks, equal)


def test_other_shares_fall_back_on_runs():
    assert decontamination.masks_for(100, 80) == ("1111",)
    assert decontamination.masks_for(20, 50) == ("1",)
    assert decontamination.masks_for(20, 100) == decontamination.HEAVY


def by_rule(docs, items, window=20, share=80):
    found = {}
    for d, text in docs:
        x = tokens(text)
        for i, item in items:
            y = tokens(item)
            w = min(window, len(y))
            for shift in range(-len(y) + 1, len(x)):
                same = [0 <= shift + k < len(x) and x[shift + k] == y[k] for k in range(len(y))]
                best = max(sum(same[s:s + w]) for s in range(len(y) - w + 1))
                if best * 100 >= w * share:
                    found[(d, i)] = max(found.get((d, i), (0, 0, -10**9)), (best, w, -shift))
    return {(*k, v[0], v[1], -v[2]) for k, v in found.items()}


def test_every_alignment_that_reaches_the_share(spark):
    rnd = random.Random(3)
    prose = lambda n: [f"v{rnd.randrange(500)}" for _ in range(n)]
    items = [(n, " ".join(prose(n))) for n in (5, 6, 7, 10, 11, 12, 16, 18, 19, 20, 40, 100)]
    docs = []
    for n, text in items:
        for k in range(8):
            part = text.split()
            bad = list(range(k, n, 5))[:n // 5] if k < 5 else rnd.sample(range(n), n // 5)
            for j in bad:
                part[j] = f"other{j}"
            docs.append((len(docs), " ".join(prose(rnd.randint(0, 9)) + part + prose(rnd.randint(0, 9)))))
    wanted = by_rule(docs, items)
    assert len(wanted) >= len(docs)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontamination.contaminated(*frames).collect()} == wanted
