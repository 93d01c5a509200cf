"""Small document tables and plain-Python words for the brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def shingle_set(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset((size, *w[i:i + size]) for i in range(len(w) - size + 1))


def documents(seed=1, groups=12):
    """Rows with exact and near copies, shared passages, blanks, nulls and odd characters."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = " ".join(prose(60))
    texts = [None, "", " \n\t", "One", "one", "a b c", "A b c d", "x\x1cy z", "é Ünïcode ß 😀 text " * 4]
    for _ in range(groups):
        base = prose(rnd.randint(30, 160))
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(rnd.randint(0, 6)):
            copy = list(base)
            for _ in range(rnd.randint(1, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:20]) + "\n" + passage + "\n" + " ".join(prose(15)))
    star = prose(150)
    for k in range(60):
        copy = list(star)
        for _ in range(k % 7):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary) + "x"
        texts.append(" ".join(copy))
    rows = [(i * 3 + 1, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", None]), len(t or ""))
            for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows.append(rows[0])  # a repeated row
    return rows


def clashing(df):
    """``df`` with extra columns that have names used inside the operators."""
    from pyspark.sql import functions as F

    names = ["unit", "key", "n", "label", "tokens", "_id", "_rows", "row", "spans", "a.b", "seed", "block"]
    return df.withColumns({n: F.lit("?") for n in names})
