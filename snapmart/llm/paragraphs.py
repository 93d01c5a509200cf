"""Repeated paragraphs, by MinHash banding and exact Jaccard similarity, and repeated word runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.near import Rule, near_groups, tuned
from snapmart.llm.shared import discard, same, stored
from snapmart.llm.words import MULTIPLIER, MinHash, mix, spans, word_hashes

#: 11 bands of 4 values find a pair of similarity 0.8 with probability 0.995, one of 0.9 with 0.99999
RULE = Rule(num=80, den=100, bands=tuned(0.8, 0.995, 4), rows=4)


class Paragraphs:
    """The paragraphs of a text with at least ``least`` words, as sets of ``size``-word shingles.

    A paragraph is a line of that many words, or neighbouring shorter lines (wrapped text) up to
    the next blank or long line, named by the first of them.
    """

    def __init__(self, least: int, size: int):
        self.least, self.size = least, size

    def of(self, text: bytes | None):
        """First and last lines, spans in code points, set sizes, the sets end to end, and their hashes."""
        if not text:
            return None
        raw = np.frombuffer(text, np.uint8)
        words = word_hashes(text, lower=True)
        starts, ends = spans(raw)
        if len(words) < self.least:
            return None
        breaks = np.flatnonzero(raw == 10)
        line = np.searchsorted(breaks, starts)
        count = np.bincount(line, minlength=len(breaks) + 1)
        number = np.arange(len(count))
        short = (count > 0) & (count < self.least)
        follows = short & np.append(False, short[:-1])  # noqa: FBT003
        head = np.maximum.accumulate(np.where(follows, 0, number))
        last = number.copy()
        np.maximum.at(last, head, number)
        line = head[line]
        count = np.bincount(line, minlength=len(count))
        chosen = count >= self.least
        if not chosen.any():
            return None
        n = len(words) - self.size + 1
        run = words[:n].copy()
        for k in range(1, self.size):
            run = run * MULTIPLIER + words[k:n + k]
        run, at = mix(run), line[:n]
        good = (at == line[self.size - 1:]) & chosen[at]
        run, at = run[good], at[good]
        order = np.argsort(run)
        place = at.astype(np.uint16) if len(count) <= 1 << 16 else at  # short numbers sort in linear time
        order = order[np.argsort(place[order], kind="stable")]
        run, at = run[order], at[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1])
        run, at = run[new], at[new]
        lines, first, sizes = np.unique(at, return_index=True, return_counts=True)
        hashes = mix(np.add.reduceat(mix(run ^ MULTIPLIER), first) + sizes.astype(np.uint64)).view(np.int64)
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        begin = np.concatenate(([0], breaks + 1))[lines]
        end = np.concatenate((breaks, [len(raw)]))[last[lines]]
        return lines, last[lines], points[begin], points[end], sizes, first, run, hashes


#: texts that are hashed together, in bytes; a longer text is hashed by itself
TOGETHER = 1 << 22


def _together(pdf: pd.DataFrame):
    """Slices of neighbouring rows whose texts have about TOGETHER bytes."""
    upto = pdf.text.map(len).cumsum().to_numpy() // TOGETHER
    edges = np.flatnonzero(np.diff(upto, prepend=-1, append=-1))
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        yield pdf.iloc[begin:end]


def _parted(texts: pd.Series) -> tuple[bytes, np.ndarray]:
    """The texts with blank lines between them, so that no paragraph crosses, and where each begins."""
    return b"\n\n".join(texts), np.cumsum(np.array([0] + [len(t) + 2 for t in texts[:-1]]))


def _joined(texts: pd.Series) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with blank lines between them, the row of each word, and each row's first word."""
    text, begins = _parted(texts)
    starts, _ = spans(np.frombuffer(text, np.uint8))
    row = np.searchsorted(begins, starts, "right") - 1
    return text, row, np.searchsorted(row, np.arange(len(begins)))


def _found(maker: Paragraphs, rule: Rule):
    """Paragraphs with their band keys; a set that repeats within a slice has them at its first place only."""
    signer = MinHash(rule.bands, rule.rows)

    def run(batches):
        for pdf in batches:
            for part in _together(pdf):
                text, begins = _parted(part.text)
                found = maker.of(text)
                if found is None:
                    continue
                lines, last, begin, end, sizes, first, run, hashes = found
                raw = np.frombuffer(text, np.uint8)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[begins]
                base = np.searchsorted(np.flatnonzero(raw == 10), begins)  # lines before each text
                row = np.searchsorted(base, lines, "right") - 1
                high = (run >> np.uint64(32)).astype(np.uint32)
                # one hash function at a time: memory stays that of the words
                sig = np.stack([np.minimum.reduceat(high * a + b, first) for a, b in zip(signer.a, signer.b, strict=True)], 1)
                _, one = np.unique(hashes, return_index=True)
                rows = sig[one].reshape(len(one), rule.bands, rule.rows).astype(np.uint64)
                key = np.broadcast_to(np.arange(rule.bands, dtype=np.uint64), rows.shape[:2])
                for k in range(rule.rows):
                    key = mix(key * MULTIPLIER + rows[:, :, k])
                keys = np.full(len(hashes), None, object)
                for k, x in zip(one, key.view(np.int64), strict=True):
                    keys[k] = x
                yield pd.DataFrame({
                    "doc_id": part.doc_id.to_numpy()[row], "paragraph": lines - base[row], "last": last - base[row],
                    "start": begin - points[row], "end": end - points[row], "unit": hashes, "n": sizes, "keys": keys,
                }).astype({"doc_id": "Int64"})

    return run


def _sets(maker: Paragraphs):
    def run(batches):
        for pdf in batches:
            for part in _together(pdf):
                found = maker.of(_parted(part.text)[0])
                if found is None:
                    continue
                _, _, _, _, _, first, run, hashes = found
                whole = np.split(run, first[1:])
                _, one = np.unique(hashes, return_index=True)
                yield pd.DataFrame({"unit": hashes[one], "set": [whole[k].tobytes() for k in one]})

    return run


def repeated_paragraphs(docs: DataFrame, rule: Rule = RULE, least_words: int = 20, shingle: int = 5) -> DataFrame:
    """Paragraphs of ``docs(doc_id, text)`` that occur more than once: a row per occurrence.

    A paragraph is a line of at least ``least_words`` words, or neighbouring shorter lines with as
    many together, as of wrapped text; what is shorter recurs by chance. Two are
    linked if their sets of ``shingle``-word runs (A-Z lower-cased) reach the rule's Jaccard
    similarity, compared exactly for paragraphs that share a band. Groups are the components; the
    first occurrence by doc_id and paragraph stays, all others are removals.

    Returns doc_id, paragraph (number of its first line, from 0), start and end (code points, end
    excluded), n_shingles, kept_doc_id and kept_paragraph (the group's first occurrence),
    occurrences (of the group) and removed. Equal sets are one unit before banding. Rows that
    repeat a doc_id and paragraph count once; a null doc_id sorts first. Null and empty texts have
    no paragraphs; an empty table gives an empty result; other columns are ignored.
    """
    return _repeated(docs, rule, least_words, shingle).drop("last")


def _repeated(docs: DataFrame, rule: Rule, least_words: int, shingle: int = 5) -> DataFrame:
    """:func:`repeated_paragraphs` with ``last``, the number of the paragraph's last line."""
    maker = Paragraphs(least_words, shingle)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    source = source.filter("text is not null")
    # places and band keys in one pass over the texts
    signed = stored(source.mapInPandas(
        _found(maker, rule),
        "doc_id long, paragraph long, last long, start long, end long, unit long, n long, keys array<long>"))
    found = stored(signed.drop("keys").dropDuplicates(["doc_id", "paragraph", "unit"]))
    place = F.struct("doc_id", "paragraph")
    classes = stored(found.groupBy("unit").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")))
    units = stored(signed.filter("keys is not null").groupBy("unit").agg(F.first("keys").alias("keys")))
    discard(signed)

    def sets_of(needed: DataFrame) -> DataFrame:
        ids = classes.join(needed, "unit").select(F.col("first.doc_id").alias("id")).distinct()
        texts = source.join(ids, same(source.doc_id, ids.id), "left_semi").select("text")
        sets = texts.mapInPandas(_sets(maker), "unit long, set binary")
        return sets.join(needed, "unit", "left_semi").groupBy("unit").agg(F.first("set").alias("set"))

    groups = near_groups(units, sets_of, rule)
    discard(units)
    members = classes.join(groups, "unit", "left").withColumn("label", F.coalesce("label", "unit"))
    whole = members.groupBy("label").agg(F.min("first").alias("kept"), F.sum("rows").alias("occurrences"))
    of_unit = stored(members.join(whole.filter("occurrences > 1"), "label").select("unit", "kept", "occurrences"))
    return found.join(of_unit, "unit").select(
        "doc_id", "paragraph", "last", "start", "end", F.col("n").alias("n_shingles"),
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.paragraph").alias("kept_paragraph"), "occurrences",
        (~(same(F.col("doc_id"), F.col("kept.doc_id")) & (F.col("paragraph") == F.col("kept.paragraph")))).alias("removed"),
    )


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, put together from runs of powers of two."""
    if len(words) < size:
        return words[:0]
    block, length, out, done = words, 1, None, 0
    while done < size:
        if size & length:
            n = len(words) - done - length + 1
            power = np.uint64(pow(int(MULTIPLIER), length, 1 << 64))
            out = block if out is None else out[:n] * power + block[done:done + n]
            done += length
        if done < size:
            power = np.uint64(pow(int(MULTIPLIER), length, 1 << 64))
            block = block[:-length] * power + block[length:]
            length *= 2
    return mix(out + np.uint64(size))


def _least(values: np.ndarray, view: int) -> np.ndarray:
    """Place of the least value among each ``view`` neighbours, the first of equal ones."""
    at, reach = np.arange(len(values)), 1
    while 2 * reach <= view:
        a, b = at[:-reach], at[reach:]
        at = np.where(values[b] < values[a], b, a)
        reach *= 2
    n = len(values) - view + 1
    a, b = at[:n], at[view - reach:view - reach + n]
    return np.where(values[b] < values[a], b, a)


def _blocks(size: int):
    """Blocks of neighbouring runs of ``size`` words that have the same anchor at the same place.

    The anchor of a run is the least by hash of its runs of half that many words. It depends on
    those words only, so equal runs have equal anchors and lie at the same place of their block.
    """
    half = size // 2
    view = size - half + 1

    def run(batches):
        for pdf in batches:
            for part in _together(pdf):
                text, row, base = _joined(part.text)
                words = word_hashes(text, lower=True)
                if len(words) < size:
                    continue
                anchors, runs = _windows(words, half), _windows(words, size)
                place = _least(anchors, view)
                at = np.flatnonzero(row[:len(runs)] == row[size - 1:])
                if not len(at):
                    continue
                new = np.append(True, (np.diff(at) != 1) | (np.diff(place[at]) != 0))  # noqa: FBT003
                n = np.diff(np.append(np.flatnonzero(new), len(at)))
                at = at[new]
                # first and last run overlap, so they hold all words of the block
                content = mix(runs[at] * MULTIPLIER + runs[at + n - 1] + n.astype(np.uint64))
                of = row[at]
                yield pd.DataFrame({
                    "doc_id": part.doc_id.to_numpy()[of], "key": part.key.to_numpy()[of], "at": at - base[of], "n": n,
                    "anchor": anchors[place[at]].view(np.int64), "content": content.view(np.int64),
                }).astype({"doc_id": "Int64"})

    return run


def _runs_of(size: int):
    """Every run of ``size`` words of the blocks asked for: block, place in it, hash."""
    def run(batches):
        for pdf in batches:
            for part in _together(pdf):
                text, _, base = _joined(part.text)
                runs = _windows(word_hashes(text, lower=True), size)
                lengths = [len(a) for a in part["at"]]
                n = np.concatenate([np.asarray(a, np.int64) for a in part.n])
                at = np.concatenate([np.asarray(a, np.int64) for a in part["at"]]) + np.repeat(base, lengths)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                content = np.concatenate([np.asarray(a, np.int64) for a in part.content])
                yield pd.DataFrame({"content": np.repeat(content, n), "i": i,
                                    "run": runs[np.repeat(at, n) + i].view(np.int64)})

    return run


def _spots(batches):
    """Span in code points of each word asked for; texts of a slice together."""
    for pdf in batches:
        for part in _together(pdf):
            text, begins = _parted(part.text)
            raw = np.frombuffer(text, np.uint8)
            starts, ends = spans(raw)
            of = np.repeat(np.arange(len(begins)), [len(a) for a in part.asked])
            asked = np.concatenate([np.asarray(a, np.int64) for a in part.asked])
            word = asked + np.searchsorted(starts, begins)[of]
            inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no code point
            points = lambda at: at - np.searchsorted(inner, at)  # noqa: E731, B023
            origin = points(begins)[of]
            yield pd.DataFrame({"key": part.key.to_numpy()[of], "word": asked,
                                "start": points(starts[word]) - origin, "end": points(ends[word]) - origin})


def repeated_runs(docs: DataFrame, size: int = 50) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` of ``size`` or more words that occur more than once, word for word.

    A passage may lie anywhere: inside of lines, across lines, twice in one text. Words are compared
    with A-Z lower-cased, white space is not. Of each run of ``size`` words the occurrence that is
    first by doc_id (null first), hash of the row and place stays. A row per longest stretch of
    neighbouring runs that stay, or that go: doc_id, start and end (code points, end excluded),
    n_words, kept_doc_id and kept_start (of the first run), occurrences (of the most frequent run)
    and removed. Rows that repeat a doc_id and text count once; null and empty texts have no runs,
    an empty table gives an empty result, a very long text is one row of a task.

    Texts are cut into blocks of neighbouring runs with one anchor. Equal blocks are one: its single
    runs are looked at only where blocks differ around the same anchor, so the work for copies is a
    row per block, and no repeated run is lost.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    source = source.filter("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    texts = source.select("key", "text")
    blocks = stored(source.mapInPandas(
        _blocks(size), "doc_id long, key long, at long, n long, anchor long, content long"))
    shared = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("anchor")
    everywhere, blocks = blocks, stored(blocks.join(shared, "anchor").distinct())
    discard(everywhere)
    rows = F.count(F.lit(1)).alias("rows")
    contents = stored(blocks.groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "key", "at")).alias("first"), F.max("n").alias("n"), rows))
    several = contents.groupBy("anchor").agg(rows).filter("rows > 1").select("anchor")
    mixed = stored(contents.join(several, "anchor"))

    asked = mixed.groupBy("first.key").agg(  # at most the blocks of one text
        F.collect_list(F.struct("first.at", "n", "content")).alias("b")).select("key", "b.at", "b.n", "b.content")
    runs = texts.join(asked, "key").mapInPandas(_runs_of(size), "content long, i long, run long").distinct()
    runs = stored(runs.join(mixed.select("content", "first", "rows"), "content"))
    place = F.struct("first.doc_id", "first.key", (F.col("first.at") + F.col("i")).alias("at"))
    whole = runs.groupBy("run").agg(F.min(place).alias("f"), F.sum("rows").alias("rows")).filter("rows > 1")
    each = runs.select("content", "i", "run").join(whole, "run").withColumn("shift", F.col("f.at") - F.col("i"))
    alike = ["content", "f.doc_id", "f.key", "shift", "rows"]
    order = Window.partitionBy("content", "f.key", "shift", "rows").orderBy("i")  # at most a block's runs
    parts = each.withColumn("part", F.col("i") - F.row_number().over(order)).groupBy(*alike, "part").agg(
        F.min("i").alias("low"), F.max("i").alias("high"))
    f = F.struct(F.col("doc_id"), F.col("key"), (F.col("shift") + F.col("low")).alias("at")).alias("f")
    parts = parts.select("content", "low", "high", f, "rows").unionByName(
        contents.join(several, "anchor", "left_anti").filter("rows > 1").select(
            "content", F.lit(0).cast("long").alias("low"), (F.col("n") - 1).alias("high"), F.col("first").alias("f"), "rows"))

    found = blocks.join(parts, "content").select(
        "doc_id", "key", (F.col("at") + F.col("low")).alias("at"), (F.col("at") + F.col("high")).alias("last"), "f", "rows")
    found = found.withColumn("removed", (F.col("key") != F.col("f.key")) | (F.col("at") != F.col("f.at")))
    row = Window.partitionBy("key", "removed").orderBy("at")
    new = F.when(F.col("at") == F.lag("last").over(row) + 1, 0).otherwise(1)
    stretches = found.withColumn("new", new).withColumn("stretch", F.sum("new").over(row))
    stretches = stored(stretches.groupBy("doc_id", "key", "removed", "stretch").agg(
        F.min("at").alias("first"), (F.max("last") + size - 1).alias("last"), F.min(F.struct("at", "f")).alias("f"),
        F.max("rows").alias("occurrences"),
    ).select("doc_id", "key", "removed", "first", "last", F.col("f.f").alias("f"), "occurrences"))

    own = stretches.select("key", F.explode(F.array("first", "last")).alias("word"))
    wanted = own.union(stretches.select("f.key", "f.at")).groupBy("key").agg(F.collect_set("word").alias("asked"))
    spots = stored(texts.join(wanted, "key").mapInPandas(
        _spots, "key long, word long, start long, end long").distinct())
    begin, end, kept = spots.alias("b"), spots.alias("e"), spots.alias("k")
    return (
        stretches.alias("s")
        .join(begin, (F.col("s.key") == F.col("b.key")) & (F.col("s.first") == F.col("b.word")))
        .join(end, (F.col("s.key") == F.col("e.key")) & (F.col("s.last") == F.col("e.word")))
        .join(kept, (F.col("s.f.key") == F.col("k.key")) & (F.col("s.f.at") == F.col("k.word")))
        .select("s.doc_id", "b.start", "e.end", (F.col("s.last") - F.col("s.first") + 1).alias("n_words"),
                F.col("s.f.doc_id").alias("kept_doc_id"), F.col("k.start").alias("kept_start"), "occurrences", "removed")
    )


def repeated_passages(docs: DataFrame, size: int = 50) -> DataFrame:
    """Repeated paragraphs, alike or equal, and repeated runs of ``size`` or more words anywhere.

    The rows of :func:`repeated_paragraphs` (kind "paragraph") and :func:`repeated_runs` (kind
    "run"), with null in columns that a kind does not have. Spans of the two may overlap.
    """
    whole = repeated_paragraphs(docs).withColumn("kind", F.lit("paragraph"))
    runs = repeated_runs(docs, size).withColumn("kind", F.lit("run"))
    return whole.unionByName(runs, allowMissingColumns=True)


def without_repeats(docs: DataFrame, rule: Rule = RULE, least_words: int = 20) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of ``text``; all columns and rows stay."""
    cut = _repeated(docs, rule, least_words).filter("removed")
    cut = cut.select("doc_id", F.explode(F.sequence("paragraph", "last")).alias("line")).groupBy("doc_id").agg(
        F.collect_set(F.col("line").cast("int")).alias("lines")  # at most a document's lines
    )
    cut = stored(cut.select(F.col("doc_id").alias("_id"), F.col("lines").alias("_lines")))
    lines = F.split(docs.text, "\n")
    left = F.transform(
        F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                 lambda s: ~F.array_contains(cut["_lines"], s.i)), lambda s: s.x)
    text = F.when(cut["_lines"].isNotNull(), F.array_join(left, "\n")).otherwise(docs.text)
    joined = docs.join(cut, same(docs.doc_id.cast("long"), cut["_id"]), "left")
    return joined.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
