"""Secrets in texts: three patterns and a character Markov model, with column functions only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.shared import stored

#: fixed values: the patterns of the base rules
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _codes(run: Column) -> Column:
    """Places of a run's characters in the alphabet."""
    place = [ALPHABET.find(chr(i)) for i in range(128)]
    return F.transform(F.split(run, ""), lambda c: F.get(F.lit(place), F.ascii(c)))


def _spans(text: Column, pattern: str, rank: int, keep=None, value: int = 0, cut=None) -> Column:
    """Spans of the matches for which ``keep`` holds of the group ``value``, in code points.

    With ``cut``, the spans that it makes of a match and the match's start instead.

    Matches and the gaps before them are walked side by side, so a text costs one pass.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = [matches, F.split(text, pattern, -1)]
    if value:
        groups.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        first = acc.at + F.length(x["1"])
        last = first + F.length(F.coalesce(x["0"], F.lit("")))  # no match after the last gap
        span = F.array(F.struct(first.alias("start"), F.lit(rank).alias("rank"), last.alias("end")))
        if cut is not None:
            span = cut(x["0"], first)
        wanted = x["0"].isNotNull()
        if keep is not None:
            wanted = wanted & keep(x["2" if value else "0"])
        found = F.when(wanted, F.concat(acc.found, span)).otherwise(acc.found)
        return F.struct(last.alias("at"), found.alias("found"))

    return F.aggregate(F.arrays_zip(*groups), start, step).found


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` (null: empty) and the base rules' spans: ``assign``, ``access``, ``hex``.

    Matches of a kind are leftmost and do not overlap; an assigned value under 8 characters drops
    its match. The two other patterns ask for their least length at once, which finds the same
    matches, since a match is always a whole run.
    """
    text = F.col("text")
    none = F.expr(f"cast(array() as {_SPANS})")
    long_value = lambda v: F.length(v) >= 8
    return docs.withColumns({
        "assign": F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, long_value, value=2)).otherwise(none),
        "access": F.when(text.rlike(ACCESS), _spans(text, ACCESS, 1)).otherwise(none),
        "hex": F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none),
    })


def samples(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Labelled samples ``run, random`` for the model, from ``rows`` documents picked by hash.

    Random: digests of doc_ids, written in base 64, in hex and in letters and digits. Ordinary:
    the text's runs of the alphabet that have no digit next to a letter, as they are and in upper
    case, neighbouring runs joined in the styles of identifiers and of paths, and rulers, dates and
    numbers as texts hold them.
    """
    ids = stored(
        docs.select("doc_id").filter("doc_id is not null").distinct()
        .orderBy(F.xxhash64("doc_id")).limit(rows).select(F.col("doc_id").alias("_id"))
    )
    texts = docs.select("doc_id", "text").join(
        F.broadcast(ids), docs.doc_id == F.col("_id"), "left_semi"  # at most ``rows`` numbers
    )
    digest = F.sha2(F.col("_id").cast("string"), 512)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    random = ids.select(F.explode(F.array(
        coded, F.substring(coded, 1, 40), F.sha2(F.col("_id").cast("string"), 256),
        F.regexp_replace(coded, "[+/]", ""), F.upper(F.regexp_replace(coded, "[+/]", "")),
    )).alias("run"))
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}"), F.lit(0))
    joined = texts.select(words.alias("w")).filter(F.size("w") > 1).select(
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size("w") - 2),
            lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")),
        ))).alias("p")
    )
    ordinary = joined.select(F.explode(F.array(
        F.col("p.a"), F.upper("p.a"), F.concat_ws("_", "p.a", "p.b"), F.concat_ws("-", "p.a", "p.b"),
        F.concat_ws("/", "p.a", "p.b"), F.concat(F.lower("p.a"), F.initcap("p.b")),
        F.concat_ws("_", F.upper("p.a"), F.upper("p.b")),
        F.concat(F.col("p.a"), F.lit("="), F.abs(F.hash("p.b")) % 1000),
    )).alias("run"))
    # a ruler of each kind, a date and two numbers for every sampled document
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.abs(F.hash("_id")) % 12000).cast("int")).cast("string")
    number = (F.abs(F.xxhash64("_id")) % 1000000).cast("string")
    plain = ids.select(F.explode(F.array(
        *[F.repeat(F.lit(c), 24) for c in "-=_/+"],
        *[F.repeat(F.lit(a + b), 12) for a, b in combinations("-=_/+", 2)], F.concat_ws("_", day, day), F.concat_ws("-", number, number),
    )).alias("run"))
    return random.withColumn("random", F.lit(True)).union(ordinary.union(plain).withColumn("random", F.lit(False)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of every pair of neighbouring characters.

    Two first-order Markov models of ``labelled(run, random)``. Each class's counts are scaled to the
    same total, the smaller of the two, so that unlike numbers of samples say nothing by themselves:
    for second characters as a whole, with half a count added to each, and for the pairs after each
    first character, smoothed towards those frequencies with the weight of half the alphabet. The
    table has a row per pair of the alphabet, whatever the number of samples.
    """
    size = len(ALPHABET)
    codes = labelled.filter(F.length("run") > 1).select("random", _codes(F.col("run")).alias("c"))
    pairs = codes.select("random", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * size + F.get("c", i + 1)
    )).alias("pair"))
    counts = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    count = lambda k, a, b: counts.get((k, a * size + b), 0)
    prior = _alike([[sum(count(k, a, b) for a in range(size)) for b in range(size)] for k in (False, True)],
                   [[1 / size] * size] * 2)
    table = []
    for a in range(size):
        ordinary, random = _alike([[count(k, a, b) for b in range(size)] for k in (False, True)], prior)
        table += [round(math.log(r / o), 6) for o, r in zip(ordinary, random)]
    return table


def _alike(counts: list[list[int]], prior: list[list[float]]) -> list[list[float]]:
    """Probabilities of both classes from counts scaled to the smaller total, smoothed towards ``prior``."""
    totals = [sum(c) for c in counts]
    least, weight = min(totals), len(ALPHABET) / 2
    return [
        [(n * least / t + weight * p if t else weight * p) / (least + weight) for n, p in zip(c, q)]
        for c, t, q in zip(counts, totals, prior)
    ]


def random_runs(
    text: Column, model: list[float], least: float = 12.0, per_character: float = 1.8, cost: float = 0.35,
    shortest: int = 12,
) -> Column:
    """Spans of random stretches within runs of 16 characters or more, the best one of each run.

    The best stretch is the one with the greatest sum of the model's ratios less ``cost`` a pair,
    the first of equal ones, so an ordinary part before or after it does not count. It is a span if
    it has ``shortest`` characters and its sum of ratios reaches ``least`` and ``per_character``
    times the number of its pairs.
    """
    size = len(ALPHABET)
    table = F.lit([x - cost for x in model])
    none = F.expr(f"cast(array() as {_SPANS})")

    def best(match: Column) -> Column:
        """Start and length of the best stretch and its sum; one pass along the run."""
        state = F.struct(
            F.lit(-1).alias("c"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0.0).alias("sum"),
            F.lit(0).alias("b_first"), F.lit(0).alias("b_last"), F.lit(0.0).alias("b_sum"),
        )

        def step(acc: Column, c: Column) -> Column:
            more = F.when(acc.c >= 0, F.get(table, F.greatest(acc.c, F.lit(0)) * size + c)).otherwise(0.0)
            total = acc["sum"] + more
            anew = total <= 0  # nothing before this character helps
            first = F.when(anew, acc["at"]).otherwise(acc["first"])
            now = F.when(anew, F.lit(0.0)).otherwise(total)
            better = now > acc.b_sum
            return F.struct(
                c.alias("c"), (acc["at"] + 1).alias("at"), first.alias("first"), now.alias("sum"),
                F.when(better, first).otherwise(acc.b_first).alias("b_first"),
                F.when(better, acc["at"]).otherwise(acc.b_last).alias("b_last"),
                F.when(better, now).otherwise(acc.b_sum).alias("b_sum"),
            )

        return F.aggregate(_codes(match), state, step, lambda acc: F.struct(
            acc.b_first.alias("first"), (acc.b_last - acc.b_first + 1).alias("n"), acc.b_sum.alias("sum")))

    def cut(run: Column, start: Column) -> Column:
        """The part of a run that is random, as an array of no or one span."""
        found = F.transform(F.array(best(run)), lambda b: F.struct(
            (start + b["first"]).alias("start"), F.lit(3).alias("rank"),
            (start + b["first"] + b.n).alias("end"), b["sum"].alias("sum")))
        pairs = lambda x: x.end - x.start - 1
        wanted = F.filter(found, lambda x: (x.end - x.start >= shortest) & (x["sum"] + cost * pairs(x) >= least)
                          & (x["sum"] + cost * pairs(x) >= per_character * pairs(x)))
        return F.transform(wanted, lambda x: F.struct(x.start.alias("start"), x["rank"].alias("rank"), x.end.alias("end")))

    return F.when(text.rlike(RUN), _spans(text, RUN, 3, cut=cut)).otherwise(none)


def secret_spans(docs: DataFrame, model: list[float]) -> DataFrame:
    """``docs`` with the array column ``spans`` (start, rank of the kind, end), by start and kind.

    Base spans stay as the base rules find them; the model adds runs that touch none of them.
    """
    found = base_spans(docs.withColumn("text", F.coalesce("text", F.lit("")))).withColumn(
        "extra", random_runs(F.col("text"), model)
    ).withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end)))
    return found.withColumn("extra", free).withColumn("spans", F.array_sort(F.concat("base", "extra")))


def _listed(spans: str) -> Column:
    names = F.lit(list(KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s.start, s.end)
    return F.array_join(F.transform(spans, one), ",")


def scanned(docs: DataFrame, model: list[float]) -> DataFrame:
    """Counts per kind and the spans of every row of ``docs(doc_id, text)``, as text.

    Null and empty texts have no spans. Repeated rows each get a row. An empty table gives an
    empty result; other columns are ignored.
    """
    found = secret_spans(docs.select(F.col("doc_id"), F.col("text")), model)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.size("extra").cast("long").alias("n_random"),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame, model: list[float], mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mask`` and ``n_chars`` counted anew.

    Touching and overlapping spans become one mask. Texts without spans, null ones included, stay
    as they are. All columns of ``docs`` are kept, whatever their names.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    found = secret_spans(packed.select("row", F.col("row.text").alias("text")), model)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc.at + 1, F.greatest(s.start - acc.at, F.lit(0)))
        out = F.when((s.start > acc.at) | (acc.out == ""), F.concat(acc.out, gap, F.lit(mask))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), out.alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(
        acc.out, F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text"))
    done = found.select("row", text.alias("text"), (F.size("spans") > 0).alias("hit"))
    out = []
    for field in docs.schema.fields:
        c = F.col("row")[field.name]
        if field.name == "text":
            c = F.col("text")
        elif field.name == "n_chars":
            c = F.when(F.col("hit"), F.length("text").cast(field.dataType)).otherwise(c)
        out.append(c.alias(field.name))
    return done.select(*out)
