"""URL lists with dated entries, joined to captures as of their fetch time; column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.shared import ascii_lower


def host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without user, port and closing dot; null if there is none."""
    found = F.regexp_extract(ascii_lower(url), r"^[ \t]*https?://(?:[^/?#@]*@)?([^/?#:@ ]+)", 1)
    clean = F.regexp_replace(found, r"\.+$", "")
    return F.when(F.length(clean) > 0, clean)


def path_folders(url: Column) -> Column:
    """``host/first``, ``host/first/second``: up to two path folders under the host."""
    path = F.regexp_extract(url, r"^[ \t]*[a-zA-Z]+://[^/?#]+(/[^?#]*)?", 1)
    parts = F.filter(F.slice(F.split(path, "/"), 2, 2), lambda x: x != "")
    whole = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat_ws("/", host(url), F.array_join(F.slice(parts, 1, n), "/")),
    )
    return F.when(F.size(parts) > 0, whole).otherwise(F.expr("cast(array() as array<string>)"))


def list_keys(url: Column) -> Column:
    """All list keys that cover a URL: its host, every parent domain of two labels or more, folders."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    return F.when(host(url).isNotNull(), F.array_distinct(F.concat(parents, path_folders(url))))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``key, since, until`` (until excluded, null: open) from ``entries(key, day, action)``.

    ``action`` 'add' begins and 'remove' ends an interval; on one day 'add' wins. An add while
    active and a remove while inactive change nothing. Keys are compared in lower case. Rows with a
    null key or day or another action are left out. Days are merged before the window, so a key
    holds at most one row per day there, however often it is listed.
    """
    valid = entries.filter(
        F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove")
    )
    daily = valid.groupBy(ascii_lower(F.col("key")).alias("key"), F.col("day").cast("date").alias("day")).agg(
        F.max(F.col("action") == "add").alias("on")
    )
    by_day = Window.partitionBy("key").orderBy("day")
    changes = daily.withColumn("before", F.lag("on", 1, False).over(by_day)).filter(
        F.col("on") != F.col("before"))
    return changes.withColumn("until", F.lead("day").over(by_day)).filter("on").select(
        "key", F.col("day").alias("since"), "until"
    )


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures(page_id, url, fetched)`` with the list's verdict as of ``fetched``.

    A capture is blocked if an entry that covers its URL (host, parent domain, or up to two path
    folders) was active on its day. Adds host, n_entries (entries active then), entry (the longest
    such key, the first of equally long ones) and since (the day from which it was active), blocked.

    Verdicts are found once for each distinct URL and day and joined back, so repeated captures are
    cheap and all rows stay. URLs without an http(s) host and null URLs have a null host and no
    entry; a null day meets no entry. Empty lists block nothing; an empty table gives an empty
    result; other columns are ignored.
    """
    asked = captures.select("url", "fetched").distinct().filter("url is not null and fetched is not null")
    keyed = asked.withColumn("key", F.explode(list_keys(F.col("url"))))
    spans = validity(entries)
    active = keyed.join(spans, "key").filter(
        (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    )
    best = F.min(F.struct((-F.length("key")).alias("l"), "key", "since"))
    verdicts = active.groupBy("url", "fetched").agg(F.count(F.lit(1)).alias("n"), best.alias("b")).select(
        F.col("url").alias("u"), F.col("fetched").alias("f"), "n", F.col("b.key").alias("entry"),
        F.col("b.since").alias("since"),
    )
    joined = captures.select("page_id", "url", "fetched").join(
        verdicts, (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left"
    )
    return joined.select(
        "page_id", host(F.col("url")).alias("host"), "fetched", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        "entry", "since", F.col("n").isNotNull().alias("blocked"),
    )


#: fixed values: domains on the standing list and the days of their entries
STANDING = [
    ("spam-farm.example.org", "2024-01-01", "add"),
    ("spam-farm.example.org", "2024-06-01", "remove"),
    ("spam-farm.example.org", "2024-09-01", "add"),
    ("cheap-pills.example.com", "2024-03-01", "add"),
    ("free-bets.example.com", "2024-02-15", "add"),
    ("ads-track.example.org", "2024-01-15", "add"),
    ("ads-track.example.org", "2024-11-01", "remove"),
]


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch day spread over 2024 by page_id, as the table has none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def observed_entries(captures: DataFrame) -> DataFrame:
    """List entries that follow from the captures themselves, a history for each host.

    A host whose least page_id is a multiple of 7 is listed 30 days after its first capture, taken
    off after 60 more, and listed again on day 300.
    """
    seen = captures.filter("page_id is not null").groupBy(host(F.col("url")).alias("key")).agg(
        F.min("page_id").alias("least"), F.min("fetched").alias("first")
    ).filter("key is not null and least % 7 = 0")
    steps = F.explode(F.array(
        F.struct(F.date_add("first", 30).alias("day"), F.lit("add").alias("action")),
        F.struct(F.date_add("first", 90).alias("day"), F.lit("remove").alias("action")),
        F.struct(F.lit("2024-10-27").cast("date").alias("day"), F.lit("add").alias("action")),
    )).alias("e")
    return seen.select("key", steps).select("key", "e.day", "e.action")


def standing_entries(captures: DataFrame) -> DataFrame:
    return captures.sparkSession.createDataFrame(STANDING, "key string, day string, action string").select(
        "key", F.col("day").cast("date").alias("day"), "action"
    )
