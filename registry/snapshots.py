"""Reading, writing and lining up snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import derive, query, table
from snapmart.operators import columns
from snapmart.sources import snapshots as snap

ORDER_MONTHS_SQL = """
    select cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n from orders group by 1
"""


def _orders(spark, sf_dir):
    """Orders as snapshots of their month."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.floor("o_totalprice").alias("amount"),
        snap.first_of_month("o_orderdate").alias("snapshot_date"),
    )


@query(
    "q_month_spine",
    """
    select cast(cast(unnest(generate_series(
        (select date_trunc('month', min(o_orderdate)) from orders),
        (select max(o_orderdate) from orders), interval 1 month)) as date) as varchar) as snapshot_date
    """,
)
def spine(spark, sf_dir):
    """Every month from the first to the last order."""
    orders = table(spark, sf_dir, "orders")
    return snap.month_spine(F.min("o_orderdate"), F.max("o_orderdate"), orders)


def _spine_of_shipments(spark, sf_dir):
    return snap.month_spine(
        F.min("l_shipdate"), F.max("l_shipdate"), table(spark, sf_dir, "lineitem")
    )


SHIPPED_SPINE_SQL = """
    select cast(unnest(generate_series((select date_trunc('month', min(l_shipdate)) from lineitem),
        (select max(l_shipdate) from lineitem), interval 1 month)) as date) as m
"""


@query(
    "q_gaps",
    f"""
    select cast(m as varchar) as snapshot_date from ({SHIPPED_SPINE_SQL})
    where m not in (select m from ({ORDER_MONTHS_SQL}))
    """,
)
def gaps(spark, sf_dir):
    """Months with shipments expected that have no orders."""
    return snap.missing_snapshots(_spine_of_shipments(spark, sf_dir), _orders(spark, sf_dir))


@query(
    "q_present",
    f"""
    select cast(m as varchar) as snapshot_date from ({SHIPPED_SPINE_SQL})
    where m in (select m from ({ORDER_MONTHS_SQL}))
    """,
)
def present(spark, sf_dir):
    return snap.present_snapshots(_spine_of_shipments(spark, sf_dir), _orders(spark, sf_dir))


@query(
    "q_months_before",
    f"""
    select cast(r.m as varchar) as snapshot_date, coalesce(n, 0) as rows
    from (select cast(date '2001-09-01' - to_months(cast(i + 2 as integer)) as date) as m
          from range(6) t(i)) r
    left join ({ORDER_MONTHS_SQL}) o on o.m = r.m
    """,
)
def lagged_months(spark, sf_dir):
    """Orders per month, six months that end two months before the run date."""
    months = snap.months_before(spark, "2001-09-01", 6, 2)
    counts = snap.snapshot_counts(_orders(spark, sf_dir))
    return months.join(counts, "snapshot_date", "left").fillna(0, ["rows"])


@query(
    "q_snapshot_range",
    """
    select cast(m as varchar) as snapshot_date, count(*) as rows, sum(amount)::bigint as amount
    from (select cast(date_trunc('month', o_orderdate) as date) as m,
                 cast(floor(o_totalprice) as bigint) as amount from orders)
    where m between date '1996-01-01' and date '1997-06-01' group by 1
    """,
)
def snapshot_range(spark, sf_dir):
    """Written as snapshots and read back for a range of months."""
    path = snap.shared_folder(spark)
    snap.write_snapshots(_orders(spark, sf_dir), path)
    rows = snap.read_snapshots(spark, path, "1996-01-01", "1997-06-01")
    return rows.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")
    )


@query(
    "q_snapshot_counts",
    f"select cast(m as varchar) as snapshot_date, n as rows from ({ORDER_MONTHS_SQL})",
)
def counts(spark, sf_dir):
    """All months written in one job, one of them rewritten, all counted."""
    path = snap.shared_folder(spark)
    orders = _orders(spark, sf_dir)
    snap.write_snapshots(orders, path)
    snap.write_snapshots(snap.at_snapshot(orders, "1998-03-01"), path)
    return snap.snapshot_counts(snap.read_snapshots(spark, path))


@query(
    "q_csv_round_trip",
    """
    select o_custkey, count(*) as rows, sum(cast(floor(o_totalprice) as bigint))::bigint as amount
    from orders group by 1
    """,
)
def csv_round_trip(spark, sf_dir):
    """Snapshots written and read as CSV with a given schema."""
    path = snap.shared_folder(spark)
    orders = _orders(spark, sf_dir)
    snap.write_snapshots(orders, path, format="csv")
    back = snap.read_csv(spark, path, orders.schema)
    return back.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")
    )


@query(
    "q_at_snapshot",
    """
    select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) as amount, '1998-03-01' as snapshot_date
    from orders where date_trunc('month', o_orderdate) = date '1998-03-01'
    """,
)
def one_snapshot(spark, sf_dir):
    return snap.at_snapshot(_orders(spark, sf_dir), "1998-03-01")


@query(
    "q_latest_snapshot",
    """
    select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) as amount,
           cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as snapshot_date
    from orders where date_trunc('month', o_orderdate) = (select max(date_trunc('month', o_orderdate)) from orders)
    """,
)
def newest_snapshot(spark, sf_dir):
    return snap.latest_snapshot(_orders(spark, sf_dir))


@query(
    "q_union_snapshots",
    """
    select cast(m as varchar) as snapshot_date, count(*) as rows, count(amount) as orders, count(line) as lines
    from (select date_trunc('month', o_orderdate)::date as m, o_totalprice as amount, null as line from orders
          union all select date_trunc('month', l_shipdate)::date, null, l_linenumber from lineitem)
    group by 1
    """,
)
def union(spark, sf_dir):
    """Two tables with different columns as one, sorted by month."""
    lines = table(spark, sf_dir, "lineitem").select(
        snap.first_of_month("l_shipdate").alias("snapshot_date"), "l_linenumber"
    )
    both = snap.union_snapshots(_orders(spark, sf_dir).select("snapshot_date", "amount"), lines)
    return both.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count("amount").alias("orders"),
        F.count("l_linenumber").alias("lines"),
    ).orderBy("snapshot_date")


@query(
    "q_columns",
    """
    select o_orderkey, o_custkey as customer, o_totalprice, 'v1' as model_version, '2001-12-01' as prediction_date
    from orders
    """,
)
def projected(spark, sf_dir):
    """Ids and features picked, dropped, renamed, stamped."""
    orders = derive(spark, sf_dir, "orders")
    features = columns.feature_columns(orders, ["o_orderkey", "o_custkey"])
    picked = columns.select_columns(orders, ["o_orderkey", "o_custkey", "o_orderstatus", *features])
    renamed = columns.rename_columns(
        columns.drop_columns(picked, ["o_orderstatus", "absent"]), {"o_custkey": "customer"}
    )
    return columns.stamp(
        renamed, model_version="v1", prediction_date=F.lit("2001-12-01").cast("date")
    )
