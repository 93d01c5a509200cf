"""As-of and point-in-time joins, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import derive, query, saved, table, with_inputs
from snapmart.operators.delinquency import delinquency, label_at
from snapmart.operators.temporal import (
    Dated,
    bucketed_before,
    label_join,
    latest_before,
    latest_of_each,
    latest_per_group,
    point_in_time,
)


@query(
    "q_asof_latest",
    """
    select p.user_id, p.event_id as purchase_id, cast(p.ts as varchar) as purchase_ts,
           p.value as purchase_value, v.event_id as view_id, cast(v.ts as varchar) as view_ts,
           v.value as view_value
    from (select * from events where event_type = 'purchase') p
    asof join (select * from events where event_type = 'view') v
      on p.user_id = v.user_id and p.ts >= v.ts
    """,
)
def asof_latest(spark, sf_dir):
    """Each purchase with the user's newest view at or before it."""
    events = table(spark, sf_dir, "events")

    def of(kind, prefix):
        return events.filter(F.col("event_type") == kind).select(
            "user_id",
            F.col("event_id").alias(f"{prefix}_id"),
            F.col("ts").alias(f"{prefix}_ts"),
            F.col("value").alias(f"{prefix}_value"),
        )

    return latest_before(
        of("purchase", "purchase"), of("view", "view"), ["user_id"], "purchase_ts", "view_ts",
        tie=["view_id"],
    )


@query(
    "q_asof_unmatched",
    with_inputs(
        {"clicks": "select * from {click_months}", "spend": "select * from {customer_months}"},
        """
        select c.cust, cast(c.snapshot_date as varchar) as click_date, c.q,
               cast(s.snapshot_date as varchar) as spend_date, s.spent
        from clicks c asof left join spend s
          on c.cust = s.cust and c.snapshot_date >= s.snapshot_date
        """,
    ),
)
def asof_unmatched(spark, sf_dir):
    """Each customer month of shipments with the newest earlier month of orders, if there is one.

    The join reads both sides several times, so they are derived once and saved.
    """
    clicks = saved(derive(spark, sf_dir, "click_months").select(
        "cust", F.col("snapshot_date").alias("click_date"), "q"
    ))
    spend = saved(derive(spark, sf_dir, "customer_months").select(
        "cust", F.col("snapshot_date").alias("spend_date"), "spent"
    ))
    return latest_before(clicks, spend, ["cust"], "click_date", "spend_date", how="left")


@query(
    "q_point_in_time",
    with_inputs(
        {},
        """
        select a.cust, cast(a.snapshot_date as varchar) as snapshot_date,
               cast(b.snapshot_date as varchar) as earlier_date, b.spent as earlier_spent
        from {customer_months} a join {customer_months} b
          on a.cust = b.cust and b.snapshot_date <= a.snapshot_date
        """,
    ),
)
def point_in_time_months(spark, sf_dir):
    """Each customer month with all months of the customer up to it.

    Orders are merged to one row per customer and month first, so a customer with very many orders
    still yields at most half the square of the number of months.
    """
    months = derive(spark, sf_dir, "customer_months")
    earlier = months.select(
        "cust", F.col("snapshot_date").alias("earlier_date"), F.col("spent").alias("earlier_spent")
    )
    return point_in_time(
        months.select("cust", "snapshot_date"), earlier, ["cust"], "snapshot_date", "earlier_date"
    )


@query(
    "q_label_join",
    with_inputs(
        {
            "labelled": """
                select loan_id, Customer_ID, snapshot_date, loan_start_date,
                       coalesce(try_cast(ceil(overdue_amt / nullif(due_amt, 0)) as integer), 0) as missed,
                       overdue_amt
                from {raw_loan_book} where installment_num = 6
            """
        },
        """
        select l.loan_id, l.Customer_ID, cast(l.snapshot_date as varchar) as snapshot_date,
               cast(case when overdue_amt > 0 and missed > 0 and date_diff('day',
                      cast(l.snapshot_date - to_months(missed) as date), l.snapshot_date) >= 30
                    then 1 else 0 end as integer) as label,
               cast(cast(o.o_orderdate as date) as varchar) as order_date, o.o_totalprice
        from labelled l
        join orders o on split_part(substr(l.loan_id, 2), '_', 1) = cast(o.o_orderkey as varchar)
                     and cast(o.o_orderdate as date) <= l.snapshot_date
        """,
    ),
)
def label_to_order(spark, sf_dir):
    """Default label of each loan at month six, with its order if that is not newer."""
    loans = label_at(delinquency(derive(spark, sf_dir, "raw_loan_book"))).select(
        "loan_id", "Customer_ID", "snapshot_date", "label",
        F.expr("split_part(substr(loan_id, 2), '_', 1)").alias("order_key"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        "o_totalprice",
    )
    return label_join(loans, orders, ["order_key"], "snapshot_date", "order_date").drop("order_key")


@query(
    "q_latest_per_group",
    """
    select o_custkey, o_orderkey, o_totalprice, cast(cast(o_orderdate as date) as varchar) as order_date
    from orders qualify row_number() over (
        partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1
    """,
)
def newest_order(spark, sf_dir):
    """The newest order of each customer."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").alias("order_date")
    )
    newest = latest_per_group(
        orders, ["o_custkey"], [F.col("order_date").desc(), F.col("o_orderkey").desc()]
    )
    return newest.withColumn("order_date", F.col("order_date").cast("date"))


@query(
    "q_asof_many",
    """
    with days as (
        select user_id, event_type, cast(ts as date) as day, max(event_id) as event_id, count(*) as n
        from events group by all),
    views as (
        select v.*, c.day as click_day, c.event_id as click_id
        from (select * from days where event_type = 'view') v
        asof join (select * from days where event_type = 'click') c on v.user_id = c.user_id and v.day >= c.day)
    select p.user_id, cast(p.day as varchar) as day, p.event_id as purchase_id,
           cast(v.day as varchar) as view_day, v.event_id as view_id, v.n as views,
           cast(v.click_day as varchar) as click_day, v.click_id,
           cast(s.day as varchar) as signup_day, s.event_id as signup_id
    from (select * from days where event_type = 'purchase') p
    asof join views v on p.user_id = v.user_id and p.day >= v.day
    asof join (select * from days where event_type = 'signup') s on p.user_id = s.user_id and p.day >= s.day
    """,
)
def asof_many(spark, sf_dir):
    """Days with purchases, the newest day with views that follow a click, the newest signup."""
    days = table(spark, sf_dir, "events").groupBy(
        "user_id", "event_type", F.col("ts").cast("date").alias("day")
    ).agg(F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))

    def of(kind, *more):
        return days.filter(F.col("event_type") == kind).select(
            "user_id", F.col("day").alias(f"{kind}_day"), F.col("event_id").alias(f"{kind}_id"), *more)

    return latest_of_each(
        of("purchase"), "purchase_day",
        {
            "view": Dated(of("view", F.col("n").alias("views")), "view_day", unique=True),
            "click": Dated(of("click"), "click_day", of="view", unique=True),
            "signup": Dated(of("signup"), "signup_day", unique=True),
        },
        ["user_id"],
    ).withColumnRenamed("purchase_day", "day")


@query(
    "q_range_join",
    """
    select o.o_custkey as cust, o.o_orderkey, count(*) as earlier, sum(e.o_orderkey)::bigint as key_sum,
           cast(max(cast(e.o_orderdate as date)) as varchar) as newest
    from orders o join orders e
      on o.o_custkey % 5 = e.o_custkey % 5 and o.o_orderpriority = '1-URGENT' and o.o_orderkey % 40 = 1
     and e.o_orderstatus = 'P' and cast(e.o_orderdate as date) <= cast(o.o_orderdate as date)
    group by 1, 2
    """,
)
def range_join(spark, sf_dir):
    """Urgent orders with all earlier pending ones of their fifth of the customers: hot keys."""
    orders = table(spark, sf_dir, "orders").withColumn("fifth", F.col("o_custkey") % 5)
    urgent = orders.filter("o_orderpriority = '1-URGENT' and o_orderkey % 40 = 1").select(
        "fifth", F.col("o_custkey").alias("cust"), "o_orderkey", F.col("o_orderdate").cast("date").alias("at"))
    pending = orders.filter("o_orderstatus = 'P'").select(
        "fifth", F.col("o_orderkey").alias("earlier_key"), F.col("o_orderdate").cast("date").alias("earlier"))
    met = bucketed_before(urgent, pending, ["fifth"], "at", "earlier", days=92, most=100, totals={
        "n": ("count", "earlier"), "key_sum": ("sum", "earlier_key"), "newest": ("max", "earlier")})
    return met.groupBy("cust", "o_orderkey").agg(
        F.sum("n").alias("earlier"), F.sum("key_sum").alias("key_sum"), F.max("newest").alias("newest"))
