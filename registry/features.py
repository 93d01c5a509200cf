"""Imputation, encoding, scaling, list columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import derive, query, rounded, saved, table, with_inputs
from snapmart.functions import text
from snapmart.operators import features as feat
from snapmart.operators.columns import zero_fill


@query(
    "q_impute",
    """
    select p_partkey, case when p_size > 40 then cast(trunc(
               (select avg(p_size) from part where not (p_size > 40))) as integer) else p_size end as p_size,
           cast(case when p_retailprice > 1000 then trunc(
               (select avg(p_retailprice) from part where not (p_retailprice > 1000)))
               else trunc(p_retailprice) end as integer) as p_retailprice
    from part
    """,
)
def impute(spark, sf_dir):
    """Implausible sizes and prices replaced by the mean of the plausible ones."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice",
        (F.col("p_size") > 40).alias("size_typo"),
        (F.col("p_retailprice") > 1000).alias("price_typo"),
    )
    flags = {"p_size": "size_typo", "p_retailprice": "price_typo"}
    return feat.impute(parts, feat.fit_means(parts, flags), flags).drop(*flags.values())


@query(
    "q_encode",
    """
    with counts as (
        select 'type' as kind, p_type as v, count(*) as n from part group by 2
        union all select 'brand', p_brand, count(*) from part group by 2
        union all select 'name', p_name, count(*) from part group by 2),
    indexed as (
        select kind, v, cast(row_number() over (partition by kind order by n desc, v) - 1 as double) as i
        from counts)
    select p_partkey, t.i as type_index, b.i as brand_index, n.i as name_index
    from part
    join indexed t on t.kind = 'type' and t.v = p_type
    join indexed b on b.kind = 'brand' and b.v = p_brand
    join indexed n on n.kind = 'name' and n.v = p_name
    """,
)
def encode(spark, sf_dir):
    """Three text columns indexed by frequency."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    columns = {"p_type": "type_index", "p_brand": "brand_index", "p_name": "name_index"}
    indexes = saved(feat.fit_indexes(parts, list(columns)))
    return feat.encode(parts, indexes, columns).drop(*columns)


@query(
    "q_encode_keep",
    with_inputs(
        {
            "mix": """
                select Customer_ID, snapshot_date,
                       case when Credit_Mix = '_' then null else Credit_Mix end as mix
                from {raw_financials}""",
            "indexed": """
                select mix, cast(row_number() over (order by count(*) desc, mix) - 1 as double) as i
                from mix where mix is not null group by mix""",
        },
        """
        select m.Customer_ID, cast(m.snapshot_date as varchar) as snapshot_date, m.mix,
               coalesce(i.i, (select count(*) from indexed)) as mix_index
        from mix m left join indexed i on i.mix = m.mix
        """,
    ),
)
def encode_keep(spark, sf_dir):
    """NULL gets the index after the last."""
    rows = derive(spark, sf_dir, "raw_financials").select(
        "Customer_ID", "snapshot_date",
        text.null_if(F.col("Credit_Mix"), text.EMPTY_SENTINEL).alias("mix"),
    )
    return feat.encode(rows, saved(feat.fit_indexes(rows, ["mix"])), {"mix": "mix_index"})


@query(
    "q_encode_many",
    """
    with counts as (select c_name, count(*) as n from customer group by 1)
    select c_name as value, cast(row_number() over (order by n desc, c_name) - 1 as double) as index
    from counts
    """,
)
def encode_many(spark, sf_dir):
    """Indexes of a column with as many values as rows."""
    return feat.fit_indexes(table(spark, sf_dir, "customer"), ["c_name"]).select("value", "index")


@query(
    "q_scale",
    """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round((l_quantity - (select avg(l_quantity) from lineitem))
                 / (select stddev_pop(l_quantity) from lineitem), 6) as l_quantity,
           round((l_extendedprice - (select avg(l_extendedprice) from lineitem))
                 / (select stddev_pop(l_extendedprice) from lineitem), 6) as l_extendedprice,
           round((l_discount - (select avg(l_discount) from lineitem))
                 / (select stddev_pop(l_discount) from lineitem), 6) as l_discount,
           0.0::double as constant
    from lineitem
    """,
)
def scale(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "constant"]
    lines = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(3.0))
    scaled = feat.scale(lines, feat.fit_scaler(lines, names), names)
    return rounded(
        scaled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *names), *names[:3]
    )


@query(
    "q_multihot",
    """
    select c_nationkey, n.n_name as nation_name,
           max(case when c_mktsegment = 'AUTOMOBILE' then 1 else 0 end) as AUTOMOBILE,
           max(case when c_mktsegment = 'BUILDING' then 1 else 0 end) as BUILDING,
           max(case when c_mktsegment = 'FURNITURE' then 1 else 0 end) as FURNITURE,
           max(case when c_mktsegment = 'HOUSEHOLD' then 1 else 0 end) as HOUSEHOLD,
           max(case when c_mktsegment = 'MACHINERY' then 1 else 0 end) as MACHINERY
    from customer join nation n on n.n_nationkey = c_nationkey group by 1, 2
    """,
)
def multihot(spark, sf_dir):
    """Market segments found per nation, joined to the nations."""
    customers = table(spark, sf_dir, "customer")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    found = feat.pivot_flags(customers, ["c_nationkey"], "c_mktsegment", segments)
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation_name")
    )
    joined = nations.join(found, "c_nationkey", "left").filter(F.col(segments[0]).isNotNull())
    return zero_fill(joined, segments)


LOAN_ITEMS = """
    select Customer_ID, snapshot_date,
           list_filter(list_transform(string_split(
               replace(coalesce(Type_of_Loan, 'not specified'), 'and ', ''), ','),
               lambda x: lower(trim(x))), lambda x: x <> '') as items
    from {raw_financials}
"""
# cleaning drops "and " inside words too, so "Brand New Loan" is found as "brnew loan"
LOAN_TYPES = ["boat loan", "brnew loan", "garden loan", "kiln loan", "piano loan", "tent loan"]


@query(
    "q_multihot_loans",
    with_inputs(
        {
            "items": LOAN_ITEMS,
            "per_customer": "select Customer_ID, "
            + ", ".join(
                f"max(case when list_contains(items, '{t}') then 1 else 0 end) as \"{t}\""
                for t in LOAN_TYPES
            )
            + " from items group by 1",
        },
        "select i.Customer_ID, cast(i.snapshot_date as varchar) as snapshot_date, "
        + ", ".join(f'p."{t}"' for t in LOAN_TYPES)
        + " from items i join per_customer p on p.Customer_ID = i.Customer_ID",
    ),
)
def multihot_loans(spark, sf_dir):
    """One column per loan type that the customer ever had."""
    rows = _loan_lists(spark, sf_dir)
    return feat.multi_hot(rows, "loans", LOAN_TYPES, ["Customer_ID"]).drop("loans")


def _loan_lists(spark, sf_dir):
    flat = text.without_conjunction(text.default_text(F.col("Type_of_Loan")))
    return derive(spark, sf_dir, "raw_financials").select(
        "Customer_ID", "snapshot_date", text.item_list(flat).alias("loans")
    )


@query(
    "q_explode_loans",
    with_inputs(
        {"items": LOAN_ITEMS},
        """
        select Customer_ID, cast(snapshot_date as varchar) as snapshot_date, loan
        from (select Customer_ID, snapshot_date, unnest(case when len(items) > 1
                then list_filter(items, lambda x: x <> 'not specified') else items end) as loan
              from items)
        """,
    ),
)
def explode_loans(spark, sf_dir):
    return feat.explode_list(_loan_lists(spark, sf_dir), "loans", "loan").drop("loans")


@query(
    "q_list_values",
    with_inputs(
        {"items": LOAN_ITEMS},
        "select distinct unnest(items) as loan from items",
    ),
)
def loan_values(spark, sf_dir):
    """The loan types that occur, found from the data and used as columns."""
    rows = _loan_lists(spark, sf_dir)
    values = feat.list_values(rows, "loans")
    hot = feat.multi_hot(rows, "loans", values)
    totals = hot.agg(*[F.max(v).alias(v) for v in values])
    return totals.unpivot([], values, "loan", "found").filter(F.col("found") == 1).select("loan")
