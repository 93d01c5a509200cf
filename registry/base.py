"""Registration and the inputs that queries and SQL share.

The library works on monthly loan and customer snapshots. The test tables are sales tables, so
the inputs below derive such snapshots from them, by SQL that both engines read in the same way:
a customer's orders of a month stand for the customer's financial and attribute rows, shipped
lines for clicks and for loan installments. Values are spoilt in the ways that cleaning repairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapmart.session import tune
from snapmart.sources.snapshots import release_shuffles, shared_folder, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ["customer", "orders", "lineitem", "part", "nation", "events", "documents", "embeddings",
          "labels"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: portable(function(tune(spark), sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portable(df: DataFrame) -> DataFrame:
    """Dates, booleans and lists as text, which every engine returns in the same form."""
    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType, T.BooleanType)):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(c, ";").alias(field.name)
        return c

    return df.select(*[plain(f) for f in df.schema.fields])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Aggregates of doubles depend on the order of summation in their last digits."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def saved(df):
    """Write a table to the shared folder and read it back, as the monthly job does."""
    path = shared_folder(df.sparkSession)
    write_table(df, path)
    release_shuffles(df.sparkSession)
    return df.sparkSession.read.parquet(path)


# ---- inputs that both engines derive with the same SQL ---------------------------------------

INPUTS = {
    "customer_months": """
        select o_custkey as cust, cast(date_trunc('month', o_orderdate) as date) as snapshot_date,
               min(o_orderkey) as k, count(*) as n,
               sum(cast(floor(o_totalprice) as bigint)) as spent
        from {orders} group by 1, 2""",
    "raw_attributes": """
        select concat('CUS_', cast(m.cust as string)) as Customer_ID,
               concat('  ', c.c_name, case when k % 5 = 0 then ' 2nd!' else '' end, ' ') as Name,
               case when k % 11 = 0 then concat(cast(18 + k % 60 as string), '_')
                    when k % 13 = 0 then concat('-', cast(18 + k % 60 as string))
                    when k % 17 = 0 then '8698'
                    when k % 19 = 0 then ''
                    when k % 23 = 0 then null
                    else cast(18 + m.cust % 60 as string) end as Age,
               case when k % 29 = 0 then null
                    when k % 3 = 0 then concat('1 ', cast(m.cust as string), ' 7')
                    else concat('2', cast(k as string), ' 8') end as SSN,
               case when k % 7 = 0 then '_______' else c.c_mktsegment end as Occupation,
               m.snapshot_date as snapshot_date
        from {customer_months} m join {customer} c on c.c_custkey = m.cust""",
    "raw_financials": """
        select concat('CUS_', cast(cust as string)) as Customer_ID,
               concat(cast(20000 + (k * 37) % 150000 as string), '.5',
                      case when k % 9 = 0 then '_' else '' end) as Annual_Income,
               case when k % 12 = 0 then null when k % 15 = 0 then '0'
                    else concat(cast(1000 + (k * 13) % 12000 as string), '.5') end
                    as Monthly_Inhand_Salary,
               cast(k % 14 - 1 as string) as Num_Bank_Accounts,
               cast(k % 13 as string) as Num_Credit_Card,
               cast(k % 20 as string) as Interest_Rate,
               case when k % 10 = 0 then '-100'
                    else concat(cast(n + k % 5 as string), case when k % 4 = 0 then '_' else '' end)
                    end as Num_of_Loan,
               case k % 6 when 0 then null
                    when 1 then 'Boat Loan, Garden Loan, and Piano Loan'
                    when 2 then 'Not Specified'
                    when 3 then 'Kiln Loan, Not Specified'
                    when 4 then 'Brand New Loan,, and Garden Loan'
                    else 'Tent Loan, Kiln Loan' end as Type_of_Loan,
               cast(k % 40 - 5 as string) as Delay_from_due_date,
               concat(cast(k % 35 - 2 as string), case when k % 8 = 0 then '_' else '' end)
                    as Num_of_Delayed_Payment,
               case when k % 10 = 3 then '_' else concat(cast(k % 30 - 6 as string), '.25') end
                    as Changed_Credit_Limit,
               cast(k % 22 as string) as Num_Credit_Inquiries,
               case k % 4 when 0 then '_' when 1 then 'Good' when 2 then 'Standard' else 'Bad' end
                    as Credit_Mix,
               concat('_', cast(spent % 9000 as string), '.75_') as Outstanding_Debt,
               concat(cast(20 + k % 40 as string), '.125') as Credit_Utilization_Ratio,
               case k % 5 when 0 then null
                    when 1 then concat(cast(k % 30 as string), ' Years and ',
                                       cast(k % 12 as string), ' Months')
                    when 2 then '1 Year' when 3 then 'NA'
                    else concat(cast(k % 12 as string), ' Months') end as Credit_History_Age,
               case k % 4 when 0 then 'Yes' when 1 then 'No' when 2 then 'NM' else null end
                    as Payment_of_Min_Amount,
               concat(cast(k % 300 as string), '.75') as Total_EMI_per_month,
               case when k % 6 = 0 then '__10000__' else concat(cast(k % 900 as string), '.5') end
                    as Amount_invested_monthly,
               case k % 6 when 0 then '!@9#%8' when 1 then null when 2 then 'Low_spent'
                    when 3 then 'Low_spent_Small_value_payments'
                    when 4 then 'High_spent_Large_value_payments'
                    else 'High_spent_Medium_value_payments' end as Payment_Behaviour,
               concat(cast(k % 700 as string), '.25_') as Monthly_Balance,
               snapshot_date
        from {customer_months}""",
    "click_months": """
        select o_custkey as cust, cast(date_trunc('month', l_shipdate) as date) as snapshot_date,
               cast(sum(l_quantity) as bigint) as q, sum(l_partkey) as p
        from {lineitem} join {orders} on o_orderkey = l_orderkey group by 1, 2""",
    "raw_clickstream": "select "
    + ", ".join(
        f"concat(cast((q * {i} + p) % {50 + i} as string), '{'.0' if i % 2 else ''}') as fe_{i}"
        for i in range(1, 21)
    )
    + ", concat('CUS_', cast(cust as string)) as Customer_ID, snapshot_date from {click_months}",
    "raw_loan_book": """
        select concat('L', cast(l_orderkey as string), '_', cast(l_partkey as string), '_',
                      cast(l_suppkey as string)) as loan_id,
               concat('CUS_', cast(o_custkey as string)) as Customer_ID,
               cast(o_orderdate as date) as loan_start_date,
               10 as tenure, l_linenumber as installment_num,
               l_extendedprice as loan_amt,
               case when l_partkey % 50 = 0 then 0e0 else l_quantity * 10e0 end as due_amt,
               l_quantity * 5e0 as paid_amt,
               case when l_partkey % 37 = 0 then null
                    when l_returnflag = 'R' then l_quantity * 32e0 * (l_suppkey % 3)
                    else 0e0 end as overdue_amt,
               l_extendedprice * 0.5e0 as balance,
               cast(date_trunc('month', l_shipdate) as date) as snapshot_date
        from {lineitem} join {orders} on o_orderkey = l_orderkey""",
    "scored": """
        select concat('L', cast(l_orderkey as string), '_', cast(l_linenumber as string), '_',
                      cast(l_suppkey as string)) as loan_id,
               concat('CUS_', cast(l_partkey as string)) as Customer_ID,
               cast(date_trunc('month', l_shipdate) as date) as snapshot_date,
               case when l_returnflag = 'R' then 1 else 0 end as label,
               l_extendedprice / 105000e0 as probability,
               case when l_extendedprice > 52500e0 then 1 else 0 end as prediction
        from {lineitem}""",
    "shipped": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_discount + 0e0 as l_discount, l_tax + 0e0 as l_tax,
               l_extendedprice * extract(month from l_shipdate) as seasonal_price,
               l_quantity + extract(month from l_shipdate) as seasonal_quantity,
               case when l_returnflag = 'R' then 1 else 0 end as label,
               cast(date_trunc('month', l_shipdate) as date) as snapshot_date
        from {lineitem}""",
}


def _named_in(sql: str) -> list[str]:
    return [n for n in [*TABLES, *INPUTS] if "{" + n + "}" in sql]


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or an input derived from the test tables."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = INPUTS[name]
    return spark.sql(sql, **{n: derive(spark, sf_dir, n) for n in _named_in(sql)})


def with_inputs(ctes: dict[str, str], final: str) -> str:
    """``final`` after the common table expressions that it and they need, inputs included."""
    parts: dict[str, str] = {}

    def add(name: str, sql: str) -> None:
        for other in _named_in(sql):
            if other in INPUTS and other not in parts:
                add(other, INPUTS[other])
        parts[name] = sql.format(**{n: n for n in _named_in(sql)})

    for name, sql in ctes.items():
        add(name, sql)
    add("final", final)
    last = parts.pop("final")
    if not parts:
        return last
    return "with " + ",\n".join(f"{n} as materialized ({s})" for n, s in parts.items()) + "\n" + last
