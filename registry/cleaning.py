"""Text and number cleaning, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import derive, query, table, with_inputs
from snapmart.functions import numbers, text
from snapmart.operators.columns import apply_schema, drop_columns, not_flagged, zero_fill
from snapmart.operators.quality import duplicate_flag, range_flags


@query(
    "q_clean_text",
    """
    select doc_id,
           md5(regexp_replace(trim(text), '[^A-Za-z ]', '', 'g')) as letters_md5,
           length(regexp_replace(text, '[^0-9]', '', 'g')) as digit_count,
           regexp_replace(source || ' ' || lang, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') as packed
    from documents
    """,
)
def clean_text(spark, sf_dir):
    """Whole document texts reduced to letters and to digits; whitespace removed."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        F.md5(text.letters_and_spaces(F.col("text"))).alias("letters_md5"),
        F.length(text.digits(F.col("text"))).cast("long").alias("digit_count"),
        text.without_whitespace(F.concat_ws(" ", "source", "lang")).alias("packed"),
    )


@query(
    "q_clean_names",
    with_inputs(
        {},
        """
        select Customer_ID, cast(snapshot_date as varchar) as snapshot_date,
               regexp_replace(trim(Name), '[^A-Za-z ]', '', 'g') as name_clean,
               regexp_replace(SSN, '\\s+', '', 'g') as ssn_clean,
               try_cast(regexp_replace(Age, '[^0-9]', '', 'g') as integer) as age_clean
        from {raw_attributes}
        """,
    ),
)
def clean_names(spark, sf_dir):
    raw = derive(spark, sf_dir, "raw_attributes")
    return raw.select(
        "Customer_ID",
        "snapshot_date",
        text.letters_and_spaces(F.col("Name")).alias("name_clean"),
        text.without_whitespace(F.col("SSN")).alias("ssn_clean"),
        text.to_int(text.digits(F.col("Age"))).alias("age_clean"),
    )


DIRTY_SIZE = """
    select p_partkey, p_retailprice,
           case p_partkey % 6 when 0 then concat(cast(p_size as string), '_')
                when 1 then concat('-', cast(p_size as string), '.5')
                when 2 then '' when 3 then null when 4 then '__10000__'
                else concat('1.2.', cast(p_size as string)) end as dirty
    from {part}
"""


@query(
    "q_clean_numeric",
    with_inputs(
        {"dirty": DIRTY_SIZE},
        """
        select p_partkey, try_cast(regexp_replace(dirty, '[^0-9.]', '', 'g') as double) as unsigned_value,
               try_cast(regexp_replace(dirty, '[^0-9.\\-]', '', 'g') as double) as signed_value,
               cast(trunc(try_cast(regexp_replace(dirty, '[^0-9.\\-]', '', 'g') as double)) as integer)
                   as int_value
        from dirty
        """,
    ),
)
def clean_numeric(spark, sf_dir):
    dirty = spark.sql(DIRTY_SIZE, part=table(spark, sf_dir, "part"))
    cleaned = dirty.select(
        "p_partkey",
        text.clean_number(F.col("dirty")).alias("unsigned_value"),
        text.clean_number(F.col("dirty"), signed=True).alias("signed_value"),
        F.regexp_replace("dirty", text.NOT_SIGNED_NUMBER, "").alias("int_value"),
    )
    return apply_schema(cleaned, {"int_value": "int"})


@query(
    "q_schema",
    with_inputs(
        {},
        "select Customer_ID, cast(snapshot_date as varchar) as snapshot_date, "
        + ", ".join(
            f"cast(trunc(try_cast(fe_{i} as double)) as integer) as fe_{i}" for i in range(1, 21)
        )
        + " from {raw_clickstream}",
    ),
)
def schema(spark, sf_dir):
    """Type enforcement; numbers that arrive as '12.0' still become ints."""
    from snapmart.sources.schemas import CLICKSTREAM_TYPES

    return apply_schema(derive(spark, sf_dir, "raw_clickstream"), CLICKSTREAM_TYPES)


DIRTY_SEGMENT = """
    select c_custkey,
           case c_custkey % 7 when 0 then '_______' when 1 then '_' when 2 then null
                when 3 then '!@9#%8' else c_mktsegment end as segment
    from {customer}
"""


@query(
    "q_sentinels",
    with_inputs(
        {"dirty": DIRTY_SEGMENT},
        """
        select c_custkey, case when segment = '_______' then 'Unknown' else segment end as labelled,
               case when segment = '_' then '0' else segment end as zeroed,
               case when segment = '!@9#%8' then null else segment end as emptied,
               case when segment is null then 'not specified' else segment end as filled
        from dirty
        """,
    ),
)
def sentinels(spark, sf_dir):
    c = F.col("segment")
    return spark.sql(DIRTY_SEGMENT, customer=table(spark, sf_dir, "customer")).select(
        "c_custkey",
        text.replace_value(c, text.OCCUPATION_SENTINEL, text.UNKNOWN).alias("labelled"),
        text.replace_value(c, text.EMPTY_SENTINEL, "0").alias("zeroed"),
        text.null_if(c, text.BEHAVIOUR_SENTINEL).alias("emptied"),
        text.default_text(c).alias("filled"),
    )


LIST_TEXT = """
    select p_partkey,
           case p_partkey % 7 when 0 then null when 1 then '' when 2 then 'Not Specified'
                when 3 then concat(p_name, ', Not Specified,', p_type)
                when 4 then concat(' , and ', p_brand, ',,brand new ', p_name)
                when 5 then 'not specified, Not Specified'
                else concat(p_name, ', ', p_type, ', and ', p_brand) end as listed
    from {part}
"""


@query(
    "q_list_text",
    with_inputs(
        {
            "lists": LIST_TEXT,
            "flat": """
                select p_partkey, lower(trim(replace(coalesce(listed, 'not specified'), 'and ', ''))) as flat
                from lists""",
            "items": """
                select *, list_filter(list_transform(string_split(flat, ','), lambda x: lower(trim(x))),
                                      lambda x: x is not null and x <> '') as items from flat""",
            "kept": """
                select *, case when len(items) > 1
                               then list_filter(items, lambda x: x <> 'not specified')
                               else items end as kept from items""",
        },
        """
        select p_partkey, flat, array_to_string(items, ';') as items,
               case when len(kept) = 0 then 'not specified' else array_to_string(kept, ';') end as kept,
               cast(case when len(kept) = 0 then 1 else len(kept) end as integer) as kept_count
        from kept
        """,
    ),
)
def list_text(spark, sf_dir):
    flat = text.without_conjunction(text.default_text(F.col("listed")))
    return (
        spark.sql(LIST_TEXT, part=table(spark, sf_dir, "part"))
        .select("p_partkey", flat.alias("flat"))
        .withColumns(
            {
                "items": text.normalized_items(text.split_list(F.col("flat"))),
                "kept": text.item_list(F.col("flat")),
                "kept_count": F.size(text.item_list(F.col("flat"))),
            }
        )
    )


DURATIONS = """
    select p_partkey,
           case p_partkey % 6 when 0 then concat(cast(p_size as string), ' Years and ',
                                                 cast(p_partkey % 12 as string), ' Months')
                when 1 then '1 Year' when 2 then concat(cast(p_size as string), ' Months')
                when 3 then null when 4 then 'NA'
                else concat(cast(p_size as string), '  Years and 1 Month') end as age
    from {part}
"""


@query(
    "q_duration",
    with_inputs(
        {"durations": DURATIONS},
        """
        select p_partkey,
               coalesce(try_cast(regexp_extract(age, '(\\d+)\\s+Years?', 1) as double), 0) as years,
               coalesce(try_cast(regexp_extract(age, '(\\d+)\\s+Months?', 1) as double), 0) as months,
               coalesce(try_cast(regexp_extract(age, '(\\d+)\\s+Years?', 1) as double), 0) * 12
               + coalesce(try_cast(regexp_extract(age, '(\\d+)\\s+Months?', 1) as double), 0) as total_months
        from durations
        """,
    ),
)
def duration(spark, sf_dir):
    c = F.col("age")
    return spark.sql(DURATIONS, part=table(spark, sf_dir, "part")).select(
        "p_partkey",
        text.duration_part(c, text.YEARS).alias("years"),
        text.duration_part(c, text.MONTHS).alias("months"),
        text.duration_months(c).alias("total_months"),
    )


@query(
    "q_code_split",
    with_inputs(
        {},
        """
        select Customer_ID, cast(snapshot_date as varchar) as snapshot_date,
               case when b = 'Unknown' then 'Unknown' else split_part(b, '_', 1) end as spend_level,
               case when b = 'Unknown' then 'Unknown' else nullif(split_part(b, '_', 3), '') end
                   as payment_value,
               cast(coalesce(lower(Payment_of_Min_Amount) = 'yes', false) as varchar) as pays_minimum
        from (select *, case when Payment_Behaviour = '!@9#%8' then 'Unknown'
                             else Payment_Behaviour end as b from {raw_financials})
        """,
    ),
)
def code_split(spark, sf_dir):
    code = text.replace_value(F.col("Payment_Behaviour"), text.BEHAVIOUR_SENTINEL, text.UNKNOWN)
    return derive(spark, sf_dir, "raw_financials").select(
        "Customer_ID",
        "snapshot_date",
        text.code_part(code, 0).alias("spend_level"),
        text.code_part(code, 2).alias("payment_value"),
        text.yes_no(F.col("Payment_of_Min_Amount")).alias("pays_minimum"),
    )


@query(
    "q_priority_code",
    """
    select o_orderkey, split_part(o_orderpriority, '-', 1) as level,
           nullif(split_part(o_orderpriority, '-', 2), '') as word
    from orders
    """,
)
def priority_code(spark, sf_dir):
    c = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.code_part(c, 0, "-").alias("level"),
        text.code_part(c, 1, "-").alias("word"),
    )


@query(
    "q_flags",
    """
    select c_custkey,
           cast(c_acctbal < 0 as varchar) as is_negative,
           cast(c_nationkey = 0 as varchar) as is_zero,
           cast(c_acctbal < 0 or c_acctbal > 9000 as varchar) as balance_typo,
           cast(c_acctbal > 5000 as varchar) as is_high,
           case when c_acctbal <= 2500 then 'Low' when c_acctbal > 10000 then 'High'
                else 'Medium' end as band,
           c_acctbal / nullif(c_nationkey, 0) as per_nation,
           cast(c_acctbal / nullif(c_nationkey, 0) > 4 as varchar) as high_ratio
    from customer
    """,
)
def flags(spark, sf_dir):
    balance, nation = F.col("c_acctbal"), F.col("c_nationkey")
    flagged = range_flags(table(spark, sf_dir, "customer"), {"c_acctbal": (0, 9000)})
    return flagged.select(
        "c_custkey",
        numbers.negative(balance).alias("is_negative"),
        numbers.zero(nation).alias("is_zero"),
        F.col("c_acctbal_typo").alias("balance_typo"),
        numbers.above(balance, 5000).alias("is_high"),
        numbers.income_band(balance).alias("band"),
        numbers.ratio(balance, nation).alias("per_nation"),
        numbers.above(numbers.ratio(balance, nation), numbers.DEBT_RATIO_LIMIT).alias("high_ratio"),
    )


@query(
    "q_unflagged",
    with_inputs(
        {},
        """
        select Customer_ID, cast(snapshot_date as varchar) as snapshot_date, try_cast(Interest_Rate as integer) as rate
        from {raw_financials} where not (try_cast(Interest_Rate as integer) < 0
                                     or try_cast(Interest_Rate as integer) > 11)
        """,
    ),
)
def unflagged(spark, sf_dir):
    """Rows whose flag is false."""
    rows = derive(spark, sf_dir, "raw_financials").select(
        "Customer_ID", "snapshot_date", text.to_int(F.col("Interest_Rate")).alias("rate")
    )
    flagged = range_flags(rows, {"rate": numbers.FINANCIAL_RANGES["Interest_Rate"]})
    return drop_columns(not_flagged(flagged, "rate_typo"), ["rate_typo", "no_such_column"])


@query(
    "q_duplicates",
    """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
           cast(count(*) over (partition by l_orderkey, l_linenumber) > 1 as varchar) as duplicate_line,
           cast(count(*) over (partition by l_suppkey, l_partkey) > 1 as varchar) as duplicate_offer,
           cast(count(*) over (partition by l_orderkey) > 1 as varchar) as duplicate_order
    from lineitem
    """,
)
def duplicates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    flagged = duplicate_flag(lines, ["l_orderkey", "l_linenumber"], "duplicate_line")
    flagged = duplicate_flag(flagged, ["l_suppkey", "l_partkey"], "duplicate_offer")
    return duplicate_flag(flagged, ["l_orderkey"], "duplicate_order")


@query(
    "q_zero_fill",
    with_inputs(
        {},
        """
        select loan_id, cast(snapshot_date as varchar) as snapshot_date, installment_num,
               coalesce(overdue_amt, 0) as overdue_amt
        from {raw_loan_book}
        """,
    ),
)
def zero_filled(spark, sf_dir):
    book = derive(spark, sf_dir, "raw_loan_book")
    return zero_fill(book.select("loan_id", "snapshot_date", "installment_num", "overdue_amt"))
