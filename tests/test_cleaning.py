from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from snapmart.functions import numbers, text
from snapmart.operators.columns import apply_schema, not_flagged, zero_fill
from snapmart.operators.delinquency import delinquency, label_at
from snapmart.operators.quality import duplicate_flag


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "function, values, expected",
    [
        (text.letters_and_spaces, ["  Ann 2nd! ", "O'Neil", None, ""], ["Ann nd", "ONeil", None, ""]),
        (text.without_whitespace, ["1 2\t3", None], ["123", None]),
        (text.digits, ["28_", "-500", "", None], ["28", "500", "", None]),
        (text.to_int, ["12.0", "12.9", "-3.9", "", "x", None, "99999999999"],
         [12, 12, -3, None, None, None, None]),
        (text.clean_number, ["1200.5_", "__10000__", "-4", "", "1.2.3", None],
         [1200.5, 10000.0, 4.0, None, None, None]),
        (lambda c: text.clean_number(c, signed=True), ["-100", "3_", "--5"], [-100.0, 3.0, None]),
        (lambda c: text.replace_value(c, "_______", "Unknown"), ["_______", "_", None],
         ["Unknown", "_", None]),
        (lambda c: text.null_if(c, "_"), ["_", "Good", None], [None, "Good", None]),
        (text.default_text, [None, "x"], ["not specified", "x"]),
        (text.without_conjunction, [" A, and B ", "Brand New", None], ["a, b", "brnew", None]),
        (text.duration_months, ["22 Years and 3 Months", "1 Year", "7 Months", "NA", "", None],
         [267.0, 12.0, 7.0, 0.0, 0.0, 0.0]),
        (lambda c: text.code_part(c, 2), ["Low_spent_Small_value", "Unknown", "Low_spent", None],
         ["Small", "Unknown", None, None]),
        (text.yes_no, ["Yes", "YES", "No", "NM", None], [True, True, False, False, False]),
        (text.item_list,
         ["A Loan, b", "not specified", "a, Not Specified,", "", ",,", "not specified,not specified", None],
         [["a loan", "b"], ["not specified"], ["a"], ["not specified"], ["not specified"],
          ["not specified"], None]),
    ],
)
def test_text(spark, function, values, expected):
    assert apply(spark, function, values) == expected


@pytest.mark.parametrize(
    "function, values, expected",
    [
        (lambda c: numbers.ratio(F.lit(6.0), c), [3.0, 0.0, None], [2.0, None, None]),
        (lambda c: numbers.outside(c, 0, 9), [-1.0, 0.0, 9.0, 9.5, None],
         [True, False, False, True, None]),
        (numbers.income_band, [2500.0, 2501.0, 10000.0, 10000.5, None],
         ["Low", "Medium", "Medium", "High", "Medium"]),
        (numbers.whole, [2.9, -2.9, None], [2, -2, None]),
    ],
)
def test_numbers(spark, function, values, expected):
    assert apply(spark, function, values, "double") == expected


def test_schema_and_fill(spark):
    df = spark.createDataFrame([("7.0", "x", "2024-03-31")], "a string, b string, d string")
    row = apply_schema(df, {"a": "int", "b": "double", "d": "date"}).first()
    assert (row["a"], row["b"], str(row["d"])) == (7, None, "2024-03-31")
    filled = spark.createDataFrame([(None, None, None)], "a int, b double, c string")
    assert tuple(zero_fill(filled).first()) == (0, 0.0, None)
    assert tuple(zero_fill(filled, ["a"]).first()) == (0, None, None)


def test_null_flag_excludes(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, flag boolean")
    assert [r["i"] for r in not_flagged(df, "flag").collect()] == [2]


def test_delinquency(spark):
    rows = [
        ("a", 6, 32.0, 10.0, "2024-03-31"),   # 3.2 installments: four months back
        ("b", 6, 0.0, 10.0, "2024-03-31"),
        ("c", 6, 5.0, 10.0, "2024-03-31"),    # one month back, clamped to the end of February
        ("d", 6, 5.0, 0.0, "2024-03-31"),     # nothing due: no missed date, days unknown
        ("e", 6, None, 10.0, "2024-03-31"),
        ("f", 5, 32.0, 10.0, "2024-03-31"),
    ]
    df = spark.createDataFrame(
        rows, "loan_id string, installment_num int, overdue_amt double, due_amt double, d string"
    ).withColumn("snapshot_date", F.col("d").cast("date"))
    got = {
        r["loan_id"]: (r["installments_missed"], str(r["first_missed_date"]), r["dpd"])
        for r in delinquency(df).collect()
    }
    assert got["a"] == (4, "2023-11-30", 122)
    assert got["b"] == (0, "None", 0)
    assert got["c"] == (1, "2024-02-29", 31)
    assert got["d"] == (0, "None", None)
    assert got["e"] == (0, "None", 0)
    labels = {r["loan_id"]: r["label"] for r in label_at(delinquency(df)).collect()}
    assert labels == {"a": 1, "b": 0, "c": 1, "d": 0, "e": 0}


def test_duplicates_with_null_and_hot_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else str(i), "n") for i in range(300)] + [(900, None, "n"), (901, None, "m")]
    df = spark.createDataFrame(rows, "i int, k string, n string")
    one = {r["i"]: r["dup"] for r in duplicate_flag(df, ["k"], "dup").collect()}
    assert len(one) == 302
    assert all(one[i] == (i % 3 == 0) for i in range(300)) and one[900] and one[901]
    two = {r["i"]: r["dup"] for r in duplicate_flag(df, ["k", "n"], "dup").collect()}
    assert two[0] and not two[900] and not two[1]
