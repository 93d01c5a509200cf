"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.llm import (
    cotraining,
    decontamination,
    hash_forest,
    language_model,
    licenses,
    max_sketch,
    mixing,
    near_dedup,
    paragraphs,
    quality_rules,
    runs,
    secret_scan,
    url_filters,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"), licenses.standard_templates(spark))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a join whose one side is this small in every partition hashes it instead of sorting both
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


@query("op6_temperature_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.drop("text")


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filters.dated_captures(table(spark, sf_dir, "pages"))
    entries = url_filters.observed_entries(captures).union(url_filters.standing_entries(captures))
    found = url_filters.evaluated(captures, entries)
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scanned(docs, secret_scan.train(secret_scan.samples(docs)))


LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11_SQL = f"""
with texts as (
    select row_number() over () as row, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}') as terms
    from documents where text is not null),
counts as (
    select row, doc_id, len(terms) as n, unnest(terms) as term from texts),
tfs as (select row, doc_id, n, term, count(*) as tf from counts group by all),
whole as (select count(*) as nn, sum(len(terms))::bigint as ll from texts where len(terms) > 0),
asked as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')) as term
    from benchmark),
weights as (
    select term, floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * count(*) + 1)))::bigint as w
    from tfs, whole where term in (select term from asked) group by term, nn),
scores as (
    select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
    from asked join weights using (term) join tfs using (term), whole group by item_id, row, doc_id),
ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
    from scores where score > 0 and doc_id is not null)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


@query("op11_lexical_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digest(runs.periodic_runs(runs.with_repeated_tails(docs)))


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"))
