"""Training and scoring on the gold stores."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.operators.columns import feature_columns
from snapmart.operators.datasets import pair_labels, stratified_split, time_holdout
from snapmart.operators.evaluation import choose_model
from snapmart.operators.modeling import SEED, quality_by_split, score, train
from snapmart.plans.models import fit_versions, load, promote, promoted, register
from snapmart.sources.published import as_date, lagged, publish, read_version, resolve
from snapmart.sources.snapshots import at_snapshot, shared_folder, within_months_before, write_table

log = logging.getLogger(__name__)

MONTHS = 18
KEYS = ["loan_id", "Customer_ID", "snapshot_date"]
IDS = ["Customer_ID", "loan_id", "feature_snapshot_date", "snapshot_date"]


def split_set(
    paired: DataFrame,
    keys: Sequence[str] = KEYS,
    label: str = "label",
    date_col: str = "snapshot_date",
    months: int = MONTHS,
    share: float = 0.2,
    seed: int = SEED,
) -> DataFrame:
    """Labelled rows of the last ``months`` months with a ``split`` column: train, test or oot.

    The newest month is out of time; the others are split by class.
    """
    recent = time_holdout(paired, date_col, months)
    in_time = F.col("period") == "development"
    development = stratified_split(recent.filter(in_time), label, keys, share, seed)
    return development.unionByName(
        recent.filter(~in_time).withColumn("split", F.lit("oot"))
    ).drop("period")


def training_set(
    features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, label: str = "label"
) -> DataFrame:
    """Features paired with labels by key and split.

    Splitting looks at the pairs several times, so they are joined once and saved.
    """
    pairs = pair_labels(features, labels, keys, label)
    path = shared_folder(features.sparkSession)
    write_table(pairs, path)
    return split_set(features.sparkSession.read.schema(pairs.schema).parquet(path), keys, label)


def train_models(
    data: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = KEYS,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
    label: str = "label",
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit both kinds of model on 'train' and measure them on every split."""
    grids = grids or {}
    parts = {name: data.filter(F.col("split") == name) for name in ("train", "test", "oot")}
    models = {
        kind: train(parts["train"], features, keys, kind, label, grids.get(kind), folds).bestModel
        for kind in ("logistic", "forest")
    }
    return models, quality_by_split(models, parts, label)


#: fitted tables whose versions a model is registered with
FITS = ["attributes/means", "attributes/indexes", "financials/means", "financials/indexes", "financials/loan_types"]


def run_training(
    spark: SparkSession,
    lake: str,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
    features: Sequence[str] | None = None,
) -> str | None:
    """Train on the gold stores, register the better model and promote it. Returns its kind.

    A lake without stores, or without a label, trains nothing, writes nothing and returns None.
    """
    stores = {name: resolve(spark, f"{lake}/gold/{name}") for name in ("label_store", "feature_store")}
    if any(found is None or not found.rows for found in stores.values()):
        log.warning("nothing to train on in %s: label or feature store is absent or empty", lake)
        return None
    # the newest date first, from the manifest, so that both scans read only the months of the set
    newest = max(day for day in stores["label_store"].parts if day is not None)
    first = lagged(newest, 1 - MONTHS)
    labels, store = (
        within_months_before(read_version(spark, stores[name], first, newest), newest, MONTHS)
        for name in ("label_store", "feature_store")
    )
    names = list(features or feature_columns(store, IDS))
    # splitting looks at the pairs several times, so they are joined once and saved
    pairs = read_version(spark, publish(pair_labels(store, labels, KEYS), f"{lake}/gold/labelled_features", None))
    data = read_version(spark, publish(split_set(pairs), f"{lake}/gold/training_set", None))
    models, quality = train_models(data, names, grids=grids, folds=folds)
    measured = read_version(spark, publish(quality, f"{lake}/gold/model_quality", None))
    best = choose_model(measured, "forest", "logistic", metric="probability_auc").first()["model"]
    metrics = {
        f"{r['split']}_{m}": r[m]
        for r in measured.filter(F.col("model") == best).collect() for m in ("auc", "f1", "probability_auc")
    }
    root = f"{lake}/models"
    promote(spark, root, register(spark, root, models[best], best, metrics, fit_versions(spark, lake, FITS)))
    return best


def run_scoring(
    spark: SparkSession,
    lake: str,
    on: date | str,
    model_version: str | None = None,
    prediction_date: datetime | None = None,
) -> str | None:
    """Score the features of one snapshot with a registered model, the promoted one unless named.

    Returns its version, or None where there is no model or no features of that snapshot: nothing
    is written then.
    """
    root = f"{lake}/models"
    version = model_version or promoted(spark, root)
    store = resolve(spark, f"{lake}/gold/feature_store")
    if version is None or store is None or as_date(on) not in store.parts:
        log.warning("nothing to score in %s for %s: no %s", lake, on, "model" if version is None else "features")
        return None
    rows = at_snapshot(read_version(spark, store, on, on), on)
    scored = score(load(spark, root, version), rows, IDS, version, prediction_date or datetime.now())
    publish(scored, f"{lake}/gold/predictions")
    return version
