"""A registry of trained models: immutable folders, one row each, and a pointer to the one in use."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from snapmart.operators.modeling import load_model
from snapmart.sources.published import publish, read_published, resolve

REGISTRY = """model_version string, kind string, path string, features array<string>,
    fit_versions map<string, long>, metrics map<string, double>"""


def registry(spark: SparkSession, root: str) -> DataFrame:
    return read_published(spark, f"{root}/registry", schema=REGISTRY)


def register(
    spark: SparkSession,
    root: str,
    model: PipelineModel,
    kind: str,
    metrics: dict[str, float],
    fit_versions: dict[str, int] | None = None,
    version: str | None = None,
) -> str:
    """Save a model in a folder of its own and enter it; returns its version (v1, v2, ... unless
    named). A version is entered once and never rewritten; what was saved without being entered
    is not seen by anyone."""
    known = registry(spark, root)
    version = version or f"v{known.count() + 1}"
    if known.filter(F.col("model_version") == version).take(1):
        raise ValueError(f"{version} is registered")
    path = f"versions/{version}-{uuid.uuid4().hex}"
    model.write().save(f"{root}/{path}")
    row = (version, kind, path, list(model.stages[0].getInputCols()), fit_versions or {}, metrics)
    publish(known.unionByName(spark.createDataFrame([row], REGISTRY)), f"{root}/registry", None)
    return version


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Point to the version that scoring uses unless told otherwise: one small write."""
    entry(spark, root, version)
    publish(spark.createDataFrame([(version,)], "model_version string"), f"{root}/promoted", None)


def promoted(spark: SparkSession, root: str) -> str | None:
    if resolve(spark, f"{root}/promoted") is None:
        return None
    return read_published(spark, f"{root}/promoted").first()["model_version"]


def entry(spark: SparkSession, root: str, version: str) -> Row:
    found = registry(spark, root).filter(F.col("model_version") == version).first()
    if found is None:
        raise LookupError(f"no model {version} in {root}")
    return found


def load(spark: SparkSession, root: str, version: str) -> PipelineModel:
    return load_model(f"{root}/{entry(spark, root, version)['path']}")


def fit_versions(spark: SparkSession, lake: str, names: Sequence[str]) -> dict[str, int]:
    """The version of each fitted table that the features were made with."""
    found = {name: resolve(spark, f"{lake}/fitted/{name}") for name in names}
    return {name: version.number for name, version in found.items() if version is not None}
