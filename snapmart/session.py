"""Session settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # runtime plans: joins by actual size, split hot partitions, merge small ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM compiles methods up to this size only; wider projections run faster outside of one
    # generated method than in one that is interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # tables that jobs write and read back take less disk than with the default
    "spark.sql.parquet.compression.codec": "zstd",
    # dates and timestamps do not depend on where the job runs
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
