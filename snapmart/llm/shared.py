"""Tables that a job writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.sources.snapshots import shared_folder


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, for all machines."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` gave and that nothing still to run reads."""
    spark = table.sparkSession
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def same(left: Column, right: Column) -> Column:
    """Null-safe equality: nulls are one value."""
    return left.eqNullSafe(right)


def text_key(df: DataFrame) -> Column:
    """A hash of the row's text; with the doc_id it names what a verdict is about."""
    return F.xxhash64(df.text.cast("binary"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts: the number from which jobs derive how many parts to work in."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
