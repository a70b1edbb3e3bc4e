"""File paths as listings spell them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def below(spark: SparkSession, root: str, path: Column) -> Column:
    """The part of ``path`` below the folder ``root``; NULL outside it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/") + "/"
    if full.startswith("file:/"):  # listings differ in the slashes behind "file:"
        full = "file:///" + full.removeprefix("file:").lstrip("/")
    shown = F.regexp_replace(path, "^file:/+", "file:///")
    return F.when(F.startswith(shown, F.lit(full)), F.substring(shown, len(full) + 1, 1 << 20))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
