"""Global order as a column (ST-1, ST-5, SRC-3): ``position`` numbers the rows
of a result in their order, without one task that sees them all.

The rows are sorted by a range partitioning and written (the sample behind the
ranges may differ between runs of the same plan, so the partitions are fixed
before they are counted). A row's position is its number inside its partition
plus the rows of all partitions before it: a sum over one row per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.session import stored

#: monotonically_increasing_id() keeps the row number in its lower 33 bits.
_ROW_BITS = 33


def positioned(df: DataFrame, order: list[tuple[str, bool]], name: str = "position") -> DataFrame:
    """``df`` with ``name``: 1 for the first row in ``order``, a list of
    (column, ascending). The order should be total; rows that tie are numbered
    in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    sorted_ = stored(df.repartitionByRange(n, *by).sortWithinPartitions(*by)
                     .withColumn("_at", F.monotonically_increasing_id()), "positioned")
    part = F.shiftright("_at", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # One row per partition of the sort: small whatever the size of the table.
    return (sorted_.withColumn("_part", part).join(F.broadcast(bases), "_part")
            .withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1)
            .drop("_part", "_base", "_at"))
