"""Operator 6, exact dedup: group by a 128-bit content hash and compare bytes
inside the groups.

Two texts are equal when they are identical after deleting ASCII white space.
A first pass counts the 128-bit hashes (map-side partial sums). A second pass
carries the text only of rows whose hash occurs more than once; inside such a
group every text is compared byte by byte with that of a representative. Rows
that differ from it (a hash collision) form the next round, which picks a new
representative, until every row has its class.

Hot groups: counts and keepers are partial aggregates. A group meets its
representative in a join that Spark splits by size, and its keeper in parts of
about ``PART`` rows, each with a copy of the keeper. No group is ever gathered
into one task.

Defined results: a null text is the empty text; empty texts equal each other;
of rows with equal length the smallest id stays, a null id after all others;
of rows repeated with their id exactly one has ``kept``; an empty table gives
an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WHITE, prepare, texts, written

PART = 256


def content_hash(text: Column) -> Column:
    """128-bit hash as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_fn: Callable[[Column], Column] = content_hash, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    and with ``row_col`` that column as row. ``hash_fn`` exists so that tests
    can force collisions."""
    prepare(docs.sparkSession)
    row = ["row"] if row_col else []
    rows = texts(docs, id_col, text_col, row_col).select(
        *row, "doc_id", F.char_length("text").alias("n_cp"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("h", hash_fn(F.col("norm")))
    many = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "dedup-many")
    # One pass over the texts: a row of a larger group keeps its bytes, any
    # other row only its digest.
    base = written(rows.join(many, "h", "left").select(
        *row, F.monotonically_increasing_id().alias("uid"), "doc_id", "n_cp", "h", F.ceil(F.col("n") / PART).alias("parts"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.when(F.col("n").isNotNull(), F.col("norm")).alias("norm")), "dedup-rows")
    single = base.where("norm IS NULL").select(
        *row, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    left, found, turn = base.where("norm IS NOT NULL"), [], 0
    while True:
        reps = left.groupBy("h").agg(F.min("uid").alias("uid"))
        reps = left.select("h", "uid", F.col("norm").alias("rep")).join(reps, ["h", "uid"]).select("h", "rep")
        compared = written(left.join(reps, "h").select(
            *row, "uid", "doc_id", "n_cp", "h", "parts", "text_sha256", F.lit(turn).alias("turn"),
            F.when(F.col("norm") != F.col("rep"), F.col("norm")).alias("norm")), "dedup-compared")
        found.append(compared.where("norm IS NULL").drop("norm"))
        left = compared.where("norm IS NOT NULL").drop("turn")
        if left.isEmpty():
            break
        turn += 1
    same = found[0]
    for f in found[1:]:
        same = same.unionByName(f)
    keepers = same.groupBy("h", "turn").agg(
        F.count("*").alias("group_size"), F.max("parts").alias("parts"),
        F.min(F.struct((-F.col("n_cp")).alias("size"), F.col("doc_id").isNull().alias("null"), "doc_id", "uid")).alias("best"))
    keepers = keepers.select("h", "turn", "group_size", "best", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = same.withColumn("part", F.pmod("uid", "parts"))
    grouped = dealt.join(keepers, ["h", "turn", "part"]).select(
        *row, "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")
    return single.unionByName(grouped)
