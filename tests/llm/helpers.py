"""Small document tables with every odd case, and readers of driver tables."""

import random

import pyarrow.parquet as pq
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("row", StringType()), StructField("h", StringType()), StructField("held", IntegerType())])


def frame(spark, pairs):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, "x", "y", 0) for i, t in pairs], DOCS)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "été", "ñandú", "x1", "of", "the"]) + rng.choice(["", "", ",", "."])
                    for _ in range(n))


def odd_documents():
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 60)
    rows = [(1, base), (2, base + "  "), (3, base.replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n"), (7, long), (8, long + " end"),
            (9, base), (9, base), (None, base), (None, "only here"), (10, "one"), (11, "Two words"), (12, "ß Ünïcode   wide"),
            (13, "x" * 50_000), (14, "a b"), (15, "<|endoftext|> </s>")]
    return rows + [(100 + i, words(rng, rng.randint(1, 200))) for i in range(60)]


def driver(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()
