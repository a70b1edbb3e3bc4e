"""Session helpers: a tuned local session for tests and benches, and the
checkpoint directory policy (read the cluster's setting, set one only when
it is missing)."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "parley", extra: dict | None = None) -> SparkSession:
    """Session for local runs. On a cluster, pass ``master=None`` and let
    spark-submit supply the master and resources."""
    b = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master:
        b = b.master(master)
        cores = re.fullmatch(r"local\[(\d+)\]", master)
        if cores:
            conf["spark.parley.textPartitions"] = cores[1]
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``parley`` importable in the Python workers (its pandas UDFs are
    pickled by reference): zip the package once per context and add it,
    as ``--py-files`` does on a cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_parley_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="parley-pkg-"), "parley.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._parley_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only when it is unset (local tests) do we create a scratch folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        d = tempfile.mkdtemp(prefix="parley-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def dealt(df):
    """Text-heavy input spread over ``spark.parley.textPartitions`` tasks. The
    setting is for small inputs in few files (local runs); where it is unset
    the input keeps its partitions and nothing is shuffled."""
    n = df.sparkSession.conf.get("spark.parley.textPartitions", None)
    return df.repartition(int(n)) if n else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: its rows are computed once, and a lost executor does not repeat the
    work (or the model calls) behind them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
