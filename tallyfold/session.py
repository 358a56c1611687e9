"""Session defaults for local runs and the checkpoint folder rule for clusters."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tallyfold", shuffle_partitions: int = 8) -> SparkSession:
    """Build a session for tests and the bench.

    A cluster job passes its own session; nothing in the library calls this.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a local session gets one of its own, removed when the
    driver ends; on a cluster a local folder would be a different one on every
    machine, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="tallyfold-")
        atexit.register(shutil.rmtree, _LOCAL, ignore_errors=True)
    return _LOCAL


_LOCAL: str | None = None


def numbered_once(df: DataFrame) -> DataFrame:
    """``df`` fixed at its first use, so that row numbers drawn in it are the same wherever it is read.

    Nothing runs until a query over it does.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=False)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a folder of its own below the shared one, as compressed columns, and read from there.

    For large inputs that several branches of a plan read some columns of; a checkpoint
    would hold all of their rows uncompressed.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tallyfold-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    For inputs that several branches of one plan read and for the rounds of an
    iteration, so that neither is computed again and a lost executor does not
    start them over.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
