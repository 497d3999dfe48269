"""Session helpers shared by the layout operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", conf: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted configuration is used instead."""
    own = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master(master).appName("quire").config(map=own | (conf or {})).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is absent (tests, single machine) a folder of our own is
    created once per session; a non-local master without the setting is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at :func:`shared_dir` if nothing has done so yet."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, tag: str) -> str:
    return os.path.join(shared_dir(spark), f"quire-{tag}-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage of ``df`` with a parquet table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.parquet(path)
