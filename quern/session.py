"""Session factory and the few settings that every plan relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; existing settings of a cluster win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used. A session that names none gets a temporary one
    only if all of it runs on this machine; on a cluster that is an error, as executors would not share it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession.conf.get("spark.checkpoint.dir", None), sc.master))
    return df.checkpoint(eager=True)


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder for checkpoints: the one named, else a temporary one in local mode only."""
    if named:
        return named
    if re.fullmatch(r"local(\[[^\]]*\])?", master):
        return tempfile.mkdtemp(prefix="quern-ckpt-")
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
