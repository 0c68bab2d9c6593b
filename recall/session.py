"""Session settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session should carry; operators never depend on others.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "recall",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master may do without the setting (tests, single-machine runs): it gets a
    temporary folder. On a cluster each machine would write to its own disk, so
    that is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if not base:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="recall-ckpt-"))
        base = sc.getCheckpointDir()
    return base


_work_folders: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder for work tables under the shared checkpoint folder.

    It lasts as long as results may still read it: until ``clean_work_folders`` or the end of the
    program.
    """
    if not _work_folders:
        atexit.register(clean_work_folders)
    path = "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *parts, uuid.uuid4().hex])
    _work_folders.append((spark, path))
    return path


def clean_work_folders() -> None:
    """Delete the work tables made so far; results that still read them must have been written."""
    for spark, path in _work_folders:
        if spark.sparkContext._jsc is not None:  # the session is still running
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _work_folders.clear()
