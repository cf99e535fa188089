"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "quarry",
                extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and scripts. On a cluster, pass master=None and
    let spark-submit provide it; only unset options are filled in here."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster
    (``spark.checkpoint.dir``). Only when it is unset (local tests) a private
    folder is created and registered."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for staged tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-stage/{name}-{uuid.uuid4().hex[:12]}"


def read_if_there(spark: SparkSession, path: str):
    """The Parquet table at ``path``, or None if nothing was written there yet;
    any other fault is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker (its pandas UDFs and
    mapInPandas functions refer to package code): zip the package once per
    application and register it with ``addPyFile``."""
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import quarry
    pkg_dir = os.path.dirname(os.path.abspath(quarry.__file__))
    base = tempfile.mkdtemp(prefix="quarry-pkg-")
    zip_path = shutil.make_archive(os.path.join(base, "quarry"), "zip",
                                   root_dir=os.path.dirname(pkg_dir), base_dir="quarry")
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)
