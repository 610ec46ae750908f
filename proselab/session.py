"""SparkSession defaults and the checkpoint-directory contract.

Cluster jobs get their session from the platform; these helpers only fill in
settings that are unset.  The checkpoint directory is always read from
``spark.checkpoint.dir`` (a shared, fault-tolerant folder on a cluster); a
private scratch folder is created only in local mode, when nothing is
configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on (semantics, not tuning).
_SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "proselab",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with this library's defaults.

    ``master``/``shuffle_partitions`` are for local runs; on a cluster leave
    them ``None`` and let the deployment decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_SEMANTIC_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    # checkpoint files of DataFrames that are gone are deleted by the cleaner
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring Spark to use it.

    Reads ``spark.checkpoint.dir`` from the session.  Only in local mode,
    where one machine is the cluster, an unset folder is replaced by a fresh
    scratch folder; on a cluster that would be one node's disk, so it is an
    error."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="proselab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (Arrow UDFs,
    ``mapInPandas``) by adding a zip of it with ``addPyFile`` — the same as
    ``--py-files`` at submit time.  Once per application; a no-op without a
    SparkContext (Spark Connect servers get the code at deployment)."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    path = os.path.join(tempfile.mkdtemp(prefix="proselab-pyfiles-"), "proselab.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
