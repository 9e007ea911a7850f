"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants; cluster-specific sizing is left to the
# cluster's own configuration.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "ridelens", conf: dict | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC, no UI.

    ``master`` is only set when given (tests/bench use ``local[N]``); on a
    cluster the submitter decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` from the session.

    Only when the session names none and runs in one local process (tests) is a
    fresh scratch folder created and set; on a cluster that is an error, as
    executors cannot see each other's temporary folders. Works without
    a ``SparkContext`` handle (e.g. a remote session) as long as the folder is
    configured.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 – no context handle on this kind of session
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not fallback and not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = fallback or tempfile.mkdtemp(prefix="ridelens-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(path)
    else:
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 – a static setting on some sessions; the path is still returned
            pass
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "tables", name)
