"""Session helpers: a sensible local session for tests/bench and the shared
checkpoint folder used to cut lineage in iterative operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tablab") -> SparkSession:
    """Session for tests and the local bench.  On a cluster, build your own
    session; every operator only uses the session it is handed."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TABLAB_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local master without one (tests) gets a private folder of its own;
    on a cluster a missing setting is an error, since a folder on the driver's
    disk would not be shared with the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="tablab-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for operators that
    must write an intermediate table (CSV round trips, model files)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _scratch.append(f"{base}/tablab-{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


# scratch paths of this application that still stand, oldest first
_scratch: list[str] = []


def scratch_mark() -> int:
    """How many scratch paths there are now; see :func:`clear_scratch`."""
    return len(_scratch)


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch paths made after ``since`` but those in ``keep``.
    Results that were not written elsewhere and read from them are gone too."""
    _delete(spark, [p for p in _scratch[since:] if p not in keep])


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the scratch paths that ``tables`` read, once nothing else
    reads them: the tables themselves are gone too."""
    for df in tables:
        folders = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
        _delete(df.sparkSession, [p for p in _scratch if os.path.basename(p) in folders])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _scratch.remove(path)
