"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: dict[str, str] = {}


def get_spark(app: str = "routestats", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; every one can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{key: str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, a laptop) gets a folder of its own, which
    goes when the program ends; on a cluster a machine-local folder would be invisible to the other
    executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="routestats-")
        atexit.register(shutil.rmtree, _OWN_SCRATCH[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN_SCRATCH[app])
    return _OWN_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, unique per call."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/routestats/{app}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/routestats/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss.

    Parquet rather than ``checkpoint()`` because later steps read few columns of it, and because
    the reader then knows the real size, which lets AQE choose join strategies by it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
