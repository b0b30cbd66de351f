"""Session and storage plumbing shared by the loops and the streaming jobs."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", app: str = "flowgauge", **conf: str) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE, no web page)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: on a cluster a lost executor would take
    checkpointed blocks with it, so an unset folder is an error there.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by the cluster")
    root = os.path.join(tempfile.gettempdir(), f"flowgauge-{os.getuid()}-{os.getpid()}")
    os.makedirs(root, exist_ok=True)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, for one job's tables or stream checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, an iterative plan stays short and knows nothing of
    the rounds before it, and a lost executor costs its tasks only."""
    path = scratch_dir(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python on the executors import this package, from the shared folder; once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    where = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark, 'code')}/{root.name}.zip")
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(where.toString())
    _SHIPPED.add(context.applicationId)
