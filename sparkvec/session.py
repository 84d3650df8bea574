"""Session helpers: settings for a local session and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, memory: str = "12g", name: str = "sparkvec") -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoint() writes to.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``; it is used as it is.
    Only where the setting is absent (tests, local runs) a temporary folder of this machine is set.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"sparkvec-checkpoint-{os.getpid()}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


_shared: list[tuple[object, object]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder; it is removed when the process ends, if it still can be."""
    at = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not _shared:
        atexit.register(_remove)
    _shared.append((path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))
    return at


def _remove() -> None:
    for fs, path in _shared:
        with contextlib.suppress(Exception):  # the JVM may be gone
            fs.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder: smaller than a checkpoint, and only the columns asked for are read."""
    at = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that its functions can run in their Python workers."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="sparkvec-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f.name)
