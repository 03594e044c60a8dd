"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codelode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the session is local, as in tests, a
    folder of this machine is chosen, and removed when the process ends. A cluster without the setting is an error: its
    executors don't share a machine's folder.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="codelode-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: iterations over it don't grow the plan, and a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: as safe as ``cut_lineage``, smaller on disk, and read column by column."""
    import uuid

    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_written(spark: SparkSession) -> None:
    """Removes the tables and checkpoints of this session's finished queries. Results that weren't consumed yet would lose their rows."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        if status.getPath().getName() == "tables" or status.getPath().getName().startswith("rdd-"):
            fs.delete(status.getPath(), True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the session's Python workers, once per application.

    Needed where the workers' path doesn't have it: they import the package that the functions they
    are sent belong to. The archive lies in the shared checkpoint folder and is served by the driver.
    """
    app = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parent.parent
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or root in on_path or Path.cwd().resolve() == root:
        return
    folder = checkpoint_dir(spark)
    local = folder.removeprefix("file://").removeprefix("file:") if folder.startswith(("file:", "/")) else tempfile.mkdtemp(prefix="codelode-")
    os.makedirs(local, exist_ok=True)
    archive = Path(local, f"codelode-{app}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
