"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Archive of the package by application.
_SHIPPED: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: the cluster's `spark.checkpoint.dir`.

    Where the session names none, a temporary folder is set, but only with a local master; a cluster raises.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and (held := context.getCheckpointDir()):
        configured = held.rsplit("/", 1)[0]  # Spark adds a folder of its own
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tabloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship_code(spark: SparkSession) -> str:
    """Send this package to the executors, for a session that was not started with it installed on them.

    The archive holds the package's own source files only and lies in the shared folder. Once a session is enough;
    a second call sends nothing.
    """
    sent = _SHIPPED.get(spark.sparkContext.applicationId)
    if sent is not None:
        return sent
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent).as_posix())
        target = scratch_path(spark, package.name) + ".zip"
        content = archive.read_bytes()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(content)
    stream.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED[spark.sparkContext.applicationId] = target
    return target


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor re-reads the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


FEW_FILES = 16


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a table that comes from a handful of files.

    Large tables have far more files (and splits) than that and are left alone, as are tables without
    files; a table in one small file would otherwise be processed by a single task. Only the listing is
    looked at, nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or not 0 < len(df.inputFiles()) <= min(FEW_FILES, cores):
        return df
    keys = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    # By hash, since a round-robin exchange would sort its input first.
    return df.repartition(cores, *keys)
