"""Session defaults and durable lineage cuts shared by every operator."""

from __future__ import annotations

import io
import os
import pathlib
import re
import tempfile
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "paperloom", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the one that is given."""
    conf = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame, estimates: bool = True) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that lost executors lose nothing.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set a local session makes
    its own; on a cluster that is an error, as a machine's own folder is lost with the machine.
    A checkpoint keeps the planner's estimate of its size; loops with joins drop it (``estimates``).
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-checkpoint-"))
    kept = df.checkpoint(eager=True)
    if estimates:
        return kept
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), session)


def together(*jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the jobs return, each run in a thread of its own, so that the small stages of one fill the gaps of another."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all machines share, or None in a local session without one."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file on any file system that the session knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def zipped(root: str) -> bytes:
    """This package as a zip archive."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(pathlib.Path(root, "paperloom").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    return held.getvalue()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it where the driver did; from the shared folder if there is one."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.getcwd() == root or root in known or getattr(spark.sparkContext, "_paperloom_shipped", False):
        return
    name = f"paperloom-{spark.sparkContext.applicationId}.zip"
    folder = shared_folder(spark)
    if folder:
        path = f"{folder.rstrip('/')}/{name}"
        write_bytes(spark, path, zipped(root))
    else:
        path = os.path.join(tempfile.mkdtemp(prefix="paperloom-package-"), name)
        with open(path, "wb") as file:
            file.write(zipped(root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._paperloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table: one Parquet file or directory per table."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
