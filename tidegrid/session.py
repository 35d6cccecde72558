"""Session settings and the shared folder for tables written along the way."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidegrid", cores: str = "8", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local session may run without the setting; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def share_package(spark: SparkSession) -> None:
    """Send this package to every worker, once per application; executors that run its functions need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_tidegrid_sent", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):  # else it came in an archive itself
        path = os.path.join(tempfile.mkdtemp(prefix="tidegrid-"), "tidegrid.zip")
        with zipfile.ZipFile(path, "w") as packed:
            for folder, _, names in sorted(os.walk(top)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    file = os.path.join(folder, name)
                    packed.write(file, os.path.join("tidegrid", os.path.relpath(file, top)))
        context.addPyFile(path)  # the driver serves it
    context._tidegrid_sent = True


_MADE: dict[str, list[str]] = {}  # folders by application


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/tidegrid/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Folders that ``new_folder`` and ``materialize`` make inside are deleted at the end; results must be out by then."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for folder in made[before:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        del made[before:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing what came before,
    and later scans prune columns and row groups.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
