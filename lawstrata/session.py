"""Session set-up and the scratch tables that cut long lineages.

A scratch table is a Parquet table in the folder that all executors share. It survives the loss
of an executor, it can be read column by column, and its size is known to the planner. The folder
is the session's ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a temporary
folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "lawstrata", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work; on a cluster, use the session that the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each session; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lawstrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lawstrata-")) / "lawstrata.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(Path("lawstrata") / file.relative_to(root)))
    sc.addPyFile(str(target))
    sc._lawstrata_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; on one machine, where none is set, a temporary one that is noted in the session."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lawstrata-")
        spark.conf.set(CHECKPOINT_KEY, folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone by then
        pass


class Scratch:
    """Tables written for one run of an operator, removed when the driver ends or on ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.path)

    def cut(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` once, in a folder for each value of ``by`` if given, and give it back as a table without lineage."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def drop(self, name: str | None = None) -> None:
        _remove(self.spark, self.path if name is None else f"{self.path}/{name}")


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def enough_partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions so that none holds more than about ``per_partition`` rows, and no fewer than the session's."""
    return max(parallelism(spark), -(-rows // per_partition))
