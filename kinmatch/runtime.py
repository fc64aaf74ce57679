"""Session-level helpers: tables, shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all cores, where a scan of few files would leave most of them idle; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    go without the setting; it then gets a folder of its own.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not jsc.getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    present = jsc.getCheckpointDir()
    if present.isDefined():
        return present.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="kinmatch-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already when the interpreter ends
        pass


class Scratch:
    """Written intermediate tables of one operator run.

    ``write`` stores a DataFrame as Parquet in the shared folder and returns it
    read back, which cuts the lineage and survives the loss of executors.
    ``drop`` removes a table that no later plan reads; the others are removed
    when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/kinmatch-{label}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._count = 0
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/t{self._count}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._scratch_path = path  # keeps the id and the path together
        return back

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver took it from."""
    sc = spark.sparkContext
    if getattr(sc, "_kinmatch_shipped", False):
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="kinmatch-py-")  # Spark copies the archive to the executors
    archive = f"{folder}/kinmatch_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._kinmatch_shipped = True
