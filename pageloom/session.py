"""Session helpers: table access, shared scratch tables and default settings."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each application.

    Spark's file server of the driver hands it out, so it needn't be installed
    on the workers' machines.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pageloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/pageloom.zip", "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, f"{package.name}/{file.relative_to(package)}")
    spark.sparkContext.addPyFile(f"{folder}/pageloom.zip")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts and images to Python in batches of few rows, unless the session has its own setting.

    The default of 10,000 rows is meant for numbers; with texts a batch, its
    copy in Python and what is made of it would take hundreds of MB a task. The
    reader's batches shrink too, whose buffers for long texts are large objects.
    """
    for key, default, own in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", rows // 2),
    ):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, str(own))


def parted(df: DataFrame) -> DataFrame:
    """Rows over as many tasks as the session shuffles to, for Python work that costs more than the rows' size tells."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all tasks run on this machine, as in local
    tests, a temporary folder of this process takes its place; on a cluster
    without it rows would be written to many machines' own disks, so that is
    refused.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _scratch:
        _scratch[key] = tempfile.mkdtemp(prefix="pageloom-")
        atexit.register(shutil.rmtree, _scratch[key], True)
    return _scratch[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor costs nothing then but its running tasks; the files are
    removed when the driver ends, on whatever file system they are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _removed_at_end(spark, path)
    return spark.read.parquet(path)


def _removed_at_end(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A session on this machine with the settings used by tests and the bench."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # each task is a worker of its own
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pageloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
