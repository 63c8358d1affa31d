"""Session helpers: settings for local runs and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", _own_folder())
        .getOrCreate()
    )


def _own_folder() -> str:
    """A folder of this process, for sessions on one machine."""
    folder = tempfile.mkdtemp(prefix="spark-tidemark-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application: a worker that was not started beside it could not load the
    functions that tasks name. Spark serves the archive to every executor, also to one that joins later."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-tidemark-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/tidemark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.join("tidemark", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A session on one machine without one gets a folder of
    its own; on a cluster there is no folder that would do, and rows written to it would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = _own_folder()
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_folders: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """The folder of this application inside the shared one; taken away when the driver's process ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone; a local folder can be removed without it
        shutil.rmtree(folder.removeprefix("file://"), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later passes neither recompute it nor depend on an
    executor that may be lost."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
