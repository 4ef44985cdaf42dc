"""Session helpers: builder defaults, shared scratch space, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def build(master: str | None = None, app: str = "tracksift", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; every setting can be overridden by the cluster's own."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; always through Spark's reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that the frame doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tracksift_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tracksift-")) / "tracksift_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
    sc.addPyFile(str(path))
    sc._tracksift_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all is local (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"/tmp/checkpoints/{os.getpid()}"
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the application's part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/tracksift/{sc.applicationId}"
    if getattr(sc, "_tracksift_scratch", None) != root:
        _filesystem(spark, root).deleteOnExit(sc._jvm.org.apache.hadoop.fs.Path(root))
        sc._tracksift_scratch = root
    _made.append(f"{root}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def _filesystem(spark: SparkSession, path: str):
    sc = spark.sparkContext
    return sc._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration())


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that nothing needs any more."""
    for p in paths:
        _filesystem(spark, p).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)
        _made.remove(p)


def scratch_paths() -> list[str]:
    """The scratch paths that are there, oldest first."""
    return list(_made)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The shuffle files behind the frame go as soon as it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_paths(df: DataFrame) -> None:
    """Delete the files behind a frame made by cut(), once nothing needs it any more."""
    # a scratch path ends in a name of its own
    names = {f.split("/")[-2] for f in df.inputFiles()}
    drop(df.sparkSession, *(p for p in scratch_paths() if p.rpartition("/")[2] in names))
