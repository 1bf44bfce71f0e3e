"""Sessions and the shared folder intermediate tables are written to."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import SpecError

_own_roots: dict[str, str] = {}
_shipped: set[tuple[str, str]] = set()


def build_session(app_name: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; sizing is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession, folder: str | Path = Path(__file__).parent) -> None:
    """Send a Python package to the workers, once per application.

    Needed where the package is neither installed on the executors nor passed to the session
    with ``--py-files``.
    """
    folder = Path(folder)
    key = (spark.sparkContext.applicationId, str(folder))
    if key in _shipped:
        return
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='tidemill-ship-')}/{folder.name}", "zip", folder.parent, folder.name
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(key)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when the session names one.

    Only a local session gets a folder of its own; on a cluster a machine-local one would
    lose data with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise SpecError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="tidemill-")
        context.setCheckpointDir(_own_roots[app])
    return _own_roots[app]


def scratch_root(spark: SparkSession) -> str:
    """This application's folder of intermediate tables."""
    return f"{shared_root(spark)}/tidemill/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative work, survives the loss of executors, and gives the
    optimizer the true size of the intermediate result.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table nothing reads any more."""
    if not path.startswith(f"{scratch_root(spark)}/"):
        raise SpecError(f"{path} is not an intermediate table of this application")
    delete_folder(spark, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all intermediate tables; call it once the results built on them were used."""
    delete_folder(spark, scratch_root(spark))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return [f.getPath().getName() for f in found if f.isDirectory()]
