"""Tables written once to the shared folder and read back: they cut lineage, survive lost executors and are scanned once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Tables that later queries on the same input may read: (application, input, name) -> path.
_shared: dict[tuple, str] = {}
#: Folders that end with the session, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one, removed at exit, only where a local session leaves it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _local:
        folder = tempfile.mkdtemp(prefix="quantloom-panel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local["dir"] = "file://" + folder
    return _local["dir"]


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing will read again."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def remove_all(spark: SparkSession) -> None:
    """Delete every table that this session has staged; call it when no result of its queries is read any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)
    for key in [k for k in _shared if k[0] == spark.sparkContext.applicationId]:
        del _shared[key]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def input_key(spark: SparkSession, folder: str) -> tuple:
    """What is in a folder's files just now: names, sizes and times, as far as two levels."""
    fs, p = _folder(spark, folder)
    out = []
    for x in fs.listStatus(p):
        parts = fs.listStatus(x.getPath()) if x.isDirectory() else [x]
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in parts]
    return tuple(sorted(out))


def for_input(spark: SparkSession, folder: str, name: str, build, *, make: bool = True) -> DataFrame | None:
    """A table derived from a folder, staged once for all queries of the session on the same files.

    ``build`` makes it; without ``make`` the result is None where it does not exist yet.
    """
    key = (spark.sparkContext.applicationId, input_key(spark, folder), name)
    if key not in _shared:
        if not make:
            return None
        df = build()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _made.setdefault(key[0], []).append(path)
        _shared[key] = path
    return spark.read.parquet(_shared[key])
