"""Session defaults and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import atexit
import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


#: Intermediate tables written by this process.
_written: list[str] = []


def get_session(master: str | None = None, app: str = "orewright", shared: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults; ``shared`` is the folder all executors share, ``conf`` keys use ``__`` for dots.

    Without ``master`` the one that the application was submitted with is kept, else all local cores are used.
    """
    builder = (
        SparkSession.builder.master(master or SparkConf().get("spark.master", "local[*]"))
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of a session, once, so that it needn't be installed on the executors.

    The archive goes through the shared folder. Operators whose Python code uses modules of the package call this first.
    """
    context = spark.sparkContext
    if getattr(context, "_orewright_shipped", False):
        return
    context._orewright_shipped = True
    root = Path(__file__).resolve().parent
    if not root.is_dir():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.writestr(f"{root.name}/{path.relative_to(root)}", path.read_bytes())
    content = data.getvalue()
    name = f"{shared_dir(spark)}/{root.name}-{hashlib.sha256(content).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(content))
    out.close()
    context.addPyFile(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all work is done in this process (master ``local``) a temporary folder is used; on a
    cluster an unset folder is an error, as executors would write to disks of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_orewright_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="orewright-")
        spark.sparkContext._orewright_dir = own
        atexit.register(_remove, own)
    return own


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut of the lineage that survives lost executors.

    With ``by`` each value of those columns gets a folder of its own, which a filter on them reads alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orewright_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that nothing reads any more, such as those of a finished round."""
    for df in tables:
        path = getattr(df, "_orewright_path", None)
        if path in _written:
            _delete(df.sparkSession, path)
            _written.remove(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one, for files in other formats; ``clear_shared`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``new_folder`` that nothing reads any more."""
    if path in _written:
        _delete(spark, path)
        _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def default_parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clear_shared(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this process wrote; results that still read them become unusable."""
    for path in _written:
        _delete(spark, path)
    _written.clear()
