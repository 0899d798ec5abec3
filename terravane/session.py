"""What a Spark session needs before this package's Python code runs on executors, and tables between its steps."""

from __future__ import annotations

import atexit
import contextlib
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, unless their Python path has it already."""
    home = Path(__file__).resolve().parent
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    installed = any(str(home.parent) == str(Path(p).resolve()) and "site-packages" in p for p in sys.path if p)
    app = spark.sparkContext.applicationId
    if str(home.parent) in on_path or installed or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="terravane-zip-")) / "terravane.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


#: Intermediate paths of this process, by application, for cleanup().
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may do without it: there a temp
    folder is shared by all; a cluster without it raises."""
    ship_package(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="terravane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; cleanup() deletes it."""
    path = f"{shared_dir(spark)}/terravane/{name}-{uuid.uuid4().hex}"
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    if not made:
        atexit.register(_at_exit, spark)
    made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it from there: lineage ends, lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application, once its results are written; the number deleted. Frames
    that operators returned can't be read afterwards. Called when the driver's process ends."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        remove(spark, path)
    return len(made)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the process
        if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
            cleanup(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
