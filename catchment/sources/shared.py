"""The folder that driver and executors share, and tables written once in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="catchment-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written once as a table in the shared folder: it is computed once and a lost executor costs no lineage."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `staged` wrote and that nothing reads any more, neither a DataFrame that is still to be computed nor one whose lost parts would be computed again."""
    for df in tables:
        own = urlparse(shared_dir(df.sparkSession)).path.rstrip("/") + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if urlparse(folder).path.startswith(own):
                _delete(df.sparkSession, folder)
