"""Session helpers: shared-folder tables that cut lineage, and table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, deleted at the end, but only for a local master: on a
    cluster a folder of one machine is shared with nobody, so this raises.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            got = jdir.get()
        else:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            got = "file://" + folder
            spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (survives executor loss)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
