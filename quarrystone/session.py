"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set where the caller starts the session; a session that exists keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, narrowed to the columns that are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local session without that setting gets a temporary one,
    deleted when Python ends; on a cluster a folder of one machine would lose rows, so there it is an error."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(sc.applicationId) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: stages are written there")
        d = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="quarrystone-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


def cut(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back: later plans start at the files, so a lost executor costs
    no recomputation of what led here, and two readers share one computation."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "quarrystone", f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete all written stages of this package: for the end of a run, when no frame that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), "quarrystone"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
