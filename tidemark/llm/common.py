"""What the corpus operators share: tables, the shared scratch folder, words and hashes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, where the session does not say: rows hold whole texts or packed blocks, so rows alone are no bound.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when only the driver's sys.path has it (on a cluster: --py-files), and
    bounds what goes to them at once."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). Where none is set, a temporary folder of a
    local session; on a cluster this raises, as executors would write to disks of their own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table between jobs. All of a session's are in one folder, which may go when its results are read."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha256_utf8(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
