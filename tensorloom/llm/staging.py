"""Tables written once and read again, in the folder that all machines share.

A staged table cuts lineage: whatever is lost later is read again from the
file, never computed again, so values made once (row numbers, for example) stay.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, SparkSession] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, but only if all of Spark runs in this machine's one JVM."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tensorloom-")
        sc.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/stage-{sc.applicationId}"
    _FOLDERS[folder] = spark
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> DataFrame:
    """(row STRUCT, file LONG, line LONG): where each row lies in its Parquet file tells even repeated rows apart."""

    def place(scan: DataFrame) -> DataFrame:
        meta = scan.metadataColumn("_metadata")
        return scan.select(F.struct("*").alias("row"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("line"))

    try:
        return place(docs)
    except AnalysisException:  # not a scan of files: made one
        return place(stage(docs, "placed"))


#: Rows and bytes of an Arrow batch: whole texts go to Python a few megabytes at a time, however long they are.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable in Python workers of any cluster, and keeps what they get at once small."""
    sc = spark.sparkContext
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:  # what the user has set stays
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tensorloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "tensorloom_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    full = os.path.join(at, x)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(target)


@atexit.register
def _clean() -> None:
    for folder, spark in _FOLDERS.items():
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
