"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; all of them can change in a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON objects that repeat a key keep the last value, as common parsers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_OWN: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that the operators need. Memory, parallelism and broadcast limits stay the cluster's own."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing, a local session gets a temporary folder of its own; a session on a cluster fails,
    as a machine-local folder would be lost with its machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir().rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one, deleted when its Python ends."""
    name = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/quillon-{name}"
    if name not in _OWN:
        _OWN.add(name)
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; a session that has ended leaves it to the owner of the folder."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        return


def staged(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``by`` are columns of few values to part it by.

    Cuts the lineage in a way that survives the loss of executors, and gives the optimiser true sizes, so that a join
    on the result is broadcast only where the written size allows it. The table is deleted when the session's Python ends.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
