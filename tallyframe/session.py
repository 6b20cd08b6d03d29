"""Size checks and lineage cuts shared by the operators."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dictionary or group table up to these sizes may be broadcast or ranked in one task.
SMALL_ROWS = 100_000
SMALL_BYTES = 32 * 1024 * 1024


# Session settings that pay off here: tables of many columns make generated methods that the JVM refuses to
# compile above 8000 bytes, and call-site capture slows down building large expressions.
RECOMMENDED_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """Measure whether the whole of `df` stays within both bounds (one aggregation job)."""
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(quoted(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            width = width + F.octet_length(F.to_json(F.struct(quoted(field.name))))
        else:
            width = width + 16
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def _shared_root(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallyframe-")  # one JVM: its own folder is shared; one per session
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_folder(spark) -> str:
    """A new subfolder name under the cluster's shared folder, for tables a job writes and reads again."""
    return f"{_shared_root(spark)}/tables-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Store `df` once in the cluster's shared checkpoint folder and return the stored copy."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_root(df.sparkSession))
    return df.checkpoint()


def quoted(name: str):
    """Column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")
