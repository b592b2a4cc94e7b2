"""Reading tables and the shared checkpoint folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where it is unset and Spark is local."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="attesta-"))
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Before Python runs on executors: sends them this package's code, once for each context, as a zip file in the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_attesta_shipped", False):
        return
    top, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    where = f"{checkpoint_dir(spark).rstrip('/')}/code-{uuid.uuid4().hex}/attesta.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(where)
    context._attesta_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that several readers don't compute it again and a lost executor costs no recomputation before it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
