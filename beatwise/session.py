"""Session helper: cutting lineage in iterative jobs."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions without the setting, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster for cut lineage (spark.checkpoint.dir).

    Only a local session without that setting, as in tests, gets a folder of its own, which goes when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    name = spark.conf.get("spark.app.id", "local")
    if name not in _own:
        _own[name] = tempfile.mkdtemp(prefix="beatwise-")
        atexit.register(shutil.rmtree, _own[name], ignore_errors=True)
    return _own[name]


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the written table survives the loss of
    executors, and the scan that follows knows its size. A round of an iterative operator
    costs one pass instead of the two an eager ``checkpoint()`` takes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

