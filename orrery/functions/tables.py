"""Tables written in between, which cut lineage: a lost executor costs no more than the tasks that it ran."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all run in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own:
        _own["path"] = tempfile.mkdtemp(prefix="orrery-")
    return _own["path"]


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back; ``discard`` deletes it."""
    path = f"{shared_folder(df.sparkSession)}/orrery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``keep`` returned, once all that reads them has itself been written.

    What was not written by ``keep`` (or is None) is left alone; what is derived from such a table is not it.
    """
    for t in tables:
        path = vars(t).get("kept_at") if t is not None else None
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
