"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_scopes = threading.local()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where neither that setting nor a folder set by the caller exists is a folder of our own used, and only
    on one machine; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        folder = _own_folders.get(application) or _own_folders.setdefault(application, tempfile.mkdtemp(prefix="quadrille-checkpoint-"))
    return f"{folder}/quadrille-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    That cuts the lineage, survives lost executors, and gives later joins true sizes.  Tables that a lazy
    result reads stay until the folder is emptied; others go by ``discard`` or with ``scratch_scope``."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.checkpoint_path = path
    for tables in getattr(_scopes, "open", [])[-1:]:
        tables.append(out)
    return out


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that ``stored`` writes inside (on this thread) go at the end; what is made from them is written by then."""
    stack = _scopes.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        discard(*stack.pop())


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that ``stored`` wrote, once all that is made from them is written too."""
    for df in tables:
        path = getattr(df, "checkpoint_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
