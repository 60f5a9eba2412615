"""Intermediate tables of the cohort part, in the folder that all nodes share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame

#: Tables written while a ``scratch`` function runs.
_OPEN: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


def staged(df: DataFrame) -> DataFrame:
    """Write a table under ``spark.checkpoint.dir`` and read it again: later plans start there, and no executor holds it alone.

    Only in local mode, where that setting is absent, a local folder is taken. Inside a ``scratch`` function the table goes
    when the function returns.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _OPEN.get() is not None:
        _OPEN.get().append(out)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; once is enough."""
    path = df.__dict__.pop("_staged_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def scratch(f: Callable) -> Callable:
    """For functions whose result holds no staged table: what they, and functions they call, stage is deleted when they return."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        own: list[DataFrame] = []
        outer = _OPEN.set(own)
        try:
            return f(*args, **kwargs)
        finally:
            _OPEN.reset(outer)
            for df in own:
                unstage(df)

    return run
