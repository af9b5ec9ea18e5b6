"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(session: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own in a local session that names none, an error on a cluster."""
    named = session.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", session.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="docloom-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
