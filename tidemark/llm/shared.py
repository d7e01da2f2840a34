"""What several operators need: recoverable intermediate tables, bounded samples, column hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII white space as the contracts define it: everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session in local mode that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tidemark-llm-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder; later reads survive a lost executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_ids(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct keys, the smallest by hash: a sample that does not depend on the layout.

    Reads the key column only.  Ties of the hash are cut by the key itself.
    """
    return (
        df.select(F.col(key).alias(key))
        .where(F.col(key).isNotNull())
        .distinct()
        .orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key))
        .limit(rows)
    )


def fields(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in kinds.items()])


def content(docs: DataFrame, column: str = "text") -> Column:
    """A 64-bit hash of a text column; null counts as empty."""
    return F.xxhash64(F.coalesce(docs[column].cast("string"), F.lit("")))
