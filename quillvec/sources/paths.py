"""One meaning of a path for Spark and for the code that opens files itself."""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme Spark would read it by, so that executors open the same file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(hadoop).toString()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a qualified path."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "/", path)))
