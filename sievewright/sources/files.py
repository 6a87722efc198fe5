"""Source files in and out: a strict UTF-8 reader, a gated writer, and tables in the folder all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, root: str, pattern: str = "*.py") -> tuple[DataFrame, DataFrame]:
    """(files, refused): (path below root, text) of every matching file, byte for byte; those that are no UTF-8 apart."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.split(":", 1)[-1].rstrip("/") + "/")
    rows = raw.select(F.element_at(F.split("path", base, 2), -1).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return rows.where("text is not null"), rows.where("text is null").select("path")


class Unverified(RuntimeError):
    """Nothing was written, as some file did not pass verification."""


def write_verified(results: DataFrame, target: str) -> int:
    """Writes changed files of results (path, text, changed, failures) as a Parquet table (path, text), all or none; the
    number written. Any failure refuses the whole write."""
    held = kept(results, "results")
    if not held.where(F.size("failures") > 0).isEmpty():
        raise Unverified(f"{held.where(F.size('failures') > 0).count()} files are not verified")
    held.where("changed").select("path", "text").write.mode("errorifexists").parquet(target)
    return held.where("changed").count()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back, so that no later loss recomputes it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
