"""Source files as a stream: the mechanical pass over files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import syntax

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """A stream of (path, text), each file once; files that are no UTF-8 are passed over."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.split(":", 1)[-1].rstrip("/") + "/")
    rows = raw.select(F.element_at(F.split("path", base, 2), -1).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return rows.where("text is not null")


def settle_arriving(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Runs the mechanical pass over all files that have arrived since the last call, each exactly once, appends its rows
    to the table at target and ends. Stateless: what is kept between calls is the checkpoint's list of files seen."""
    rows = syntax.codemod(arriving(spark, root)).drop("found")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
