"""What several operators share: the folder all executors see, table materialisation, running totals."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only where one process is the whole cluster (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables written by the operators that are running, one list for each.
_running: list[list[DataFrame]] = []


def whole(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator's result written as one table, and all other tables that it wrote deleted."""

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        _running.append([])
        result = None
        try:
            result = stored(operator(*args, **options), operator.__name__)
        finally:
            discard(*(t for t in _running.pop() if t is not result))
        if _running:
            _running[-1].append(result)
        return result

    return run


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here and a lost executor
    costs at most a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _running:
        _running[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """Adds ``_maybe``: false only where no row of wanted has this key; null keys are never among them. Rows that are false
    need no join, so their texts need no shuffle. What is broadcast is a bitmap of 2**bits bits, as at most 2**bits / 64
    rows of 64 bits, however many keys are wanted; as it fills, fewer rows are spared."""
    at, bit = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << bits)), "shiftleft(1L, cast(_at & 63 as int))"
    mask = wanted.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr(bit)).alias("_bits"))
    found = rows.withColumn("_at", at).join(F.broadcast(mask), F.shiftright("_at", 6) == F.col("_word"), "left")
    maybe = F.coalesce((F.col("_bits").bitwiseAND(F.expr(bit)) != 0) & F.col(key).isNotNull(), F.lit(False))
    return found.withColumn("_maybe", maybe).select(*rows.columns, "_maybe")


def modest_batches(spark: SparkSession) -> SparkSession:
    """Lets Spark hand texts to Python workers 4 MB at a time instead of 10,000 rows, however long they are (on both sides
    of the pipe a batch is held whole), and read 512 rows at a time, which keeps column buffers small."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


#: What this worker keeps for later tasks of the same operator, by name.
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    if name not in _held:
        _held[name] = make()
    return _held[name]


def only(keeps: str) -> None:
    """Lets go of all that is held under other names. A function of the module, as is ``held``, so that both mean the
    worker's own table and not a copy sent with a task."""
    if others := [name for name in _held if name != keeps]:
        for name in others:
            del _held[name]
        gc.collect()
        _given_back()


def _given_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow with modest batches. Spark keeps workers for later tasks, of other operators too: when a task begins, what
    is ``held`` under another name than ``keeps`` goes, and when it ends, freed memory is given back."""
    modest_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(keeps)
        yield from work(batches)
        _given_back()

    return df.mapInArrow(run, schema)


def in_pandas(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """in_arrow by pandas frames, whose columns must have the schema's types and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in work(b.to_pandas() for b in batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return in_arrow(df, run, schema)


def apart(docs: DataFrame, *named: str) -> DataFrame:
    """The columns under names that no operator uses, but for text and those named; ``back`` restores them."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("text", *named) else f"_own{i}") for i, c in enumerate(docs.columns)))


def back(kept: DataFrame, names: list[str], *named: str) -> DataFrame:
    return kept.select(*(F.col(c if c in ("text", *named) else f"_own{i}").alias(c) for i, c in enumerate(names)))


def width(spark: SparkSession) -> int:
    """Shuffle partitions, the session's own measure of how large the data are."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, by: list[str], order: list[Column], value: Column, n: int | None = None) -> DataFrame:
    """Adds ``run_rows`` and ``run_sum``: how many rows, and how much of ``value``, stand before each row among the rows
    with the same ``by`` columns, in the given order.

    No task holds a whole group: rows are dealt by range of (by, order), each range adds up its groups, and the few
    (range, group) totals, at most ranges + groups rows, give each range its offset. ``by`` columns must not be null
    and (by, order) should be unique for a defined result.
    """
    spark = df.sparkSession
    n = n or width(spark)
    dealt = df.withColumn("_v", value).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    total = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(
        *by,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(offset, [*by, "_range"])
        .withColumn("run_rows", F.col("_n0") + F.count(F.lit(1)).over(inside))
        .withColumn("run_sum", F.col("_s0") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_v", "_range", "_n0", "_s0")
    )
