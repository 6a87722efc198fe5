"""Mixing sources to target weights, by blocks of words.

Each source's documents, ordered by doc_id, are one run of words cut into blocks of ``block`` words. Targets: weights
share all words; a source stops at ``most`` times its own size and the excess is reshared by weight until none is above.
Every output shard of ``slots`` slots draws multinomial source counts, each from its own seed. Counts are summed over
the shards before, which numbers each source's draws; draws past a source's number of blocks to take go, in order, to
sources that drew too few, so every source takes its target up to half a block. Draw k of a source is block
``permutation(k mod blocks)`` of round k div blocks, by a keyed Feistel permutation of the source's block numbers, and
slots meet blocks in a join on (source, block). No block is taken more than ``most`` times.

Defined results: null text has size 0; sources order by code point, null last; documents of equal ids order by size and
text hash; a source without words has target 0. Only the totals of sources, a row a source, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import apart, back, in_arrow, in_pandas, modest_batches, running, stored, whole, width

BLOCK, SLOTS, MOST, WEIGHTS, SEED = 64, 2048, 3, (5, 2, 1), 20_26


def n_words() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Words each source should give: shares of all words, none above ``most`` times its size."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if total * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = total * weights[i] / whole
            break
        for i in over:
            target[i] = float(most * sizes[i])
            total -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1: four Feistel rounds on the next even number of bits, walked back into range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, out = k.astype(np.uint64), k >= n
    while True:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            a, b = b, a ^ (W.mix(b + np.uint64((key * 1_000_003 + r * 7919) % (1 << 63))) & mask)
        y = (a << np.uint64(half)) | b
        x = np.where(out, x, y)
        out = x < np.uint64(n)
        if out.all():
            return x.astype(np.int64)


def _key() -> Column:
    """Rows of one key are equal in id, text and source: any of them may stand for another."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")), F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit("")))


class Plan:
    """Per source, in order: size, target, blocks, blocks to take."""

    def __init__(self, names: list[str | None], sizes: list[int], weights: tuple[float, ...], block: int, most: float):
        by = sorted(range(len(names)), key=lambda i: (names[i] is None, [ord(c) for c in names[i] or ""]))
        self.names, self.sizes = [names[i] for i in by], [int(sizes[i]) for i in by]
        self.targets = targets(self.sizes, [weights[i % len(weights)] for i in range(len(by))], most)
        self.blocks, self.take = [], []
        for size, target in zip(self.sizes, self.targets, strict=True):
            n = -(-size // block)
            rounds = int(target // size) if size else 0
            rest = min(n, round((target - rounds * size) / block)) if size else 0
            self.blocks.append(n)
            self.take.append(min(rounds * n + rest, int(most) * n))


def planned(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, draws): rows has doc_id, key, size, src, ord, source_size, target and first (words of the source before);
    draws has shard, slot, src, block, round."""
    spark = modest_batches(docs.sparkSession)
    narrow = stored(docs.select("doc_id", "source", n_words().alias("size"), _key().alias("key")), "sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()
    plan = Plan([r.source for r in totals], [r.n for r in totals], weights, block, most)
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(plan.names, plan.sizes, plan.targets, strict=True))], "src int, name string, source_size long, target double")
    rows = narrow.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rows = running(rows, ["src"], [F.col("doc_id"), F.col("size"), F.col("key")], F.col("size"))
    rows = rows.withColumnRenamed("run_rows", "ord").withColumnRenamed("run_sum", "first")
    take, blocks = np.array(plan.take, np.int64), np.array(plan.blocks, np.int64)
    whole = int(take.sum())
    shards = -(-whole // slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = take / max(1, whole)
        for b in batches:
            for shard in b["id"]:
                n = np.random.default_rng([seed, int(shard)]).multinomial(min(slots, whole - shard * slots), share)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.full(len(some), shard), "src": some.astype(np.int32), "n": n[some], "at": (np.cumsum(n) - n)[some]})

    drawn = stored(in_pandas(spark.range(shards), draw, "shard long, src int, n long, at long"), "draws")
    got = np.zeros(len(take), np.int64)
    for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect():
        got[r.src] = r.n
    over, lack = np.maximum(0, got - take), np.maximum(0, take - got)
    over0, lack1 = np.cumsum(over) - over, np.cumsum(lack)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy()
            row = np.repeat(np.arange(len(b)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            src, k = b["src"].to_numpy()[row].astype(np.int64), b["run_sum"].to_numpy()[row] + step
            past = k >= take[src]
            o = over0[src[past]] + k[past] - take[src[past]]
            to = np.searchsorted(lack1, o, "right")
            src[past], k[past] = to, (got[to] + o - (lack1 - lack)[to])
            at = np.zeros(len(k), np.int64)
            for s in np.unique(src):
                own = src == s
                rounds = k[own] // blocks[s]
                for e in np.unique(rounds):
                    mine = np.flatnonzero(own)[rounds == e]
                    at[mine] = permuted(k[mine] % blocks[s], int(blocks[s]), seed + 131 * int(s) + 7 * int(e))
            yield pd.DataFrame({"shard": b["shard"].to_numpy()[row], "slot": b["at"].to_numpy()[row] + step, "src": src.astype(np.int32), "block": at, "round": (k // blocks[src]).astype(np.int32)})

    # a row here is many slots there, so rows are dealt by number, not by size
    draws = in_pandas(running(drawn, ["src"], [F.col("shard")], F.col("n")).repartition(width(spark), "shard", "src"), place, "shard long, slot long, src int, block long, round int")
    return rows, draws


def pieces(rows: DataFrame, draws: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every (document, block) overlap: src, ord, from (first word in the document), n words, times taken."""
    times = draws.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.col("first") + F.col("size")
    cut = rows.where("size > 0").select("src", "ord", "first", last.alias("last"), F.explode(F.sequence((F.col("first") / block).cast("long"), ((last - 1) / block).cast("long"))).alias("block"))
    begin, stop = F.greatest("first", F.col("block") * block), F.least("last", (F.col("block") + 1) * block)
    cut = cut.select("src", "ord", "block", (begin - F.col("first")).alias("from"), (stop - begin).alias("n"))
    return cut.join(times, ["src", "block"])


@whole
def digest(docs: DataFrame) -> DataFrame:
    rows, draws = planned(docs)
    taken = pieces(rows, draws).groupBy("src", "ord").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return rows.join(taken, ["src", "ord"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each time (1 to ``most``) any of a document's words are taken, holding the words
    taken so often: the whole text where all are, else its taken passages joined by line feeds."""
    whole_, docs = docs.columns, apart(docs, "doc_id", "source", "n_chars")
    names = docs.columns
    rows, draws = planned(docs)
    plan = pieces(rows, draws).groupBy("src", "ord").agg(F.array_sort(F.collect_list(F.struct("from", "n", "times"))).alias("_plan"))
    twin = lambda c: F.row_number().over(Window.partitionBy("_key").orderBy(c))
    plan = rows.join(plan, ["src", "ord"]).select(F.col("key").alias("_key"), "src", "ord", "size", "_plan").withColumn("_twin", twin("ord"))
    whole = docs.withColumn("_key", _key()).withColumn("_twin", twin(F.lit(0)))
    joined = whole.join(plan.select("_key", "_twin", "_plan", F.col("size").alias("_size")), ["_key", "_twin"]).select(*names, "_plan", "_size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            plans, sizes = b.column("_plan"), b.column("_size").to_pylist()
            for w in W.words(b.column(at), W.SPACED, keys=False):
                source, texts = [], []
                for r in range(w.lo, w.hi):
                    text = b.column(at)[r].as_py().encode()
                    own = plans[r].as_py()
                    low = w.text[r - w.lo]
                    start, end = (x[w.bounds[r - w.lo] : w.bounds[r - w.lo + 1]] - low for x in (w.start, w.end))
                    for time in range(1, max(p["times"] for p in own) + 1):
                        runs: list[list[int]] = []
                        for p in own:
                            if p["times"] >= time:
                                if runs and runs[-1][1] == p["from"]:
                                    runs[-1][1] += p["n"]
                                else:
                                    runs.append([p["from"], p["from"] + p["n"]])
                        if runs == [[0, sizes[r]]]:
                            texts.append(text.decode())
                        else:
                            texts.append("\n".join(text[start[i] : end[j - 1]].decode() for i, j in runs))
                        source.append(r)
                if not source:
                    continue
                out = b.take(pa.array(source))
                new = {"text": pa.array(texts, b.schema.field(at).type)}
                if "n_chars" in names:
                    new["n_chars"] = pa.array([len(t) for t in texts]).cast(b.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new.get(c, out.column(c)) for c in names], names=names)

    return back(in_arrow(joined, run, docs.schema), whole_, "doc_id", "source", "n_chars")


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
