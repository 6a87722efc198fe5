"""Benchmark decontamination: a prefix-filtered containment join of item windows against whole documents.

A window is a run of ``size`` item words (a shorter item, but not an empty one, is one window). For containment of a
whole window one shingle of it is a sufficient prefix, so each window is indexed by its rarest word alone, rarity being
the word's count over all documents. A document word that equals a window's rarest word gives the only start at which
the window can stand (positional bound); starts before the text or too near its end go (length bound); the rest are
verified word by word. Documents are neither shuffled nor collected: one scan counts the benchmark's words, one looks for
windows. The benchmark is read in blocks of at most ``block_words`` words (or one longer item); each block is broadcast
and one mapping over the documents, and the blocks' mappings are chained into the second scan.

Defined results: null or empty texts have no words and no hits; an item without words has no window; items with one id
count once; a null item id is written as the empty string; further columns of the benchmark are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import apart, back, discard, in_arrow, stored

WINDOW, BLOCK_WORDS, BITS = 10, 400_000, 24
HITS = "n_words long, hits array<long>, items array<string>"


class Block:
    """Windows of some items, indexed by rarest word."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        found: dict[bytes, set[str]] = {}
        for name, keys in items:
            n = min(size, len(keys))
            for i in range(len(keys) - n + 1 if n else 0):
                found.setdefault(keys[i : i + n].tobytes(), set()).add(name)
        self.windows = [np.frombuffer(x, np.uint64) for x in found]
        self.items = [sorted(x) for x in found.values()]
        self.vocabulary = np.unique(np.concatenate([*self.windows, np.zeros(0, np.uint64)]))
        self.length = np.array([len(x) for x in self.windows], np.int64)
        self.words = np.zeros((len(self.windows), size), np.uint64)
        for i, x in enumerate(self.windows):
            self.words[i, : len(x)] = x

    def order(self, counts: np.ndarray) -> None:
        """counts: of each vocabulary word over all documents."""
        rarest, offset = [], []
        for x in self.windows:
            at = np.searchsorted(self.vocabulary, x)
            offset.append(int(np.lexsort((x, counts[at]))[0]))
            rarest.append(x[offset[-1]])
        by = np.argsort(np.array(rarest, np.uint64), kind="stable")
        self.token, first = np.unique(np.array(rarest, np.uint64)[by], return_index=True)
        self.first = np.append(first, len(by))
        self.window, self.offset = by, np.array(offset, np.int64)
        self.windows = None

    def hits(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.token) or not len(w.key):
            return none, none
        at = np.minimum(np.searchsorted(self.token, w.key), len(self.token) - 1)
        pos = np.flatnonzero(self.token[at] == w.key)
        n = np.diff(self.first)[at[pos]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = self.window[np.repeat(self.first[at[pos]], n) + step]
        pos = np.repeat(pos, n)
        row = np.searchsorted(w.bounds, pos, "right") - 1
        start = pos - self.offset[window]
        fits = (start >= w.bounds[row]) & (start + self.length[window] <= w.bounds[row + 1])
        start, window = start[fits], window[fits]
        for j in range(self.words.shape[1]):
            short = self.length[window] <= j
            same = short | (w.key[np.where(short, 0, start + j)] == self.words[window, j])
            start, window = start[same], window[same]
        return start, window


def blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[Block]:
    own, n = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text")).toLocalIterator()
    for name, text in rows:
        keys = next(W.words(pa.array([text], pa.large_string()), W.ALNUM)).key
        if own and n + len(keys) > most:
            yield Block(own, size)
            own, n = [], 0
        own.append((name, keys))
        n += len(keys)
    if own:
        yield Block(own, size)


def _vocabulary(benchmark: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, 2**24 bits, of all words of the benchmark."""
    out = np.zeros(1 << BITS - 6, np.uint64)
    for (text,) in benchmark.select("text").toLocalIterator():
        at = next(W.words(pa.array([text], pa.large_string()), W.ALNUM)).key >> np.uint64(64 - BITS)
        np.bitwise_or.at(out, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return out


def counted(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(word, n), stored: how often words of the benchmark, and some that share a bit with one, occur in all documents.
    One scan, whatever the size of the benchmark; a task adds up its words before it sends them."""
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, many = shared.value, [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for b in batches:
            for w in W.words(b.column(0), W.ALNUM):
                at = w.key >> np.uint64(64 - BITS)
                held.append(np.unique(w.key[own[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0], return_counts=True))
                many += len(held[-1][0])
                if many > 1 << 20:
                    held = [summed()]
                    many = 0
        if held:
            keys, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["word", "n"])

    return stored(in_arrow(docs.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def _counts(table: DataFrame, block: Block) -> np.ndarray:
    """Of the table's words, the counts of the block's vocabulary."""
    own = block.vocabulary.astype(np.int64)
    out = np.zeros(len(own), np.int64)
    if len(own):
        wanted = table.sparkSession.createDataFrame(pd.DataFrame({"word": own, "at": np.arange(len(own))}))
        for at, n in table.join(wanted, "word").select("at", "n").collect():  # at most the block's words
            out[at] = n
    return out


def _match(docs: DataFrame, block: Block) -> DataFrame:
    """Adds the block's hit words and items to the columns hits and items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            hits, items = b.column("hits").to_pylist(), b.column("items").to_pylist()
            count = np.zeros(b.num_rows, np.int64)
            for w in W.words(b.column("text"), W.ALNUM):
                count[w.lo : w.hi] = w.counts()
                start, window = own.hits(w)
                rows = np.searchsorted(w.bounds, start, "right") - 1
                for r in np.unique(rows):
                    mine = rows == r
                    first = start[mine] - w.bounds[r]
                    n = own.length[window[mine]]
                    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hits[w.lo + r] = np.union1d(hits[w.lo + r], at).astype(np.int64).tolist()
                    found = {x for i in np.unique(window[mine]) for x in own.items[i]}
                    items[w.lo + r] = sorted(found.union(items[w.lo + r]))
            new = {"n_words": pa.array(count), "hits": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names=names)

    return in_arrow(docs, run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document row with n_words, hits (sorted numbers of the words inside occurrences) and items (sorted ids), which
    take the place of columns of these names."""
    out = docs.drop("n_words", "hits", "items").select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<long>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    table, any_block = counted(docs, benchmark), False
    for block in blocks(benchmark, size, block_words):
        block.order(_counts(table, block))
        out, any_block = _match(out, block), True
    discard(table)
    return out if any_block else _match(out, _empty(size))


def _empty(size: int) -> Block:
    block = Block([], size)
    block.order(np.zeros(0, np.int64))
    return block


def clean(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The documents, with their own columns, in which no window of the benchmark occurs."""
    return back(contamination(apart(docs), benchmark, **options).where(F.size("hits") == 0), docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return digest(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)
), hit AS (SELECT doc_id, item, dw.n AS n, p FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
