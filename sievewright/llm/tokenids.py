"""Token-ID output in Simple-8b blocks.

Format. A shard is the run of documents of one range of doc_id; it is written as rows of a Parquet table, one row a
chunk of about ``chunk`` ids, in ascending doc_id order: shard, chunk, the shard's ids before the chunk, doc_id and
n_tokens of its documents, ``table``, ``offsets`` and ``payload``. ``table`` lists the chunk's ids by falling frequency
(at most ``ranks``); an id is coded as its rank. ``payload`` is little-endian 64-bit words: the top 4 bits select how
many codes of which width fill the low 60 bits (fixed values in WIDTH and COUNT). Selector 15 is the escape: one id
that the table lacks, written raw. Codes are packed greedily within blocks of ``BLOCK`` ids; ``offsets`` holds each
block's first word, so blocks decode independently, and all words of a chunk decode at once.

Defined results: null text is empty; each document ends with id ``end``; rows are ordered by doc_id (null first), then
text, so repeated ids and repeated rows have a defined order; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import held, in_arrow, stored, width
from .words import column

U = np.uint64
#: Fixed values of the format: codes in a word and bits of a code, by selector 0 to 14.
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE, BLOCK, RANKS, CHUNK = 15, 240, 65_535, 1 << 20
DENSE = 1 << 20
SHARDS = "shard int, chunk int, before long, doc_id array<long>, n_tokens array<long>, table binary, offsets binary, payload binary"


def pack(ids: np.ndarray, ranks: int = RANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, offsets, words) of a chunk's ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u4"), np.zeros(0, "<u4"), np.zeros(0, "<u8")
    if ids.max() < DENSE:  # a table by id instead of a sort
        at, seen = ids, np.bincount(ids)
        place = known = np.flatnonzero(seen)
        seen = seen[known]
    else:
        known, at, seen = np.unique(ids, return_inverse=True, return_counts=True)
        place = np.arange(len(known))
    by = np.lexsort((known, -seen))[:ranks]
    rank = np.full(int(place[-1]) + 1, -1, np.int32)
    rank[place[by]] = np.arange(len(by), dtype=np.int32)
    code = rank[at]
    raw = code < 0
    bits = np.zeros(n + 64, np.uint8)
    bits[:n] = np.where(raw, 61, np.maximum(1, np.ceil(np.log2(np.arange(len(by)) + 1)).astype(np.uint8))[code] if len(by) else 61)
    # most[s]: the selector's codes from here fit its width
    best = np.full(n, 13, np.uint8)
    wide = {1: bits}
    for c in sorted(set(COUNT.tolist())):
        if c > 1:
            half = max(x for x in wide if x <= c and 2 * x >= c)
            shift = c - half
            wide[c] = np.maximum(wide[half][: len(wide[half]) - shift], wide[half][shift:])
    left = BLOCK - np.arange(n) % BLOCK
    left = np.minimum(left, n - np.arange(n))
    for s in range(12, -1, -1):
        w = wide[COUNT[s]]
        w = np.concatenate([w, np.full(max(0, n - len(w)), 255, np.uint8)])[:n]
        best[(w <= WIDTH[s]) & (left >= COUNT[s])] = s
    best[raw] = ESCAPE
    step = np.append(COUNT, 1)[best]
    first = np.arange(0, n, BLOCK)
    pos, taken = first.copy(), []
    stop = np.minimum(first + BLOCK, n)
    while True:
        go = np.flatnonzero(pos < stop)
        if not len(go):
            break
        taken.append(pos[go])
        pos[go] += step[pos[go]]
    at = np.sort(np.concatenate(taken))
    words = best[at].astype(U) << U(60)
    value = np.append(np.where(raw, ids, code).astype(U), np.zeros(64, U))
    for s in range(16):
        mine = np.flatnonzero(best[at] == s)
        c, w = (1, 60) if s == ESCAPE else (int(COUNT[s]), int(WIDTH[s]))
        for j in range(c if len(mine) else 0):
            words[mine] |= value[at[mine] + j] << U(j * w)
    return known[by].astype("<u4"), np.searchsorted(at, first).astype("<u4"), words.astype("<u8")


def unpack(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of a chunk, or of the words of some of its blocks."""
    select = (words >> U(60)).astype(np.int64)
    count = np.append(COUNT, 1)[select]
    out = np.zeros(count.sum(), np.uint32)
    first = np.cumsum(count) - count
    for s in np.unique(select):
        mine = np.flatnonzero(select == s)
        if s == ESCAPE:
            out[first[mine]] = words[mine] & U((1 << 60) - 1)
            continue
        w = int(WIDTH[s])
        for j in range(int(COUNT[s])):
            out[first[mine] + j] = table[((words[mine] >> U(j * w)) & U((1 << w) - 1)).astype(np.int64)]
    return out


#: Fixed values of the vocabulary file's word splitting, for folded text of the characters in _PLAIN.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
_SPECIAL = re.compile(r"<\|\w+\|>")


class Coder(dict):
    """Ids, as little-endian bytes, of each run of bytes without ASCII white space.

    The vocabulary's normaliser and splitter never look across white space, so texts are encoded run by run and each
    run once a worker. Runs of common Latin characters go to the library's BPE model directly; all others, and any that
    holds a special token's string, through the library's whole pipeline.
    """

    def __init__(self, path: str, most: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.most, self.pieces = Tokenizer.from_file(path), most, {}
        self.model = self.whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.four = [i.to_bytes(4, "little") for i in range(1 + max(self.whole.get_vocab().values()))]

    def __missing__(self, run: bytes) -> bytes:
        if run.isalpha():  # ASCII letters are one piece
            piece = run.lower().decode()
            out = self.pieces.get(piece) or self.piece(piece)
        elif _PLAIN.fullmatch(text := run.decode("utf-8", "replace")) and not (b"<|" in run and _SPECIAL.search(text)):
            out = b"".join([self.pieces.get(p) or self.piece(p) for p in _PIECE.findall(text.lower())])
        else:
            out = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[run] = out
        return out

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join([self.byte[b] for b in piece.encode()])
        out = b"".join([self.four[t.id] for t in self.model.tokenize(spelled)])
        self.pieces[piece] = out
        return out

    def encode(self, text: bytes) -> bytes:
        if len(self) > self.most:
            self.clear()
        if len(self.pieces) > self.most:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.split()))


def coder(vocabulary: str) -> Coder:
    """vocabulary: a file of that name among the public tokenizers each executor has, or a path."""
    import public_tokenizers

    return held(f"coder-{vocabulary}", lambda: Coder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)))


def written(docs: DataFrame, vocabulary: str, end: int = 1, chunk: int = CHUNK, n: int | None = None) -> DataFrame:
    """Writes the shards of all documents into the shared folder; returns the table as read back."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), coder(vocabulary)
        state = {"chunk": 0, "before": 0}
        names, sizes, parts = [], [], []

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            table, offsets, payload = pack(ids)
            out = [shard, state["chunk"], state["before"], list(names), list(sizes), table.tobytes(), offsets.tobytes(), payload.tobytes()]
            state["chunk"] += 1
            state["before"] += len(ids)
            names.clear(), sizes.clear(), parts.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

        held = 0
        for b in batches:
            data, at = column(b.column(1))
            data = data.tobytes() if len(data) else b""
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                ids = own.encode(data[at[i] : at[i + 1]]) + tail
                names.append(doc_id), sizes.append(len(ids) // 4), parts.append(ids)
                held += len(ids) // 4
                if held >= chunk:
                    yield row()
                    held = 0
        if names:
            yield row()

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n or width(docs.sparkSession), "doc_id", F.xxhash64("text"))
    return stored(in_arrow(dealt.sortWithinPartitions("doc_id", "text"), run, SHARDS, f"coder-{vocabulary}"), "simple8b", compression="none")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards' payloads."""
    total = shards.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard: as many as partitions
    offset = total.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                first, names, sizes, table, payload = (b.column(c)[r].as_py() for c in ("first", "doc_id", "n_tokens", "table", "payload"))
                ids = unpack(np.frombuffer(table, "<u4"), np.frombuffer(payload, "<u8")).astype("<u4").tobytes()
                stop = np.cumsum(np.array(sizes, np.int64))
                crc = [zlib.crc32(ids[4 * (t - s) : 4 * t]) for s, t in zip(sizes, stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + stop - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.join(offset, "shard").select((F.col("first") + F.col("before")).alias("first"), "doc_id", "n_tokens", "table", "payload")
    return in_arrow(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    return read(written(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json"))
