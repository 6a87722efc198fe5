"""Language-model scoring by prediction by partial matching over bytes, with a word unigram base beside it.

The byte model. The runs of ``order`` + 1 bytes of all training texts (pads before a text, an end symbol after it) are
the leaves of a context trie; no run and no context is left out, so the trie grows with the corpus and lives in hash
buckets, never in one place. In a context a symbol of count c has the share (2c - 1) / 2t, the escape d / 2t (t symbols
seen, d distinct); an escape goes to the context one byte shorter, where all symbols of the longer one are excluded; the
last resort is even over what is left of 257 symbols. As a shorter context has all symbols of the longer, what exclusion
takes from it is one sum and one number a context.

Both models are asked alike. Documents are dealt to hash chunks; a chunk sends its distinct word keys and byte runs,
each with its count in training documents, to hash buckets; a bucket adds up and answers in the order asked. Runs go by
their last three context bytes, or, where a context holds more than 1 / share of all symbols, by as many bytes more as it
takes to fall below that; so all longer contexts that a bucket needs are its own, and none holds a frequent context
whole. What stands above comes by broadcast: the counts of three-byte runs, at most 2**24 whatever the corpus holds, and
those of the symbols in frequent contexts, at most 257 x share for each length.

Defined results: null text is empty (one token, the end); rows with equal ids are scored one by one; a null id is hashed
as the empty string; without training documents all counts are 0 and every byte costs log10 257.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .langid import fold
from .shared import in_arrow, stored, whole, width

U = np.uint64
#: Context bytes of the model, 3 to 7.
ORDER = 6
#: Bytes of the runs whose counts every bucket gets, and into how many parts their sums are dealt.
LOW, PARTS = 3, 16
#: A context of more than 1 / share of all symbols is split by its longer ones. The share is the number of shuffle
#: partitions, the session's measure of how large the data are, between these bounds.
SHARE = (256, 1 << 16)
#: Fixed values, bytes that UTF-8 never holds: what stands before a text, and its end.
PAD, END = 0xFE, 0xFF


def symbols(w: W.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with pads before and an end after each; which of them are coded."""
    n = len(w.text) - 1
    out = np.full(len(w.data) + n * (order + 1), PAD, np.uint8)
    shift = np.arange(1, n + 1) * order + np.arange(n)
    at, ends = np.ones(len(out), bool), w.text[1:] + shift
    at[(np.repeat(w.text[:-1] + shift, order) - np.tile(np.arange(1, order + 1), n))] = False
    at[ends] = False
    out[at] = w.data
    out[ends], at[ends] = END, True
    return out, at


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by], first) if len(first) else n


def runs(w: W.Words, order: int) -> np.ndarray:
    """The run that ends in each coded byte: itself in the lowest 8 bits, the byte before it in the next, and so on."""
    text, at = symbols(w, order)
    code, size = text.astype(U), 1
    while size <= order:
        more = min(size, order + 1 - size)
        longer = code.copy()
        longer[size:] |= _tail(code[:-size], more) << U(8 * size)
        code, size = longer, size + more
    return code[at]


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.append(first, len(code)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    keys = np.concatenate(parts)
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Sums:
    """Keys and their summed counts, merged as they come so that only distinct keys stay."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.held.append((keys, n))
        self.size += len(keys)
        if self.size > 3 * len(self.held[0][0]) // 2 + (1 << 18):
            self.held = [self.done()]
            self.size = len(self.held[0][0])

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return _sums(np.concatenate([k for k, _ in self.held]), np.concatenate([n for _, n in self.held]))


class Level(NamedTuple):
    """Contexts of one length: sorted runs (context and symbol) and their counts; contexts, their symbols seen and
    distinct, and the count of the same symbols in the context one byte shorter."""

    run: np.ndarray
    n: np.ndarray
    context: np.ndarray
    seen: np.ndarray
    distinct: np.ndarray
    shorter: np.ndarray


def _tail(keys: np.ndarray, n_bytes: int) -> np.ndarray:
    return keys & U((1 << 8 * n_bytes) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Among:
    """Which keys are in a sorted table; most are told by their last three bytes."""

    def __init__(self, table: np.ndarray):
        self.table, self.ends = table, np.zeros(1 << 24, bool)
        self.ends[_tail(table, 3).astype(np.int64)] = True
        self.short = not len(table) or int(table[-1]) < 1 << 24

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self.ends[_tail(keys, 3).astype(np.int64)]
        if not self.short:
            out[out] = _find(self.table, keys[out])[1]
        return out


class Below(NamedTuple):
    """What every bucket gets: the levels of contexts of 0 to 2 bytes; by context length from 3 on, the frequent contexts
    and their runs with counts."""

    low: list[Level]
    frequent: dict[int, np.ndarray]
    runs: dict[int, tuple[np.ndarray, np.ndarray]]

    def place(self, keys: np.ndarray, order: int) -> np.ndarray:
        """What runs are dealt by: the shortest context, of three bytes at least, that is not frequent."""
        context = keys >> U(8)
        out, open_ = W.mix(_tail(context, LOW)), np.ones(len(keys), bool)
        for j, table in sorted(self.frequent.items()):
            open_[open_] = _find(table, _tail(context[open_], j))[1]
            out[open_] = W.mix(_tail(context[open_], min(j + 1, order)) + U(j))
        return out


def levels(keys: np.ndarray, n: np.ndarray, order: int, below: Below) -> list[Level]:
    """All levels up to ``order``, from runs of order + 1 bytes and their counts (0: only asked for), and what is known of
    frequent contexts."""
    found, asked = list(below.low), keys
    keys, n = keys[n > 0], n[n > 0]
    for j in range(len(found), order + 1):
        run, c = _sums(_tail(keys, j + 1), n)
        if j in below.frequent:
            own = ~_find(below.frequent[j], run >> U(8))[1]
            more, count = below.runs[j]
            here = _find(np.unique(_tail(asked >> U(8), j)), more >> U(8))[1]
            run, c = _sums(np.concatenate([run[own], more[here]]), np.concatenate([c[own], count[here]]))
        context = run >> U(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(run) else np.zeros(0, np.int64)
        shorter = np.zeros(len(run), np.int64)
        if j and len(run):
            shorter = found[-1].n[_find(found[-1].run, _tail(run, j))[0]]
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)  # noqa: B023, E731
        found.append(Level(run, c, context[first], add(c), np.diff(np.append(first, len(run))), add(shorter)))
    return found


def costs(keys: np.ndarray, model: list[Level]) -> np.ndarray:
    """log10 probability of the last symbol of each run after the others, from the longest context downwards."""
    cost, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    less, fewer = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for j in range(len(model) - 1, -1, -1):
        level, run = model[j], _tail(keys, j + 1)
        at, known = _find(level.context, run >> U(8))
        if not known.any():
            continue
        seen = np.where(known, level.seen[at] - less, 0)
        distinct = np.where(known, level.distinct[at] - fewer, 0)
        i, has = _find(level.run, run)
        use = open_ & (seen > 0)
        hit, miss = use & has, use & ~has
        cost[hit] += np.log10((2 * level.n[i[hit]] - 1) / (2 * seen[hit]))
        cost[miss] += np.log10(distinct[miss] / (2 * seen[miss]))
        open_ &= ~hit
        less, fewer = np.where(known, level.shorter[at], 0), np.where(known, level.distinct[at], 0)
    symbols_seen = int(model[0].distinct[0]) if len(model[0].distinct) else 0
    cost[open_] -= np.log10(257 - symbols_seen)
    return cost


def tallies(docs: DataFrame, size: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of so many bytes in all rows and their counts: of three bytes at most 2**24; of more, those that begin or end
    with a run in ``near``, at most 2 x 257 for each of them."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, among = Sums(), None if near is None else Among(near)
        for b in batches:
            for w in W.texts(b.column(0)):
                code = runs(w, size - 1)
                code = code if near is None else code[among(code >> U(8)) | among(_tail(code, size - 1))]
                held.add(*_counted(code))
        keys, n = held.done()
        part = (W.mix(keys) % U(PARTS)).astype(np.int64)
        for i in np.unique(part).tolist():
            own = part == i
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([keys[own].tobytes()], pa.binary()), pa.array([n[own].astype("<i8").tobytes()], pa.binary())], names=["part", "keys", "n"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sums()
        for b in batches:
            for k, n in zip(b.column("keys").to_pylist(), b.column("n").to_pylist(), strict=True):
                held.add(np.frombuffer(k, U), np.frombuffer(n, np.int64))
        keys, n = held.done()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["keys", "n"])

    rows = in_arrow(in_arrow(docs.select("text"), collect, "part int, keys binary, n binary").repartition(PARTS, "part"), reduce, "keys binary, n binary").collect()
    total = Sums()
    for k, n in rows:
        total.add(np.frombuffer(k, U), np.frombuffer(n, np.int64))
    return total.done()


def known_below(docs: DataFrame, order: int, share: int) -> Below:
    """A scan for the levels of up to two bytes, and one for each length at which some contexts are frequent."""
    keys, n = tallies(docs, LOW)
    out, whole_ = Below(levels(keys, n, LOW - 1, Below([], {}, {})), {}, {}), int(n.sum())
    for j in range(LOW, order):
        table = keys[n * share > whole_]
        table = table if j == LOW else table[_find(out.frequent[j - 1], _tail(table, j - 1))[1]]
        if not len(table):
            break
        keys, n = tallies(docs, j + 1, table)
        own = _find(table, keys >> U(8))[1]
        out.frequent[j], out.runs[j] = table, (keys[own], n[own])
    return out


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their steps."""
    steps = np.diff(keys, prepend=U(0)).astype("<u8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U)


@whole
def scored(docs: DataFrame, train: str, order: int = ORDER, share: int | None = None) -> DataFrame:
    """doc_id, the boolean column ``train``, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    k, own = width(spark), docs.select("doc_id", F.col(train).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    below = spark.sparkContext.broadcast(known_below(own.where("train"), order, min(max(k, SHARE[0]), SHARE[1]) if share is None else share))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * k)).cast("int"))

    def buckets(keys: np.ndarray, of_runs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Order of sorted keys by bucket, and where each bucket begins in it."""
        bucket = ((below.value.place(keys, order) if of_runs else keys) % U(k)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        return by, np.searchsorted(bucket[by], np.arange(k + 1))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        """Parts of each value of the first column, by which the rows are sorted: one chunk or bucket is held at a time."""
        last, parts = None, []
        for b in batches:
            for x in pc.unique(b.column(0)).to_pylist():
                if x != last and parts:
                    yield last, parts
                    parts = []
                last = x
                parts.append(b.filter(pc.equal(b.column(0), x)))
        if parts:
            yield last, parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, parts in grouped(batches):
            of_words, of_runs = Sums(), Sums()
            for part in parts:
                trains = part.column("train").to_numpy(zero_copy_only=False)
                for w in W.words(part.column("text"), W.SPACED):
                    own_ = trains[w.lo : w.hi]
                    keys, at = np.unique(w.key, return_inverse=True)
                    of_words.add(keys, np.bincount(at, weights=np.repeat(own_, w.counts()), minlength=len(keys)).astype(np.int64))
                    code, trained = runs(w, order), np.repeat(own_, np.diff(w.text) + 1)
                    of_runs.add(*_counted(code[trained]))
                    asked_ = _counted(code[~trained])[0]
                    of_runs.add(asked_, np.zeros(len(asked_), np.int64))
            for runs_, sums in enumerate((of_words, of_runs)):
                keys, n = sums.done()
                by, cut = buckets(keys, bool(runs_))
                out = []
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    mine = by[cut[i] : cut[i + 1]]
                    out.append((k * runs_ + i, c, _packed(keys[mine]) if runs_ else keys[mine].tobytes(), zlib.compress(n[mine].astype("<i8").tobytes(), 1)))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "keys", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, parts in grouped(batches):
            asked = [row for b in parts for row in zip(*(b.column(c).to_pylist() for c in range(1, 4)), strict=True)]
            keys = [_unpacked(x) if i >= k else np.frombuffer(x, U) for _, x, _ in asked]
            total, n = _sums(np.concatenate(keys), np.concatenate([np.frombuffer(zlib.decompress(x), "<i8") for *_, x in asked]))
            tokens, distinct = (0, 0) if i >= k else (int(n.sum()), int((n > 0).sum()))
            told = costs(total, levels(total, n, order, below.value)).astype("<f4") if i >= k else n.astype("<i8")
            out = [zlib.compress(told[np.searchsorted(total, x)].tobytes(), 1) for x in keys]
            first = np.arange(len(out)) == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(out), i), pa.int32()), pa.array([c for c, *_ in asked], pa.int32()), pa.array(out, pa.binary()), pa.array(first * tokens), pa.array(first * distinct)],
                names=["bucket", "chunk", "counts", "tokens", "distinct"],
            )

    asked = in_arrow(own.select("chunk", "train", "text").repartitionById(k, F.col("chunk") % k).sortWithinPartitions("chunk"), ask, "bucket int, chunk int, keys binary, n binary")
    answers = stored(in_arrow(asked.repartitionById(k, F.col("bucket") % k).sortWithinPartitions("bucket"), answer, "bucket int, chunk int, counts binary, tokens long, distinct long"), "counts", compression="none")
    n, v = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = own.where("train").count()
    n, v = n + ends, v + (ends > 0)

    def told(keys: np.ndarray, said: dict[int, bytes], of_runs: bool) -> np.ndarray:
        """What the buckets answered, in the order of the keys."""
        by, _ = buckets(keys, of_runs)
        out = np.zeros(len(keys), "<f4" if of_runs else "<i8")
        found = [np.frombuffer(zlib.decompress(x), out.dtype) for i, x in sorted(said.items()) if (i >= k) == of_runs]
        if found:
            out[by] = np.concatenate(found)
        return out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, both in grouped(batches):
            held, said = [], {}
            for part in both:
                answered = part.filter(pc.is_valid(part.column("counts")))
                said.update(zip(answered.column("bucket").to_pylist(), answered.column("counts").to_pylist(), strict=True))
                part = part.filter(pc.is_valid(part.column("text")))
                for w in W.words(part.column("text"), W.SPACED):
                    rows = part.slice(w.lo, w.hi - w.lo).select(["doc_id", "train"])
                    own_words, word = np.unique(w.key, return_inverse=True)
                    own_runs, run = np.unique(runs(w, order), return_inverse=True)
                    held.append((rows, w.counts(), w.text[:-1] + np.arange(w.hi - w.lo), own_words, word.astype(np.int32), own_runs, run.astype(np.int32)))
            if not held:
                continue
            keys, codes = _distinct([x[3] for x in held]), _distinct([x[5] for x in held])
            known, cost = told(keys, said, False), told(codes, said, True)
            for rows, size, begins, own_words, word, own_runs, run in held:
                seen = known[np.searchsorted(keys, own_words)][word]
                first = np.cumsum(size) - size
                sums = np.concatenate([[0], np.cumsum(seen > 0)])
                n_known = sums[first + size] - sums[first] + (ends > 0)
                log = np.append(np.log10(seen + 1.0), 0.0)
                base = np.where(size > 0, np.add.reduceat(log, first), 0.0) + np.log10(ends + 1.0) - (size + 1) * np.log10(n + v + 1.0)
                score = np.add.reduceat(cost[np.searchsorted(codes, own_runs)].astype(np.float64)[run], begins)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("train"), pa.array(size + 1), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(size), n)), pa.array(base), pa.array(score)],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    kind = dict(own.dtypes)["doc_id"]
    texts = own.select("chunk", "doc_id", "train", "text", nothing("int", "bucket"), nothing("binary", "counts"))
    said = answers.select("chunk", nothing(kind, "doc_id"), nothing("boolean", "train"), nothing("string", "text"), "bucket", "counts")
    return in_arrow(texts.unionAll(said).repartitionById(k, F.col("chunk") % k).sortWithinPartitions("chunk"), finish, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("train", fold("doc_id", 7) != 2)
    out = scored(docs, "train")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
