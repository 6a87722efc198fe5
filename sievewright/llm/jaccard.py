"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 52-bit keys. Documents of equal sets form one class. Two sets of sizes
a and b that reach the threshold differ in at most d(a, b) elements. Per band of sizes, elements fall by hash into
d + 1 + spare parts; a part's sketch has 2**52 / parts bits, each element flips one, and the sketch is held as the XOR of
a Zobrist word of every set bit. The parts' Hamming distances add up to at most the symmetric difference, so by the
pigeonhole principle at least 1 + spare parts agree wherever a pair links. So each class may leave out ``spare`` parts, if
all choose by one order: it leaves out those whose (band, part, sketch) most classes have. Of the parts a linked pair
agrees on, the rarest has ``spare`` others before it, and both classes keep it. Empty parts count as the most frequent.
Classes meet on the parts they keep; passages that many documents share tell nothing and go first. What meets, directly or
in a chain, is a cluster; no link leaves a cluster. A cluster of more than ``block`` classes is first cut finer: its members
meet again, only among themselves, over narrower bands and with more parts to leave out.

Clusters are settled exactly, in blocks of at most ``block`` classes: inside a block, sketches of 2048 bits (their Hamming
distance bounds the symmetric difference from below) and sizes pass pairs on to exact verification of the sets, skipping
pairs already connected. A cluster of several blocks is dealt into blocks ``deals`` times by different hashes; then
classes outside a cluster's largest component meet all its blocks. So copies and dense groups cost no more than their
rows; only classes that meet a large cluster without joining its largest component are compared with all of it.

A part that many classes of one flush of a task have is dealt by class name, not by part, so that no task holds all its
classes; their number is then added up by a plain aggregation.

Defined results: null and empty texts have n_shingles 0 and link with nothing; a null doc_id links with nothing and has
component null; rows of one id with different texts are documents of their own, that share an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .shared import apart, back, discard, in_arrow, maybe_among, stored, width

U = np.uint64
N, PERCENT, BLOCK, DEALS = 4, 85, 1000, 2
#: (ratio of a band's sizes, parts to leave out as a share of those that may differ): at first, and for large clusters.
COARSE, FINE = (1.35, 0.3), (1.12, 1.0)
SKETCH = 2048
#: Bits of a packed meeting key that hold the band and how many parts its class may leave out (a lower number is safe).
BAND_BITS, LEFT_BITS = 8, 12
FLUSH, HOT = 1 << 18, 64


def bands(most: int, percent: int, ratio: float, share: float) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size of the smaller set, parts, spare) up to sets of ``most`` elements."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * ratio))
        differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        spare = math.ceil(share * (differ + 1)) if differ else 0
        out.append((low, high, differ + 1 + spare, spare))
        low = high + 1
    return out


def sets(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, keys, name) of each row's distinct shingles, sorted; name is a 63-bit key of the whole set."""
    rows = w.hi - w.lo
    row, key = W.shingles(w, n)
    if rows <= 4096:
        both = np.sort((row.astype(U) << U(52)) | (key >> U(12)))
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        row, key = (both >> U(52)).astype(np.int64), both & U((1 << 52) - 1)
    else:
        key = key >> U(12)
        by = np.lexsort((key, row))
        row, key = row[by], key[by]
        new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(row) else np.zeros(0, bool)
        row, key = row[new], key[new]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(W.mix(key + U(0x51ED)))])
    name = W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U)) >> U(1)
    return bounds, key, name


def part_keys(size: np.ndarray, bounds: np.ndarray, key: np.ndarray, name: np.ndarray, table: list[tuple[int, int, int, int]], percent: int, salt: np.ndarray) -> np.ndarray:
    """Rows (meeting key, band and parts to leave out, set name) of the given sets in all their bands; only sets of one
    salt meet. Empty parts are left out first, in order; those beyond ``spare`` have keys like any other."""
    out = [np.zeros((0, 3), U)]
    for i, (low, high, parts, spare) in enumerate(table):
        mine = np.flatnonzero((size >= low) & (size <= high * 100 // percent))
        if not len(mine):
            continue
        n = size[mine]
        row = np.repeat(np.arange(len(mine)), n)
        k = key[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[mine], n)]
        cell = row * parts + ((k >> U(12)) * U(parts) >> U(40)).astype(np.int64)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sketch, cell = np.bitwise_xor.reduceat(W.mix(k ^ U(0xA5A5)), first), cell[first]
        empty = parts - np.bincount(cell // parts, minlength=len(mine))
        for r in np.flatnonzero(empty > spare):
            more = np.setdiff1d(np.arange(parts), cell[cell // parts == r] % parts)[spare:]
            cell, sketch = np.append(cell, r * parts + more), np.append(sketch, np.zeros(len(more), U))
        row = cell // parts
        tag = W.mix((cell % parts).astype(U) * U(1_000_003) + U(i))
        left = np.minimum(np.maximum(spare - empty, 0), (1 << LEFT_BITS) - 1)[row].astype(U)
        out.append(np.stack([W.mix((sketch + tag) ^ salt[mine[row]]), U(i << LEFT_BITS) | left, name[mine[row]]], 1))
    return np.concatenate(out)


def _dealt(rows: np.ndarray, k: int) -> pa.RecordBatch:
    """(bucket, pairs, hot): part_keys packed by bucket, at 16 bytes each. Where HOT or more rows share a key, they go by
    name, at 24 bytes each, and one of them stands for all in the key's own bucket."""
    low = U((1 << BAND_BITS + LEFT_BITS) - 1)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    head = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
    many = np.diff(np.append(head, len(rows)))
    hot = np.repeat(many >= HOT, many)
    plain = ~hot
    plain[head] = True
    pairs = np.stack([rows[plain, 0] & ~low | rows[plain, 1], rows[plain, 2]], 1)
    columns = []
    for bucket, part in ((rows[plain, 0] % U(k), pairs), (W.mix(rows[hot, 2]) % U(k), rows[hot])):
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(k + 1))
        columns.append([part[by[cut[i] : cut[i + 1]]].tobytes() for i in range(k)])
    some = [i for i in range(k) if columns[0][i] or columns[1][i]]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([c[i] for i in some], pa.binary()) for c in columns)], names=["bucket", "pairs", "hot"])


def _met(bucket: int, pairs: np.ndarray, hot: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(key, name, band, left, n): keys that at least two sets of a bucket have, and all hot ones, those with n = 0."""

    def told(at: np.ndarray, bucket: np.ndarray, name: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        by = np.lexsort((name, at))
        at, bucket, name = at[by], bucket[by], name[by]
        own = at >> U(LEFT_BITS)
        new = np.append(True, (own[1:] != own[:-1]) | (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1]))
        at, bucket, name, own = at[new], bucket[new], name[new], own[new]
        many = np.unique(own, return_counts=True)[1]
        n = np.repeat(many, many)
        some = n >= least
        columns = [W.mix(own + W.mix(bucket)), name, own & U((1 << BAND_BITS) - 1), at & U((1 << LEFT_BITS) - 1), n if least else np.zeros(len(n), np.int64)]
        kinds = [np.int64, np.int64, np.int16, np.int16, np.int64]
        yield pa.RecordBatch.from_arrays([pa.array(c[some].astype(t)) for c, t in zip(columns, kinds, strict=True)], names=["key", "name", "band", "left", "n"])

    low = U((1 << BAND_BITS + LEFT_BITS) - 1)
    if len(pairs):
        yield from told(pairs[:, 0], np.full(len(pairs), bucket, U), pairs[:, 1], 2)
    if len(hot):
        yield from told(hot[:, 0] & ~low | hot[:, 1], hot[:, 0] % U(k), hot[:, 2], 0)


def meetings(docs: DataFrame, n: int, percent: int, ratio: float, share: float) -> DataFrame:
    """_met of all documents; with a root each, only rows of one root meet."""
    spark = docs.sparkSession
    k, rooted = 8 * width(spark), "root" in docs.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for b in batches:
            for w in W.words(b.column(0), W.SPACED):
                bounds, key, name = sets(w, n)
                _, once = np.unique(name, return_index=True)
                size = np.zeros(len(name), np.int64)
                size[once] = np.diff(bounds)[once]  # of equal sets one stands for all
                if size.max(initial=0):
                    salt = W.mix(b.column(1).to_numpy()[w.lo : w.hi].astype(U)) if rooted else np.zeros(len(name), U)
                    held.append(part_keys(size, bounds[:-1], key, name, bands(int(size.max()), percent, ratio, share), percent, salt))
                    many += len(held[-1])
                if many > FLUSH:
                    yield _dealt(np.concatenate(held), k)
                    held, many = [], 0
        if held:
            yield _dealt(np.concatenate(held), k)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [])
        whole = lambda: (np.frombuffer(b"".join(held[0]), U).reshape(-1, 2), np.frombuffer(b"".join(held[1]), U).reshape(-1, 3))
        for b in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last and last is not None:
                    yield from _met(last, *whole(), k)
                    held = ([], [])
                last = bucket
                for x, part in zip(held, parts, strict=True):
                    x.append(part)
        if last is not None:
            yield from _met(last, *whole(), k)

    keyed = in_arrow(docs.select("text", *(["root"] if rooted else [])), emit, "bucket int, pairs binary, hot binary")
    return in_arrow(keyed.repartition(width(spark), "bucket").sortWithinPartitions("bucket"), meet, "key long, name long, band short, left short, n long")


def clusters(docs: DataFrame, n: int, percent: int, ratio: float, share: float) -> DataFrame:
    """(node, root), stored: classes that meet others, by cluster."""
    met = stored(meetings(docs, n, percent, ratio, share), "met")
    many = stored(met.where("n = 0").groupBy("key").agg((F.count(F.lit(1)) + (1 << 40)).alias("many")), "hot")
    weighed = met if many.isEmpty() else met.join(many, "key", "left").withColumn("n", F.coalesce("many", "n"))
    once = weighed.repartition(width(docs.sparkSession), "name").groupBy("name", "band", "key").agg(F.max("left").alias("left"), F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("name", "band").orderBy(F.desc("n"), "key"))
    kept = stored(once.withColumn("rank", rank).where("rank > left").select("key", "name"), "kept")
    first = kept.groupBy("key").agg(F.min("name").alias("root"))
    found = components(kept.join(first, "key").select(F.col("name").alias("a"), F.col("root").alias("b")))
    discard(met, many, kept)
    return found


def _settle(size: np.ndarray, at: np.ndarray, key: np.ndarray, percent: int, old: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among some sets (key[at[i]:at[i + 1]], sorted); old: known components."""
    n = len(size)
    bit = (W.mix(key ^ U(0x0DD)) % U(SKETCH)).astype(np.int64)
    flips = np.zeros((n, SKETCH), np.uint8)
    np.bitwise_xor.at(flips, (np.repeat(np.arange(n), size), bit), 1)
    sketch = np.packbits(flips, axis=1).view(np.uint64)
    del flips
    root = np.arange(n) if old is None else np.unique(old, return_inverse=True)[1]
    links = []
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        differ = (size[rest] + size[i]) * (100 - percent) // (100 + percent)
        rest, differ = (x[np.minimum(size[rest], size[i]) * 100 >= percent * np.maximum(size[rest], size[i])] for x in (rest, differ))
        rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1) <= differ]
        for j in rest:
            if root[j] == root[i]:
                continue
            x, y = key[at[i] : at[i + 1]], key[at[j] : at[j + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def settled(dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """dealt: cell, name, comp, text. Links (a, b) that connect each cell's sets as far as they are linked. Texts travel,
    not sets: compressed they take less than half; a text of another name (rows of one id) is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            size = np.array([len(k) for _, _, k in held])
            at = np.concatenate([[0], np.cumsum(size)])
            found = _settle(size, at, np.concatenate([k for _, _, k in held]), percent, np.array([c for _, c, _ in held]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found]), pa.array([held[j][0] for _, j in found])], names=["a", "b"])

        for b in batches:
            cells, want, comp = (b.column(i).to_numpy() for i in range(3))
            for w in W.words(b.column(3), W.SPACED):
                bounds, key, name = sets(w, n)
                for i, own in enumerate(name.astype(np.int64)):
                    c = cells[w.lo + i]
                    if c != cell:
                        yield from links()
                        cell = c
                        held.clear()
                    if own == want[w.lo + i]:
                        held.append((own, comp[w.lo + i], key[bounds[i] : bounds[i + 1]].copy()))
        yield from links()

    return in_arrow(dealt.repartition(width(dealt.sparkSession), "cell").sortWithinPartitions("cell").select("cell", "name", "comp", "text"), run, "a long, b long")


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK, deals: int = DEALS) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): (rows, classes), stored. rows: doc_id, txt (hash of the text), n_shingles, name (of the set);
    classes: name, doc_id (smallest), comp (a name for its component). A null id or empty set has no class."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in W.words(b.column(1), W.SPACED):
                bounds, _, name = sets(w, n)
                own = [c[w.lo : w.hi] for c in (b.column(0), b.column(2))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bounds)), pa.array(name.astype(np.int64))], names=["doc_id", "txt", "n_shingles", "name"])

    rows = stored(in_arrow(docs.withColumn("txt", F.xxhash64("text")), named, "doc_id long, txt long, n_shingles long, name long"), "names")
    met = clusters(docs.where("doc_id is not null"), n, percent, *COARSE)
    first = stored(rows.where("n_shingles > 0 and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id")), "first")
    wanted = stored(first.join(met.withColumnRenamed("node", "name"), "name").select("doc_id", "name", "root"), "wanted")

    some = maybe_among(docs, "doc_id", wanted).where("_maybe").drop("_maybe")
    members = _parted(some.join(wanted, "doc_id").select("name", "root", "text"), met, block, "members")
    texts = [members]
    large = members.where("parts > 1")
    if not large.isEmpty():
        finer = clusters(large, n, percent, *FINE)
        refined = _parted(large.select("name", "text").join(finer.withColumnRenamed("node", "name"), "name"), finer, block, "refined")
        members, large = members.where("parts = 1").unionByName(refined.where("parts = 1")), refined.where("parts > 1")
        texts.append(refined)
        discard(finer)
    deal = lambda seed: F.xxhash64("root", F.pmod(F.xxhash64("name", F.lit(seed)), F.col("parts")))
    links = stored(settled(members.where("parts = 1").select(F.col("root").alias("cell"), "name", F.col("name").alias("comp"), "text"), n, percent), "links")
    if not large.isEmpty():
        for seed in range(deals):
            known = components(links)
            now = large.join(known.withColumnRenamed("node", "name").withColumnRenamed("root", "comp"), "name", "left").withColumn("comp", F.coalesce("comp", "name"))
            links = _more(links, settled(now.withColumn("cell", deal(seed)), n, percent), known)
        links = _stragglers(large, links, n, percent, block)
    found = components(links)
    classes = stored(first.join(found.withColumnRenamed("node", "name"), "name", "left").select("name", "doc_id", F.coalesce("root", "name").alias("comp")), "classes")
    discard(met, first, wanted, links, found, *texts)
    return rows, classes


def _more(links: DataFrame, new: DataFrame, *used: DataFrame) -> DataFrame:
    both = stored(links.unionAll(new), "links")
    discard(links, *used)
    return both


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK, deals: int = DEALS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows, classes = linked(docs, n, percent, block, deals)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    top = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = rows.where(~alone).join(classes.join(top, "comp").select("name", "component_id"), "name")
    out = stored(out.select("doc_id", "n_shingles", "component_id").unionAll(rows.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "jaccard")
    discard(rows, classes)
    return out


def _parted(members: DataFrame, met: DataFrame, block: int, name: str) -> DataFrame:
    """members, stored, with the number of blocks of each one's cluster."""
    parts = F.coalesce("parts", F.lit(1)).alias("parts")
    return stored(members.join(F.broadcast(_large(met, block)), "root", "left").select("root", "name", "text", parts), name, compression="zstd")


def _large(met: DataFrame, block: int) -> DataFrame:
    """Clusters of more than one block, and into how many they are dealt: at most classes / block rows."""
    parts = F.ceil(F.col("n") / block).cast("int")
    return met.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("root", parts.alias("parts"))


def _stragglers(large: DataFrame, links: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """The links, with those of classes outside their cluster's largest component: they meet every block of the cluster."""
    known = components(links)
    comp = known.select(F.col("node").alias("name"), F.col("root").alias("comp"))
    all_ = stored(large.select("root", "name").distinct().join(comp, "name", "left").withColumn("comp", F.coalesce("comp", "name")), "told")
    sizes = all_.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = stored(sizes.groupBy("root").agg(F.max(F.struct("n", "comp")).alias("m")).select("root", F.col("m.comp").alias("main")), "main")
    told = stored(all_.join(main, "root").withColumn("out", F.col("comp") != F.col("main")), "out")
    few = stored(told.where("out").groupBy("root").agg(F.count(F.lit(1)).alias("n_out")), "few")
    now = large.join(told.drop("root"), "name").join(few, "root")
    lots = F.greatest(F.lit(1), F.ceil(F.col("n_out") / block)).cast("int")
    lot = F.pmod(F.xxhash64("name", F.lit("lot")), lots)
    part = F.pmod(F.xxhash64("name", F.lit("part")), F.col("parts"))
    # all classes, block by block, meet every lot of stragglers; a straggler goes to all blocks of its own lot
    pairs = now.select("*", part.alias("p"), lot.alias("l"), lots.alias("lots"))
    whole = pairs.select("root", "name", "comp", "text", "p", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("l"))
    own = pairs.where("out").select("root", "name", "comp", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "l")
    both = whole.unionByName(own).withColumn("cell", F.xxhash64("root", "p", "l"))
    return _more(links, settled(both, n, percent), known, all_, main, told, few)


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row, with its own columns, of each component: of smallest doc_id, then of smallest set name and text hash. Every
    row with a null doc_id stays, as do empty texts; of rows equal in doc_id and text one stays. Only rows whose id may
    be among those that go, or are repeated, are shuffled."""
    whole, docs = docs.columns, apart(docs, "doc_id")
    rows, classes = linked(docs, n, percent)
    each = rows.where("doc_id is not null").groupBy("doc_id", "txt", "name").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
    each = stored(each.join(classes.select("name", "comp"), "name", "left"), "each")
    one = each.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "name", "txt")).alias("one")).select("comp", "one.doc_id", "one.txt", F.lit(True).alias("stays"))
    told = each.join(one, ["comp", "doc_id", "txt"], "left").withColumn("stays", F.coalesce("stays", F.col("n_shingles") == 0))
    odd = stored(told.where("n > 1 or not stays").select("doc_id", "txt", "stays"), "odd")
    discard(rows, classes, each)
    names = docs.columns
    marked = maybe_among(docs, "doc_id", odd)
    own = F.struct(*(F.col(c) for c in names))
    rest = marked.where("_maybe").groupBy(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_txt")).agg(F.min_by(own, F.xxhash64(*names)).alias("_row"))
    goes = odd.where("not stays").select(F.col("doc_id").alias("_id"), F.col("txt").alias("_txt"))
    kept = marked.where("not _maybe").select(*names).unionByName(rest.join(goes, ["_id", "_txt"], "left_anti").select("_row.*"))
    return back(kept, whole, "doc_id")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
