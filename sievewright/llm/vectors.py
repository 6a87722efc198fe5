"""Embedding near-duplicates by lattice hashing.

Equal vectors of one label form a class. In each of ``tables`` tables a random orthonormal projection takes the unit
vector to 8 dimensions, scaled so that distances keep their mean, and the nearest point of the E8 lattice (step ``step``)
is its cell. A class is stored in its own cell and probes it and the ``probes`` lattice neighbours nearest to it. Where a
probe meets a stored class, 256-bit sign sketches of both must differ in at most ``hamming`` bits; what is left is joined
with the vectors and verified by cosine in double precision. Found links make components.

Fixed by the angle of cosine 0.93 (0.376 radians): sketches differ in 31 of 256 bits in the mean, and 66 is over six
deviations above. Recall of the defaults is measured against brute force in the tests.

Defined results: a null label, a null, empty or zero vector, or one with null or non-finite components links with nothing
and is its own component; vectors of different lengths do not link; a null vec_id links with nothing and has component
null and kept null; repeated rows of one id are equal vectors or separate ones as their values say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import in_arrow, stored, whole, width
from .words import mix

U = np.uint64
COSINE, TABLES, PROBES, STEP, HAMMING, BITS, SEED, BLOCK = 0.93, 10, 10, 0.7, 66, 256, 8, 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        signs = np.array([1 - 2 * (m >> i & 1) for i in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (step 1) to each row."""

    def even(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        odd = np.flatnonzero(z.sum(1) % 2)
        off = y[odd] - z[odd]
        worst = np.abs(off).argmax(1)
        z[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return z

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """63-bit keys of lattice points; salt: of table, label and length."""
    h = salt.astype(U)
    for j in range(8):
        h = mix(h + (points[:, j] * 2).astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15) + U(j))
    return (h >> U(1)).astype(np.int64)


def _matrix(dims: int, t: int, columns: int) -> np.ndarray:
    """Short vectors count as padded with zeros up to ``columns`` and are rotated, which keeps all distances."""
    g = np.random.default_rng([SEED, dims, t]).standard_normal((max(dims, columns) if columns <= 8 else dims, columns))
    if columns > 8:
        return g
    return np.linalg.qr(g)[0] * np.sqrt(dims / columns) if dims >= columns else np.linalg.qr(g)[0][:dims]


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values in double precision, by length."""
    offs = column.offsets.to_numpy()
    size, flat = np.diff(offs), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out[int(d)] = at, flat[offs[:-1][at][:, None] + np.arange(d)]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _projected(x: np.ndarray, dims: int, t: int, step: float) -> np.ndarray:
    y = x @ _matrix(dims, t, 8)
    return np.pad(y, ((0, 0), (0, 8 - y.shape[1]))) / step


def pairs(classes: DataFrame, tables: int, probes: int, step: float, hamming: int, block: int) -> DataFrame:
    """Pairs (a < b) of classes (cid, label, emb) that meet in a cell and whose sketches agree; each once. Cells where more
    than ``block`` classes are stored are cut."""
    roots, n = _roots(), width(classes.sparkSession)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = b.column(0).to_numpy()
            label = b.column(1).to_numpy().astype(np.int64).astype(U)
            for d, (at, x) in _vectors(b.column(2)).items():
                x = _unit(x)
                sketch = np.packbits(x @ _matrix(d, -1 + 10_000, BITS) > 0, axis=1)
                salt = mix(label[at] * U(1_000_003) + U(d))
                for t in range(tables):
                    y = _projected(x, d, t, step)
                    own = nearest(y)
                    far = ((y - own)[:, None, :] - roots[None]) ** 2
                    near = np.argpartition(far.sum(2), probes, axis=1)[:, :probes]
                    cells = [_cell(own, salt + U(t))] + [_cell(own + roots[near[:, j]], salt + U(t)) for j in range(probes)]
                    for j, cell in enumerate(cells):
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cid[at]), pa.array(np.full(len(at), j == 0)), pa.array([s.tobytes() for s in sketch], pa.binary())], names=["cell", "cid", "own", "sketch"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        cell, cid, own = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in range(3))
        sketch = np.frombuffer(b"".join(x for b in held for x in b.column(3).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        by = np.lexsort((~own, cell))
        cell, cid, own, sketch = cell[by], cid[by], own[by], sketch[by]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        stop = np.append(first[1:], len(cell))
        stored_ = np.add.reduceat(own.astype(np.int64), first)
        for lo, hi, k in zip(first, stop, stored_, strict=True):
            for i in range(lo, lo + k):  # what is stored, against later stored ones and all probes
                rest = np.arange(i + 1, hi)
                rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1) <= hamming]
                rest = cid[rest][cid[rest] != cid[i]]
                if len(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rest, cid[i])), pa.array(np.maximum(rest, cid[i]))], names=["a", "b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy().astype(np.int64).astype(U)
            for d, (at, x) in _vectors(b.column(2)).items():
                salt = mix(label[at] * U(1_000_003) + U(d))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(_cell(nearest(_projected(_unit(x), d, t, step)), salt + U(t)))], names=["cell"])

    told = classes.select("cid", F.xxhash64(F.col("label").cast("string")).alias("label"), "emb")
    stands = in_arrow(told, count, "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    full = stored(stands.select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "full")
    entries = in_arrow(told, enter, "cell long, cid long, own boolean, sketch binary")
    if not full.isEmpty():
        entries = _cut(entries, full)
    return in_arrow(entries.repartition(n, "cell"), meet, "a long, b long").distinct()


def _cut(entries: DataFrame, full: DataFrame) -> DataFrame:
    """Entries of full cells go to parts (i, j) of their cell: what is stored in block i meets what comes in block j. So
    a task holds two blocks of a cell, however full it is."""
    rows = entries.join(full, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    part = lambda i, j, own: F.struct(i.alias("i"), j.alias("j"), F.lit(own).alias("own"))
    comes = F.transform(every, lambda i: part(i, F.col("b"), False))
    stays = F.concat(F.transform(every, lambda j: part(F.col("b"), j, True)), F.filter(comes, lambda p: p["i"] != F.col("b")))
    rows = rows.select("cell", "cid", "sketch", "blocks", F.explode(F.when(F.col("own"), stays).otherwise(comes)).alias("p"))
    cell = F.when(F.col("blocks") > 1, F.xxhash64("cell", "p.i", "p.j")).otherwise(F.col("cell"))
    return rows.select(cell.alias("cell"), "cid", F.col("p.own").alias("own"), "sketch")


def verified(pairs_: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose vectors reach the cosine, with both classes' copies."""
    own = classes.select("cid", "emb", "copies")
    x, y = (own.select(F.col("cid").alias(c), F.col("emb").alias(f"x{c}"), F.col("copies").alias(f"n{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = _vectors(b.column("xa")), _vectors(b.column("xb"))
            keep = np.zeros(b.num_rows, bool)
            for d, (at, x) in one.items():
                keep[at] = (_unit(x) * _unit(two[d][1])).sum(1) >= cosine
            b = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    return in_arrow(pairs_.join(x, "a").join(y, "b").select("a", "b", "xa", "xb", "na", "nb"), run, "a long, b long, na long, nb long")


@whole
def near(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, step: float = STEP, hamming: int = HAMMING, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    finite = F.forall("emb", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("emb") > 0) & finite & F.exists("emb", lambda e: e != 0), F.lit(False))
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("emb")).withColumn("good", good)
    packed = F.struct("label", "emb")
    named = F.when(F.col("good"), packed)
    classes = base.where("good").groupBy("label", "emb").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "classes")
    links = stored(verified(pairs(classes, tables, probes, step, hamming, block), classes, cosine), "links")
    # a pair of classes links every copy of one with every copy of the other; copies of a class link with each other
    both = links.select(F.col("a").alias("cid"), F.col("nb").alias("n")).unionAll(links.select(F.col("b").alias("cid"), F.col("na").alias("n")))
    degree = both.groupBy("cid").agg(F.sum("n").alias("others"))
    found = components(links.select("a", "b")) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    told = classes.join(degree, "cid", "left").join(found.withColumnRenamed("node", "cid"), "cid", "left")
    told = stored(told.select(F.struct("label", "emb").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), "told")
    out = base.withColumn("class", named).select("vec_id", "class").where("class is not null").join(told, "class")
    out = out.select("vec_id", "n_links", F.col("root").alias("component_id"))
    rest = base.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
