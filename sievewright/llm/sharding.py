"""Sharding by balanced label propagation, with DataFrame functions only. Law ``bytes``: shard sizes near equal.

Documents are linked where their texts are equal. A group's copies on one shard are interchangeable, so the state is one
row a group: its copies on each shard, hashed ones at the start. The quota is an even share of all bytes. A group above
it, fewer than ``shards`` in number, fills whole shards and goes on with its rest. In each round every group that is not
settled asks for the shard that holds most of it among those not full, or for any other in proportion to room; as its
copies will leave the other shards, only settled bytes count against a shard's quota. A shard settles whole groups, by
hash buckets, until one overruns; then it is full. Each round settles all that is left or fills a shard, and rounds end
when nothing is left or all are full. What is left then is laid whole along the room left, in order of bytes; fewer than
``shards`` groups lie across a border, and of these only those that fit no shard whole are split.
Unlinked documents, no matter where, cut no link; they fill each shard up to its even share: the larger
half of their bytes in size order by a low-discrepancy sequence over what each shard lacks, the smaller half by running
totals against what is still missing, so shards differ by about one small document where no single text is larger.

Rows are told apart by id and text alone, so shards do not depend on files or their order.

Defined results: null text has size 8, crc 0 and no links; empty texts are equal texts. Rows with equal ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import running, stored, whole

SHARDS, BUCKETS, LARGE = 24, 1024, 8
STATE = "g string, size long, shard int, n long"


def _deal(n: int, size: int, room: list[float]) -> list[tuple[int, int]]:
    """(shard, copies) of n copies over what room there is, the roomiest shards first; takes it from ``room``."""
    out = []
    for s in sorted(range(len(room)), key=lambda s: -room[s]):
        k = min(n, max(0, int(room[s] // size)))
        if k:
            out.append((s, k))
            room[s] -= k * size
            n -= k
    for _ in range(n):  # less than a copy's room on each shard
        s = max(range(len(room)), key=lambda s: room[s])
        out.append((s, 1))
        room[s] -= size
    return out


def _large(groups: DataFrame, quota: float, room: list[float]) -> tuple[list[tuple], list[tuple]]:
    """Places groups above an eighth of the quota, fewer than 8 x shards, the largest first: whole shards for what is above
    the quota, then the tightest shard that holds the rest. (g, size, shard, n) settled, and the (g, size, copies, parts)
    that fit nowhere; takes from ``room``."""
    put, rest, sized = [], [], []
    for r in sorted(groups.where(F.col("size") * F.col("copies") > quota / LARGE).collect(), key=lambda r: (-r["size"] * r["copies"], r["g"])):
        each, n = max(1, int(quota // r["size"])), r["copies"]
        order = [p["shard"] for p in r["parts"]]
        order += [s for s in range(len(room)) if s not in order]
        for s in order if n * r["size"] > quota else []:
            if n >= each and room[s] == quota:
                put.append((r["g"], r["size"], s, each))
                room[s] -= each * r["size"]
                n -= each
        if n:
            sized.append((n * r["size"], r["g"], r["size"], n, order, r["parts"]))
    for weight, g, size, n, order, parts in sorted(sized, key=lambda x: (-x[0], x[1])):
        fits = [s for s in order if room[s] >= weight]
        if fits:
            best = min(fits, key=lambda s: room[s])
            put.append((g, size, best, n))
            room[best] -= weight
        else:
            rest.append((g, size, n, parts))
    return put, rest


def _propagate(groups: DataFrame, quota: float, shards: int) -> DataFrame:
    """groups: g, size, copies, parts (n, shard; largest first). Gives g, size, shard, n."""
    spark, weight = groups.sparkSession, F.col("size") * F.col("copies")
    room = [quota] * shards
    put, rest = _large(groups, quota, room)
    left = groups.where(weight <= quota / LARGE).unionByName(spark.createDataFrame(rest, groups.schema))
    settled, free, turn = [], {s for s in range(shards) if room[s] > 0}, 0
    while free:
        open_ = F.array(*[F.lit(s in free) for s in range(shards)])
        mine = F.get(F.filter("parts", lambda p: F.get(open_, p["shard"])), F.lit(0))["shard"]
        ends = _sums([max(0.0, x) if s in free else 0.0 for s, x in enumerate(room)])
        other = _interval(F.pmod(F.xxhash64("g", F.lit(2 * turn)), F.lit(2**30)) * (ends[-1] / 2**30), ends)
        wish = left.select("g", "size", "copies", "parts", F.coalesce(mine, other).alias("to"))
        wish = stored(wish.withColumn("bucket", F.pmod(F.xxhash64("g", F.lit(2 * turn + 1)), F.lit(BUCKETS))), "wishes")
        cut = [BUCKETS] * shards
        # at most shards x buckets rows
        for r in sorted(wish.groupBy("to", "bucket").agg(F.sum(weight).alias("bytes")).collect(), key=lambda r: r["bucket"]):
            if r["to"] in free and r["bytes"] <= room[r["to"]]:
                room[r["to"]] -= r["bytes"]
            elif r["to"] in free:
                cut[r["to"]] = r["bucket"]
                free.discard(r["to"])
        goes = F.col("bucket") < F.get(F.array(*map(F.lit, cut)), F.col("to"))
        settled.append(wish.where(goes).select("g", "size", F.col("to").alias("shard"), F.col("copies").alias("n")))
        left = wish.where(~goes).select("g", "size", "copies", "parts")
        turn += 1
        if min(cut) == BUCKETS:
            break
    else:
        # no shard has room for a bucket of what was asked
        laid = running(left.select("g", "size", "copies").withColumn("one", F.lit(1)), ["one"], [(-weight).alias("w"), F.col("g"), F.col("size")], weight)
        ends = _sums([max(0.0, x) for x in room])
        laid = laid.withColumn("shard", _interval(F.col("run_sum"), ends)).withColumn("last", _interval(F.col("run_sum") + weight - 1, ends))
        laid = stored(laid, "laid")
        whole = laid.where("shard = last").select("g", "size", "shard", F.col("copies").alias("n"))
        settled.append(whole)
        for r in whole.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect():
            room[r["shard"]] -= r["b"]
        # fewer than shards rows
        for r in sorted(laid.where("shard != last").collect(), key=lambda r: (-r["size"] * r["copies"], r["g"])):
            fits = [s for s in range(shards) if room[s] >= r["size"] * r["copies"]]
            if fits:
                best = min(fits, key=lambda s: room[s])
                room[best] -= r["size"] * r["copies"]
                put.append((r["g"], r["size"], best, r["copies"]))
            else:
                put += [(r["g"], r["size"], s, n) for s, n in _deal(r["copies"], r["size"], room)]
    state = spark.createDataFrame(put, STATE)
    for df in settled:
        state = state.unionByName(df)
    return state.groupBy("g", "size", "shard").agg(F.sum("n").alias("n"))


def _interval(position: Column, upper: list[float]) -> Column:
    """Which of the intervals with these upper ends holds the position."""
    return F.least(F.lit(len(upper) - 1), F.size(F.filter(F.array(*map(F.lit, upper)), lambda x: x <= position))).cast("int")


def _sums(values: list[float]) -> list[float]:
    out, total = [], 0.0
    for v in values:
        total += v
        out.append(total)
    return out


def _fill(single: DataFrame, lack: list[float], shards: int) -> DataFrame:
    """Gives each unlinked document a shard so that each shard gets about its part of ``lack``."""
    whole = float(single.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    ranked = running(single.withColumn("one", F.lit(1)), ["one"], [F.desc("size"), F.col("rid")], F.col("size")).drop("one")
    ranked = stored(ranked, "singles")
    lack = lack if sum(lack) > 0 else [1.0] * shards
    even = [x / sum(lack) for x in _sums(lack)]
    golden = (F.col("run_rows") * 0.6180339887498949) % 1.0
    head = ranked.where(F.col("run_sum") < whole / 2).withColumn("shard", _interval(golden, even))
    loads = {r["shard"]: float(r["b"]) for r in head.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    missing = [max(0.0, x * whole / sum(lack) - loads.get(i, 0.0)) for i, x in enumerate(lack)]
    rest = max(1.0, whole - sum(loads.values()))
    missing = missing if sum(missing) > 0 else [1.0] * shards
    ends = [x * rest / sum(missing) for x in _sums(missing)]
    tail = ranked.where(F.col("run_sum") >= whole / 2).withColumn("shard", _interval(F.col("run_sum") - sum(loads.values()) + F.col("size") / 2, ends))
    return head.unionByName(tail).drop("run_rows", "run_sum")


@whole
def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    bytes_ = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(bytes_) + 8).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), F.md5(F.col("text").cast("binary")).alias("g"))
    base = stored(base.withColumn("rid", F.xxhash64("doc_id", "g")), "base")  # equal rows are interchangeable
    whole = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = stored(base.where("g is not null").groupBy("g", "size").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    linked = base.join(groups.select("g", "size"), ["g", "size"])
    alone = base.join(groups.select("g", "size"), ["g", "size"], "left_anti")
    parts = linked.groupBy("g", "size", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("g", "size").agg(F.sum("n").alias("copies"), F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False).alias("parts"))
    state = stored(_propagate(stored(parts, "labels"), whole / shards, shards), "labels")
    part = F.array_sort(F.collect_list(F.struct("shard", "n")))
    ends = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    where = stored(state.groupBy("g", "size").agg(part.alias("p")).select("g", "size", F.transform("p", lambda x: x["shard"]).alias("shards"), ends.alias("ends")), "where")
    ranked = running(linked, ["g", "size"], [F.col("doc_id"), F.col("rid")], F.lit(1))
    put = ranked.join(where, ["g", "size"])
    put = put.withColumn("shard", F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("run_rows"))) + 1))
    loads = {r["shard"]: float(r["b"]) for r in state.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}
    lack = [max(0.0, whole / shards - loads.get(i, 0.0)) for i in range(shards)]
    keep = ["doc_id", "rid", "size", "text_crc32", "shard"]
    out = put.select(*keep).unionByName(_fill(alone, lack, shards).select(*keep))
    slots = running(out, ["shard"], [F.col("doc_id"), F.col("rid")], F.lit(1))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("run_rows").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
