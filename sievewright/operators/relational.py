"""Relational operators of the funnel, as DataFrame compositions that keep big columns out of shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", key: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``island``: spans of a group in (start, end) order join the island before if they touch it (start at most one
    after its furthest end) and carry its key. A span of another key in between breaks the island for good."""
    seq = [start, end, *order]
    whole = Window.partitionBy(*by).orderBy(*seq)
    run = F.lit(0) if key is None else F.sum(F.when(F.col(key).eqNullSafe(F.lag(key).over(whole)), 0).otherwise(1)).over(whole)
    out = spans.withColumn("_run", run)
    inner = Window.partitionBy(*by, "_run").orderBy(*seq)
    far = F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_gap", F.when(far.isNull() | (F.col(start) > far + 1), 1).otherwise(0))
    return out.withColumn("island", F.struct("_run", F.sum("_gap").over(inner).alias("_n"))).drop("_run", "_gap")


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def sharded(members: DataFrame, by: str, order: Sequence[str], limit: int) -> DataFrame:
    """Adds ``shard``: groups above the limit are cut in order into numbered chunks, others keep their name."""
    row = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    return members.withColumn("shard", F.when(size > limit, F.concat(F.col(by), F.lit("-"), F.floor(row / limit).cast("string"))).otherwise(F.col(by)))


#: Items that a fold takes at a time.
FOLDED = 128


def packed(items: DataFrame, by: Sequence[str], order: str, cost: str, budget: int, most: int) -> DataFrame:
    """Greedy packing inside each group: (by, request, items as an ordered array, payload). A request closes when it has
    ``most`` items or the next would pass the budget; an item above the budget travels alone, none is dropped.
    The fold holds one group's (order, cost) pairs, so ``by`` must bound a group; a step copies at most FOLDED of them."""
    kind = items.select(order).schema[0].dataType.simpleString()
    kind = "bigint" if kind in ("int", "smallint", "tinyint") else kind
    zero = F.expr(f"cast(array() as array<struct<request:bigint,n:bigint,payload:bigint,o:{kind}>>)")

    def step(done: Column, item: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        new = last.isNull() | (last["n"] >= most) | (last["payload"] + item["c"] > budget)
        one = F.lit(1).cast("bigint")
        return F.concat(done, F.array(F.struct(
            F.when(last.isNull(), F.lit(0).cast("bigint")).when(new, last["request"] + 1).otherwise(last["request"]).alias("request"),
            F.when(new, one).otherwise(last["n"] + 1).alias("n"),
            F.when(new, item["c"]).otherwise(last["payload"] + item["c"]).alias("payload"),
            item["o"].alias("o"),
        )))

    def chunk(done: Column, of: Column) -> Column:
        last = F.slice(F.coalesce(F.try_element_at(done, F.lit(-1)), zero), -1, 1)
        return F.concat(done, F.array(F.slice(F.aggregate(of, last, step), F.size(last) + 1, F.size(of))))

    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(order).cast(kind).alias("o"), F.col(cost).cast("bigint").alias("c"))))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / FOLDED).cast("int")), lambda i: F.slice("_s", i * FOLDED + 1, FOLDED))
    folded = items.groupBy(*by).agg(sorted_.alias("_s")).select(*by, F.flatten(F.aggregate(cut, F.array(zero), chunk)).alias("_f"))
    rows = folded.select(*by, F.explode("_f").alias("f"))
    return rows.groupBy(*by, F.col("f.request").alias("request")).agg(F.array_sort(F.collect_list("f.o")).alias("items"), F.max("f.payload").alias("payload"))


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], header: Column, name: str = "header") -> DataFrame:
    """Each row with the most recent header at or before it; rows before any header have null."""
    return rows.withColumn(name, F.last(header, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def last_wins(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return first_k(rows, by, order, 1, "_rank").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    return old.join(new, list(by), "left_anti").unionByName(new)


def enclosing(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, bin_width: int, depth: str) -> DataFrame:
    """Left range join: each point with its deepest enclosing span. Points and spans meet by equality on (by, bin), so the
    join is a hash or merge join however wide a group is."""
    cut = lambda c: F.floor(F.col(c) / bin_width).cast("long")
    wide = spans.withColumn("_bin", F.explode(F.sequence(cut(start), cut(end))))
    hit = points.withColumn("_bin", cut(at)).join(wide, [by, "_bin"], "left").where(F.col(start).isNull() | F.col(at).between(F.col(start), F.col(end)))
    best = hit.groupBy(by, at).agg(F.max_by(F.struct(start, end), depth).alias("span"))
    return points.join(best, [by, at], "left").select(*points.columns, f"span.{start}", f"span.{end}")


def prefix_cached(usage: DataFrame, instance: str, prefix: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``cached``: not the first request of a model instance with these prefix bytes."""
    return usage.withColumn("cached", F.row_number().over(Window.partitionBy(instance, F.md5(prefix)).orderBy(*order)) > 1)


#: Library keys that may be broadcast (some 40 bytes each).
INDEXED = 1 << 20


def similar_topk(queries: DataFrame, library: DataFrame, k: int, least: float, indexed: int = INDEXED) -> DataFrame:
    """queries (q, keys), library (e, keys): the k library rows of highest Jaccard per query, at least ``least`` above 0
    (ties by e). Nothing is compared that shares no key.

    A library of at most ``indexed`` keys, which is counted first, is broadcast by key: a query's keys meet it in the task
    that holds the query, and overlaps are added up there. A larger one meets on prefixes: of each row's keys, rarest in
    the library first, all but those without which ``least`` could still be reached, and sizes must allow it; the pairs
    found are verified on whole sets."""
    sets = lambda d, c: d.select(c, F.array_distinct("keys").alias(f"k{c}")).withColumn(f"n{c}", F.size(f"k{c}"))
    q, e = sets(queries, "q"), sets(library, "e")
    entries = e.select("e", "ne", F.explode("ke").alias("key"))
    asked = q.select("q", "nq", F.explode("kq").alias("key"))
    if entries.count() <= indexed:
        both = asked.join(F.broadcast(entries), "key").groupBy("q", "e", "nq", "ne").agg(F.count(F.lit(1)).alias("common"))
    else:
        rarity = entries.groupBy("key").agg(F.count(F.lit(1)).alias("rarity"))

        def prefix(rows: DataFrame, c: str) -> DataFrame:
            ranked = rows.join(rarity, "key", "left").select(c, f"n{c}", F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "key").alias("x"))
            sorted_ = ranked.groupBy(c, f"n{c}").agg(F.array_sort(F.collect_list("x")).alias("x"))
            first = F.slice("x", F.lit(1), (F.col(f"n{c}") - F.ceil(F.col(f"n{c}") * least) + 1).cast("int"))
            return sorted_.select(c, f"n{c}", F.explode(F.transform(first, lambda x: x["key"])).alias("key"))

        sized = (F.col("ne") >= F.col("nq") * least) & (F.col("nq") >= F.col("ne") * least)
        pairs = prefix(asked, "q").join(prefix(entries, "e"), "key").where(sized).select("q", "e").distinct()
        both = pairs.join(q, "q").join(e, "e").withColumn("common", F.size(F.array_intersect("kq", "ke")))
    score = F.col("common") / (F.col("nq") + F.col("ne") - F.col("common"))
    return first_k(both.withColumn("score", score).where((F.col("score") >= least) & (F.col("common") > 0)), ["q"], [F.desc("score"), "e"], k).select("q", "e", "score", "rank")
