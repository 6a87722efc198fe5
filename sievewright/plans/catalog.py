"""Registered queries over the driver tables, each beside the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R

QUERIES, SQL = {}, {}
SITE = r"(^|[^a-z])with([^a-z]|$)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sites(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, total, key): lines with the word; the key is the line's first letter, as a stand-in for its function."""
    rows = table(spark, d, "documents").select("doc_id", T.lines(F.col("text")).alias("ls"))
    rows = rows.select("doc_id", F.size("ls").alias("total"), F.posexplode("ls").alias("line", "t"))
    return rows.where(F.lower("t").rlike(SITE)).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.col("total").cast("long").alias("total"), F.substring("t", 1, 1).alias("key"))


_SITES = rf"""sites AS (
  SELECT doc_id, line, total, substr(t, 1, 1) AS key FROM (
    SELECT doc_id, unnest(ls) AS t, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line, CAST(len(ls) AS BIGINT) AS total
    FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM documents))
  WHERE regexp_matches(lower(t), '{SITE}'))"""
_TOK = "CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(length(text) / 3.4::DOUBLE)) END"


@query(f"SELECT count(*) AS files, CAST(sum({_TOK}) AS BIGINT) AS input_tokens, round(sum({_TOK}) * 2.5 / 1e6 + sum({_TOK}) * 10 / 1e6, 6) AS cost FROM documents WHERE contains(text, ' with ')")
def naive_cost(spark, d):
    n = T.tokens(F.col("text"))
    return table(spark, d, "documents").where(F.contains("text", F.lit(" with "))).agg(
        F.count(F.lit(1)).alias("files"), F.sum(n).alias("input_tokens"), F.round(F.sum(n) * 2.5 / 1e6 + F.sum(n) * 10 / 1e6, 6).alias("cost"))


@query(f"SELECT doc_id, CAST({_TOK} AS BIGINT) AS tokens, substr(text, 1, 340) AS head FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"), T.truncated(F.col("text"), 100).alias("head"))


@query(f"WITH {_SITES} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM sites)")
def touched_files(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(sites(spark, d), "doc_id", "left_semi")


_USAGE = "SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN 'strong' ELSE 'cheap' END AS model, 500 + event_id % 700 AS input, event_id % 90 AS output FROM events"


def usage(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "purchase", "strong").otherwise("cheap").alias("model"), (500 + F.col("event_id") % 700).alias("input"), (F.col("event_id") % 90).alias("output"))


@query(f"SELECT model, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input_tokens, CAST(sum(output) AS BIGINT) AS output_tokens, round(sum(input * CASE model WHEN 'strong' THEN 2.5 ELSE 0.15 END + output * CASE model WHEN 'strong' THEN 10 ELSE 0.6 END)::DOUBLE / 1e6, 4) AS cost FROM ({_USAGE}) GROUP BY model")
def cost_by_model(spark, d):
    each = T.cost(F.col("input"), F.col("output"), F.lit(0), F.col("model") == "strong")
    return usage(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.round(F.sum(each), 4).alias("cost"))


@query(f"SELECT user_id, count(*) AS requests, CAST(sum(CASE WHEN n > 1 THEN 450 ELSE 0 END) AS BIGINT) AS cached_tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM ({_USAGE})) GROUP BY user_id")
def prefix_cache_ledger(spark, d):
    rows = R.prefix_cached(usage(spark, d), "user_id", F.col("event_type"), ["event_id"])
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("cached"), 450).otherwise(0)).alias("cached_tokens"))


@query(f"WITH {_SITES} SELECT doc_id, line, greatest(1, line - 6) AS start, least(total, line + 6) AS stop FROM sites")
def site_windows(spark, d):
    return windows(spark, d).select("doc_id", "line", "start", "stop")


def windows(spark, d):
    return sites(spark, d).withColumn("start", F.greatest(F.lit(1), F.col("line") - 6)).withColumn("stop", F.least("total", F.col("line") + 6))


_ISLANDS = f"""{_SITES}, w AS (SELECT *, greatest(1, line - 6) AS start, least(total, line + 6) AS stop FROM sites),
 r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY start, stop, line) AS run FROM (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY doc_id ORDER BY start, stop, line) THEN 0 ELSE 1 END AS c FROM w)),
 b AS (SELECT *, max(stop) OVER (PARTITION BY doc_id, run ORDER BY start, stop, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY start, stop, line) AS isl FROM b),
 hunks AS (SELECT doc_id, CAST(min(start) AS BIGINT) AS first, CAST(max(stop) AS BIGINT) AS last, count(*) AS sites, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS site_lines, min(key) AS key FROM i GROUP BY doc_id, run, isl)"""


def hunks(spark, d):
    rows = R.islands(windows(spark, d), ["doc_id"], "start", "stop", "key", ["line"])
    lines = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x.cast("string")), ",")
    return rows.groupBy("doc_id", "island").agg(F.min("start").alias("first"), F.max("stop").alias("last"), F.count(F.lit(1)).alias("sites"), lines.alias("site_lines"), F.min("key").alias("key")).drop("island")


@query(f"WITH {_ISLANDS} SELECT * FROM hunks")
def merge_islands_documents(spark, d):
    return hunks(spark, d)


@query("""WITH w AS (SELECT conv_id, role, turn, greatest(0, turn - 1) AS s, turn + 1 AS e FROM conversations),
 r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY s, e, turn) AS run FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY s, e, turn) THEN 0 ELSE 1 END AS c FROM w)),
 b AS (SELECT *, max(e) OVER (PARTITION BY conv_id, run ORDER BY s, e, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY s, e, turn) AS isl FROM b)
 SELECT conv_id, min(role) AS role, CAST(min(s) AS BIGINT) AS first, CAST(max(e) AS BIGINT) AS last, count(*) AS turns FROM i GROUP BY conv_id, run, isl""")
def merge_islands_conversations(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "role", "turn", F.greatest(F.lit(0), F.col("turn") - 1).alias("s"), (F.col("turn") + 1).alias("e"))
    rows = R.islands(rows, ["conv_id"], "s", "e", "role", ["turn"])
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.min("s").cast("long").alias("first"), F.max("e").alias("last"), F.count(F.lit(1)).alias("turns")).drop("island")


_HUNKTEXT = f"""{_ISLANDS}, h AS (SELECT hunks.*, array_to_string(regexp_split_to_array(text, '\\r\\n|\\r|\\n')[first:last], chr(10)) AS text FROM hunks JOIN documents USING (doc_id))"""


def hunk_texts(spark, d):
    """Hunks with their lines: text joins late, by doc_id, after windows and islands ran on narrow rows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    part = F.slice(T.lines(F.col("text")), F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))
    return hunks(spark, d).join(docs, "doc_id").withColumn("window", part).withColumn("text", F.array_join("window", "\n"))


@query(f"WITH {_HUNKTEXT} SELECT doc_id, first, array_to_string(list_transform(generate_series(first, last), lambda i: lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || ' | ' || string_split(text, chr(10))[i - first + 1]), chr(10)) AS body FROM h")
def hunk_render(spark, d):
    return hunk_texts(spark, d).select("doc_id", "first", T.rendered(F.col("window"), F.col("first")).alias("body"))


@query(f"WITH {_HUNKTEXT} SELECT doc_id, first, CAST({_TOK} AS BIGINT) AS token_cost, {_TOK} > 400 AS oversized FROM h")
def oversized_hunks(spark, d):
    return hunk_texts(spark, d).select("doc_id", "first", T.tokens(F.col("text")).alias("token_cost")).withColumn("oversized", F.col("token_cost") > 400)


@query("SELECT event_id, CASE WHEN event_type IS NULL THEN 'module' WHEN regexp_matches(event_type || '_' || props, 'batch|bulk|export|nightly|report|sync') THEN 'batch' ELSE 'interactive' END AS kind FROM events")
def fn_kind_case(spark, d):
    return table(spark, d, "events").select("event_id", T.function_kind(F.concat("event_type", F.lit("_"), "props")).alias("kind"))


_FP = f"{_ISLANDS}, fp AS (SELECT doc_id, first, last, sites, substr(md5('site|' || array_to_string(list_sort(list_distinct([key, CAST(sites AS VARCHAR)])), '|')), 1, 12) AS fingerprint FROM hunks)"


def printed(spark, d):
    return hunks(spark, d).withColumn("fingerprint", T.fingerprint(F.array(F.lit("site")), F.array("key", F.col("sites").cast("string"))))


@query(f"WITH {_FP} SELECT fingerprint, count(*) AS size, count(*) = 1 AS singleton, CAST(sum(sites) AS BIGINT) AS sites FROM fp GROUP BY 1")
def fingerprint_clusters(spark, d):
    return printed(spark, d).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) == 1).alias("singleton"), F.sum("sites").alias("sites"))


@query(f"WITH {_FP}, c AS (SELECT fingerprint, count(*) AS size FROM fp GROUP BY 1) SELECT count(*) AS clusters, CAST(sum(size) AS BIGINT) AS hunks, max(size) AS largest, CAST(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, round(coalesce(sum(size)::DOUBLE / nullif(count(*), 0), 0), 2) AS compression FROM c")
def cluster_stats(spark, d):
    c = fingerprint_clusters(spark, d)
    return c.agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("hunks"), F.max("size").alias("largest"), F.sum(F.col("singleton").cast("long")).alias("singletons"), F.round(F.coalesce(F.try_divide(F.sum("size"), F.count(F.lit(1))), F.lit(0.0)), 2).alias("compression"))


@query(f"WITH {_FP}, n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id, first) - 1 AS r, count(*) OVER (PARTITION BY fingerprint) AS size FROM fp) SELECT doc_id, first, CASE WHEN size > 40 THEN fingerprint || '-' || CAST(r // 40 AS VARCHAR) ELSE fingerprint END AS shard FROM n")
def cluster_shards(spark, d):
    return R.sharded(printed(spark, d), "fingerprint", ["doc_id", "first"], 40).select("doc_id", "first", "shard")


@query(f"WITH {_FP} SELECT fingerprint, doc_id, first, rank FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY last - first, doc_id, first) AS rank FROM fp) WHERE rank <= 2")
def representatives_topk(spark, d):
    return R.first_k(printed(spark, d), ["fingerprint"], [F.col("last") - F.col("first"), "doc_id", "first"], 2).select("fingerprint", "doc_id", "first", F.col("rank").cast("long").alias("rank"))


@query("""WITH q AS (SELECT doc_id AS q, list_distinct(string_split(lower(text), ' ')) AS k FROM documents), e AS (SELECT item_id AS e, list_distinct(string_split(lower(text), ' ')) AS k FROM benchmark),
 qk AS (SELECT q, len(k) AS nq, unnest(k) AS key FROM q), ek AS (SELECT e, len(k) AS ne, unnest(k) AS key FROM e),
 s AS (SELECT q, e, count(*)::DOUBLE / (nq + ne - count(*)) AS score FROM qk JOIN ek USING (key) GROUP BY q, e, nq, ne)
 SELECT q, e, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, e) AS rank FROM s WHERE score >= 0.05) WHERE rank <= 2""")
def exemplar_jaccard_topk(spark, d):
    keys = lambda t, i, n: table(spark, d, t).select(F.col(i).alias(n), F.split(F.lower("text"), " ").alias("keys"))
    out = R.similar_topk(keys("documents", "doc_id", "q"), keys("benchmark", "item_id", "e"), 2, 0.05)
    return out.select("q", "e", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


_PACK = """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS o, CAST(floor(o_totalprice / 400) AS BIGINT) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
 p AS (SELECT c, o, n, t AS payload, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS request FROM o WHERE n = 1
  UNION ALL SELECT o.c, o.o, o.n, CASE WHEN p.k >= 6 OR p.payload + o.t > 2400 THEN o.t ELSE p.payload + o.t END, CASE WHEN p.k >= 6 OR p.payload + o.t > 2400 THEN 1 ELSE p.k + 1 END, CASE WHEN p.k >= 6 OR p.payload + o.t > 2400 THEN p.request + 1 ELSE p.request END
  FROM p JOIN o ON o.c = p.c AND o.n = p.n + 1)"""


def requests(spark, d):
    items = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 400).alias("t"))
    return R.packed(items, ["o_custkey"], "o_orderkey", "t", 2400, 6)


@query(_PACK + " SELECT c AS o_custkey, request, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS items, max(payload) AS payload FROM p GROUP BY 1, 2")
def greedy_pack(spark, d):
    return requests(spark, d).withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query(_PACK + " SELECT count(*) AS requests, CAST(sum(m) AS BIGINT) AS payload_tokens, max(k) AS most_items FROM (SELECT max(payload) AS m, max(k) AS k FROM p GROUP BY c, request)")
def request_payloads(spark, d):
    return requests(spark, d).agg(F.count(F.lit(1)).alias("requests"), F.sum("payload").alias("payload_tokens"), F.max(F.size("items")).cast("long").alias("most_items"))


@query("SELECT o_custkey, string_agg(p, ',' ORDER BY f) AS exemplars FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def request_exemplar_dedupe(spark, d):
    seen = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_distinct(seen), ",").alias("exemplars"))


@query(r"""WITH l AS (SELECT doc_id, unnest(ls) AS t, unnest(range(len(ls))) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM documents))
 SELECT doc_id, header, count(*) AS lines FROM (SELECT doc_id, last_value(CASE WHEN regexp_matches(t, '^[A-E]') THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS header FROM l) WHERE header IS NOT NULL GROUP BY 1, 2""")
def response_block_parse(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "t"))
    rows = R.carried(rows, ["doc_id"], ["n"], F.when(F.col("t").rlike("^[A-E]"), F.col("n").cast("long")))
    return rows.where("header is not null").groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("lines"))


@query("""SELECT event_id, 'rename(' || array_to_string(list_transform(list_sort(list_zip(regexp_extract_all(props, '"(\\w+)": ?"?([^",}]*)', 1), regexp_extract_all(props, '"(\\w+)": ?"?([^",}]*)', 2))), lambda x: x[1] || '=' || x[2]), ' ') || ')' AS rule FROM events""")
def response_kv_params(spark, d):
    pick = lambda i: F.regexp_extract_all("props", F.lit(r'"(\w+)": ?"?([^",}]*)'), F.lit(i))
    return table(spark, d, "events").select("event_id", T.described(F.lit("rename"), F.map_from_arrays(pick(1), pick(2))).alias("rule"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def answers_last_wins(spark, d):
    return R.last_wins(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unrequested_blocks_anti(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_anti").select("doc_id")


@query("SELECT c_custkey, 'no answer' AS warning FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_answers_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("no answer").alias("warning"))


@query("SELECT p_brand, count(*) AS work, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS files, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1")
def rule_fanout_join(spark, d):
    rules = table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_brand")
    work = table(spark, d, "lineitem").join(rules, F.col("l_partkey") == F.col("p_partkey"))
    return work.groupBy("p_brand").agg(F.count(F.lit(1)).alias("work"), F.countDistinct("l_orderkey").alias("files"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, count(o_orderkey) AS work, count(o_orderkey) = 0 AS unchanged FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_passthrough_join(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("work"), (F.count("o_orderkey") == 0).alias("unchanged"))


@query(f"WITH {_FP} SELECT DISTINCT fingerprint FROM fp WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def implicated_clusters_semi(spark, d):
    return printed(spark, d).join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi").select("fingerprint").distinct()


@query("""WITH s AS (SELECT user_id, event_id AS s, event_id + 500 AS e FROM events WHERE event_type = 'purchase')
 SELECT event_id, max(s.s) AS s, max(s.e) AS e FROM events v LEFT JOIN s ON v.user_id = s.user_id AND event_id BETWEEN s.s AND s.e GROUP BY event_id""")
def enclosing_span_range_join(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 500).alias("e"))
    return R.enclosing(e.select("user_id", "event_id"), spans, "user_id", "event_id", "s", "e", 500, "s").select("event_id", "s", "e")


@query(f"WITH {_SITES} SELECT key AS shape, count(*) AS n FROM sites GROUP BY 1")
def unresolved_by_shape(spark, d):
    return sites(spark, d).groupBy(F.col("key").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(a.lang, b.lang) AS lang, coalesce(truth, 0) AS truth, coalesce(found, 0) AS found FROM (SELECT lang, count(*) AS truth FROM documents GROUP BY 1) a FULL JOIN (SELECT CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' und ') THEN 'de' ELSE 'other' END AS lang, count(*) AS found FROM documents GROUP BY 1) b ON a.lang = b.lang")
def ground_truth_full_outer(spark, d):
    docs = table(spark, d, "documents")
    guess = F.when(F.contains("text", F.lit(" the ")), "en").when(F.contains("text", F.lit(" und ")), "de").otherwise("other")
    a, b = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("truth")), docs.groupBy(guess.alias("lang")).agg(F.count(F.lit(1)).alias("found"))
    return a.join(b, "lang", "full_outer").na.fill(0, ["truth", "found"])


@query(f"WITH {_FP} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(DISTINCT doc_id) FROM sites) AS touched, (SELECT count(*) FROM sites) AS sites, count(*) AS hunks, count(DISTINCT fingerprint) AS clusters FROM fp")
def funnel_report(spark, d):
    files = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("files"))
    rest = printed(spark, d).agg(F.countDistinct("doc_id").alias("touched"), F.sum("sites").alias("sites"), F.count(F.lit(1)).alias("hunks"), F.countDistinct("fingerprint").alias("clusters"))
    return files.join(rest)  # one row each


@query("SELECT 'scan' AS stage, doc_id AS ord, 'empty' AS warning FROM documents WHERE length(text) < 50 UNION ALL SELECT 'verify', doc_id, 'toxic' FROM labels WHERE toxic = 1")
def warnings_union(spark, d):
    a = table(spark, d, "documents").where(F.length("text") < 50).select(F.lit("scan").alias("stage"), F.col("doc_id").alias("ord"), F.lit("empty").alias("warning"))
    return a.unionByName(table(spark, d, "labels").where("toxic = 1").select(F.lit("verify").alias("stage"), F.col("doc_id").alias("ord"), F.lit("toxic").alias("warning")))


@query("SELECT doc_id, CAST(quality AS BIGINT) AS answer FROM labels UNION ALL SELECT doc_id, CAST(-1 AS BIGINT) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def answers_upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).cast("long").alias("answer"))
    return R.upsert(old, table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("answer")), ["doc_id"])


@query(f"WITH {_FP} SELECT 'all levers' AS configuration, count(DISTINCT fingerprint) AS asked FROM fp UNION ALL SELECT 'no clustering', count(*) FROM fp UNION ALL SELECT 'no windowing', count(DISTINCT doc_id) FROM fp")
def ablation_levers(spark, d):
    p = printed(spark, d).agg(F.countDistinct("fingerprint").alias("a"), F.count(F.lit(1)).alias("b"), F.countDistinct("doc_id").alias("c"))
    return p.select(F.expr("stack(3, 'all levers', a, 'no clustering', b, 'no windowing', c) as (configuration, asked)"))
