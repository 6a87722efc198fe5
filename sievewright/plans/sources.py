"""Registered queries over source files: a synthetic corpus with one file a customer. Their SQL rebuilds the files and
their answer key from the corpus's arithmetic, and what must become of them by plain text replacement, without a parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, syntax
from ..sources import corpus as C
from ..sources.files import kept
from . import migrate as M
from . import prompts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    """Customers are few bytes and may lie in one row group, which one task would read; ids are dealt out before they
    become files."""
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return C.corpus(ids.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "id"))


def migrated(spark: SparkSession, d: str) -> M.Migration:
    return M.migrate(files(spark, d), answers.Planner())


_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_draw = lambda i, most: f"((id + 1) * 7919 + ({i}) * 104729 + {C.SEED}) * 48271 % {C.MODULUS} % {most}"
#: What each part reads once only its mechanical sites, and once all its sites have moved.
_MECHANICAL = {
    "mechanical_call": [("requests.get(", "httpx.get(")],
    "mechanical_redirect": [("requests.get(", "httpx.get("), ("allow_redirects", "follow_redirects")],
    "mechanical_session": [("requests.Session(", "httpx.Client(")],
    "ambiguous_timeout": [],
    "ambiguous_retry": [("requests.post(", "httpx.post(")],
    "ambiguous_status": [("requests.get(", "httpx.get(")],
    "ambiguous_timeout_interactive": [],
}
_ALL = _MECHANICAL | {
    "ambiguous_timeout": [("requests.get(", "httpx.get("), ("params=wanted)", "params=wanted, timeout=120.0)")],
    "ambiguous_retry": [("requests.post(", "httpx.post("), ("requests.exceptions.ConnectionError", "httpx.ConnectError"), ("requests.exceptions.Timeout", "httpx.TimeoutException")],
    "ambiguous_status": [("requests.get(", "httpx.get("), ("requests.exceptions.HTTPError", "httpx.HTTPStatusError")],
    "ambiguous_timeout_interactive": [("requests.get(", "httpx.get("), ('join(fields)})', 'join(fields)}, timeout=10.0)')],
}


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    return text


def _parts() -> str:
    rows, low = [], 0
    for i, (name, (weight, held)) in enumerate(C.PARTS.items()):
        text = _quoted(C.TEXTS[name])
        texts = ", ".join([text, _replaced(text, _MECHANICAL[name]), _replaced(text, _ALL[name])])
        rows.append(f"SELECT {i} AS part, '{name}' AS name, {low} AS low, {low + weight} AS high, {texts}, {str(name.startswith('ambiguous')).lower()}" + "".join(f", {held.get(s, 0)}" for s in C.SHAPES))
        low += weight
    return " UNION ALL ".join(rows)


_nouns = "[" + ", ".join(f"'{n}'" for n in C.NOUNS) + "]"
_fill = lambda text: f"replace(replace({text}, '{{noun}}', noun), '{{n}}', CAST(i AS VARCHAR))"
_FILES = f"""WITH parts(part, name, low, high, t0, t1, t2, hard, {', '.join(C.SHAPES)}) AS ({_parts()}),
 ids AS (SELECT id, {_nouns}[1 + {_draw(9, len(C.NOUNS))}] AS noun, CASE WHEN {_draw(0, 100)} < {C.UNTOUCHED} THEN 0 ELSE 1 + {_draw(1, 4)} END AS n FROM (SELECT c_custkey AS id FROM customer)),
 picks AS (SELECT id, noun, i, {_draw('i + 2', C.WHOLE)} AS roll FROM (SELECT id, noun, unnest(range(0, n)) AS i FROM ids)),
 held AS (SELECT picks.*, parts.* EXCLUDE (low, high) FROM picks JOIN parts ON roll >= low AND roll < high),
 bodies AS (SELECT id, string_agg({_fill('t0')}, '' ORDER BY i) AS b0, string_agg({_fill('t1')}, '' ORDER BY i) AS b1, string_agg({_fill('t2')}, '' ORDER BY i) AS b2, bool_or(hard) AS hard FROM held GROUP BY id),
 files AS (SELECT ids.id, 'svc/' || noun || '/client_' || CAST(ids.id AS VARCHAR) || '.py' AS path, n, coalesce(hard, false) AS hard,
   CASE WHEN n = 0 THEN replace({_quoted(C.PLAIN)}, '{{noun}}', noun) ELSE replace({_quoted(C.HEADER)}, '{{noun}}', noun) || b0 END AS text,
   CASE WHEN n = 0 THEN replace({_quoted(C.PLAIN)}, '{{noun}}', noun) ELSE replace(CASE WHEN hard THEN {_quoted(C.HEADER)} ELSE replace({_quoted(C.HEADER)}, 'import requests', 'import httpx') END, '{{noun}}', noun) || b1 END AS mechanical,
   CASE WHEN n = 0 THEN replace({_quoted(C.PLAIN)}, '{{noun}}', noun) ELSE replace(replace({_quoted(C.HEADER)}, 'import requests', 'import httpx'), '{{noun}}', noun) || b2 END AS done
   FROM ids LEFT JOIN bodies USING (id)),
 key AS (SELECT path, shape, CAST(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join(f"SELECT id, '{s}' AS shape, {s} AS n FROM held" for s in C.SHAPES)}) JOIN (SELECT id, path FROM files) USING (id) GROUP BY 1, 2 HAVING sum(n) > 0)"""
_MECH = "CAST(coalesce(sum(CASE WHEN shape LIKE 'mechanical%' THEN n END), 0) AS BIGINT)"
_HARD = "CAST(coalesce(sum(CASE WHEN shape LIKE 'ambiguous%' THEN n END), 0) AS BIGINT)"


@query(_FILES + " SELECT path, md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM files")
def corpus_files(spark, d):
    return files(spark, d).select("path", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


@query(_FILES + " SELECT path, shape, n FROM key")
def corpus_answer_key(spark, d):
    return files(spark, d).select("path", F.explode("shapes").alias("shape", "n")).select("path", "shape", F.col("n").cast("long").alias("n"))


@query(_FILES + f" SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE n > 0) AS touched, (SELECT count(*) FROM files WHERE hard) AS needing_model, {_MECH} AS mechanical, {_HARD} AS ambiguous, {_MECH} + {_HARD} AS sites FROM key")
def corpus_stats(spark, d):
    return C.stats(files(spark, d))


@query(_FILES + " SELECT path, shape, n, shape LIKE 'mechanical%' AS resolved FROM key")
def scan_sites(spark, d):
    """What the parser finds, against the answer key."""
    return syntax.findings(files(spark, d)).groupBy("path", "shape", "resolved").agg(F.count(F.lit(1)).alias("n"))


@query(_FILES + " SELECT path, md5(mechanical) AS digest FROM files")
def codemod_texts(spark, d):
    return syntax.rewritten(files(spark, d)).select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(_FILES + f" SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE text <> mechanical) AS files_changed, (SELECT count(*) FROM files WHERE text <> mechanical AND NOT hard) AS files_fully_resolved, (SELECT count(*) FROM files WHERE hard) AS files_needing_model, {_MECH} AS resolved_sites, {_HARD} AS unresolved_sites, CAST(0 AS BIGINT) AS errors FROM key")
def codemod_summary(spark, d):
    return syntax.summary(syntax.codemod(files(spark, d)))


_HUNKS = f"""{_FILES}, ls AS (SELECT path, unnest(string_split(left(mechanical, length(mechanical) - 1), chr(10))) AS t, unnest(range(1, len(string_split(left(mechanical, length(mechanical) - 1), chr(10))) + 1)) AS line, len(string_split(left(mechanical, length(mechanical) - 1), chr(10))) AS total FROM files WHERE hard),
 defs AS (SELECT *, max(CASE WHEN prefix(t, 'def ') THEN line END) OVER (PARTITION BY path ORDER BY line) AS def_line FROM ls),
 w AS (SELECT path, line, def_line, greatest(1, line - {M.CONTEXT}) AS s, least(total, line + {M.CONTEXT}) AS e0 FROM defs WHERE contains(t, 'requests.get(') OR contains(t, 'except requests.')),
 x AS (SELECT w.*, CASE WHEN contains(t, 'except ') THEN least(total, last_line + {M.CONTEXT}) ELSE e0 END AS e FROM w JOIN (SELECT path, line, t, total, line + CASE WHEN contains(t, 'HTTPError') THEN 2 ELSE 1 END AS last_line FROM ls) USING (path, line)),
 r AS (SELECT *, sum(c) OVER (PARTITION BY path ORDER BY s, e, line) AS run FROM (SELECT *, CASE WHEN def_line = lag(def_line) OVER (PARTITION BY path ORDER BY s, e, line) THEN 0 ELSE 1 END AS c FROM x)),
 b AS (SELECT *, max(e) OVER (PARTITION BY path, run ORDER BY s, e, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
 i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path, run ORDER BY s, e, line) AS isl FROM b),
 h AS (SELECT path, CAST(min(s) AS BIGINT) AS first, CAST(max(e) AS BIGINT) AS last, count(*) AS sites, min(def_line) AS def_line FROM i GROUP BY path, run, isl),
 hunks AS (SELECT h.path, first, last, sites, CASE WHEN def_line < first AND NOT list_bool_or(list_transform(string_split(left(mechanical, length(mechanical) - 1), chr(10))[first:last], lambda q: prefix(ltrim(q), 'def '))) THEN string_split(left(mechanical, length(mechanical) - 1), chr(10))[def_line] END AS enclosing,
   greatest(1, CAST(floor(length(array_to_string(string_split(left(mechanical, length(mechanical) - 1), chr(10))[first:last], chr(10))) / 3.4::DOUBLE) AS BIGINT)) AS token_cost FROM h JOIN files ON files.path = h.path)"""


@query(_HUNKS + f" SELECT path, first, last, sites, enclosing, token_cost, token_cost > {M.OVERSIZED} AS oversized FROM hunks")
def source_hunks(spark, d):
    done = kept(syntax.codemod(files(spark, d)).where("n_unresolved > 0").select("path", "text", "found", "error"), "scanned")
    rows = M.hunks(syntax.sites(done), done)
    return rows.select("path", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("last"), F.size("site_lines").cast("long").alias("sites"), "enclosing", "token_cost", "oversized")


@query(_FILES + " SELECT path, md5(done) AS digest, n > 0 AS changed, true AS verified FROM files")
def migration_texts(spark, d):
    """The whole migration, file by file."""
    return migrated(spark, d).output.select("path", F.md5(F.col("text").cast("binary")).alias("digest"), "changed", (F.size("failures") == 0).alias("verified"))


_CLUSTERS = f"SELECT name, count(*) AS n, CAST(ceil(count(*) / {M.MEMBERS}) AS BIGINT) AS shards FROM held WHERE hard GROUP BY name"


@query(_FILES + f""", c AS ({_CLUSTERS}) SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE n > 0) AS touched, (SELECT count(*) FROM files WHERE n > 0) AS migrated,
 {_MECH} + {_HARD} AS sites, {_MECH} AS sites_by_codemod, {_HARD} AS sites_by_model, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS hunks, (SELECT CAST(sum(shards) AS BIGINT) FROM c) AS clusters,
 CAST(0 AS BIGINT) AS declined, CAST(0 AS BIGINT) AS escalations, CAST(0 AS BIGINT) AS unverified FROM key""")
def migration_report(spark, d):
    row = M.report(migrated(spark, d))
    return row.select("files", "touched", "migrated", "sites", "sites_by_codemod", "sites_by_model", "hunks", "clusters", F.col("declined").cast("long").alias("declined"), F.col("escalations").cast("long").alias("escalations"), "unverified")


@query(_FILES + f", c AS ({_CLUSTERS}) SELECT substr(name, 1, 17) AS shape, CAST(least({M.MEMBERS}, n - s * {M.MEMBERS}) AS BIGINT) AS size FROM (SELECT name, n, unnest(range(0, shards)) AS s FROM c)")
def migration_clusters(spark, d):
    """The model's answers change no cluster, so it is not asked."""
    return M.gathered(files(spark, d)).clusters.select(F.substring(F.col("shapes")[0], 1, 17).alias("shape"), "size")


_naive_tokens = lambda text: f"greatest(1, CAST(floor(length({text}) / 3.4::DOUBLE) AS BIGINT))"


@query(_FILES + f""", u AS (SELECT {_naive_tokens(_quoted(prompts.NAIVE_SYSTEM))} + {_naive_tokens("'File ' || path || chr(10) || chr(10) || text || chr(10) || chr(10) || " + _quoted(prompts.NAIVE_CLOSING))} AS i, {_naive_tokens('text')} AS o FROM files WHERE contains(text, 'requests'))
 SELECT count(*) AS requests, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cached_tokens, round(sum(i * 2.5 + o * 10)::DOUBLE / 1e6, 4) AS cost, CAST(sum(i + o) AS BIGINT) AS total_tokens FROM u""")
def naive_ledger(spark, d):
    return M.ledger(M.naive(files(spark, d)))


@query()
def migration_comparison(spark, d):
    """Against whole files as the scan's table holds them, so that the corpus is not made again."""
    done = migrated(spark, d)
    return M.comparison(done.codemod.select("path", F.col("original").alias("text")), done)


@query()
def migration_ablation(spark, d):
    """Over the fixed 120 files that the published figures are about."""
    return M.ablation(C.built(spark), answers.Planner())


@query()
def migration_rules(spark, d):
    return migrated(spark, d).rules().select("fingerprint", F.array_join("rules", "; ").alias("rules"))
