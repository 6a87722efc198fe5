"""URL filter: host and path rules first, else a weighted vocabulary matched by one Aho-Corasick automaton.

A vocabulary term counts once, and only where no ASCII letter or digit stands directly before or after it in the folded
URL. Weights of the different terms found add up; from 1 on the URL is blocked: one strict term (weight 1) does, or
several soft ones. A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
rule's; the longest fitting rule (host and path together; ties by code point) wins over the vocabulary. Hosts, paths and
rules are native columns; only folded URLs go to Python, those without a rule.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; a null URL is allowed. Only
the key and URL columns are read, whatever others there are; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow

#: Fixed values of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Strict terms have weight 1, soft ones a half.
STRICT = ["porn", "xxx", "casino", "malware", "phishing", "viagra", "warez", "torrent"]
SOFT = ["adult", "bet", "bonus", "cheap", "click", "coupon", "crack", "dating", "escort", "free", "gambling", "keygen", "loan", "lottery", "nude", "poker", "promo", "sex", "slots", "win"]
VOCABULARY = dict.fromkeys(STRICT, 1.0) | dict.fromkeys(SOFT, 0.5)

_LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def automaton(vocabulary: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def weight(text: str, found) -> float:
    """Weight of the different terms in a folded URL."""
    own = {}
    for end, (term, w) in found.iter(text) if len(found) else ():
        first = end - len(term) + 1
        if not (first and text[first - 1] in _LETTERS) and not (end + 1 < len(text) and text[end + 1] in _LETTERS):
            own[term] = w
    return sum(own.values())


def folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def split(url: Column) -> tuple[Column, Column]:
    """Host, folded, and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return folded(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The winning rule (length, name, verdict), or null. A host looks up itself and each parent domain in a map of the
    rules by host, so their number costs little."""
    by_host: dict[str, list[Column]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(p).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string,path:string>")
    table = F.create_map(*(x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(fits, lambda r: path.startswith(r["path"])))


def judged(pages: DataFrame, rules=RULES, vocabulary: dict[str, float] = VOCABULARY) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    url = F.col("url").cast("string")
    host, path = split(F.coalesce(url, F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), url.alias("url"))
    best = ruled(F.col("host"), F.col("path"), list(rules))
    rows = rows.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), folded("url").alias("url"))
    rows = rows.withColumn("url", F.when(F.col("rule").isNull(), F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(vocabulary)
        for b in batches:
            told = [own or ("block" if weight(text or "", found) >= 1 else "allow") for own, text in zip(b.column("verdict").to_pylist(), b.column("url").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(told, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return in_arrow(rows, run, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fold = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END"
    rules = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in RULES)
    return f"""
WITH a AS (
  SELECT page_id, {fold} AS u, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a
), r AS ({rules}), fit AS (
  SELECT DISTINCT host, path, first_value(rh || rp) OVER w AS rule, first_value(rv) OVER w AS rv
  FROM (SELECT DISTINCT host, path FROM b) JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp)
  WINDOW w AS (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rh || rp DESC)
)
SELECT page_id, b.host, b.path, rule, coalesce(rv, CASE WHEN {' + '.join(map(hit, STRICT))} > 0 OR {' + '.join(map(hit, SOFT))} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN fit ON b.host = fit.host AND b.path = fit.path
"""


SQL = _sql()
