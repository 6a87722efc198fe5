"""The migration: settle what is mechanical, ask a model once a cluster, replay its rules everywhere, verify, ask
again about what failed. One DAG a stage; every stage's result is a table in the shared folder. What depends on a text
alone is found once for equal texts and told to all files that hold it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import relational as R
from ..operators import rules, syntax
from ..sources.files import kept
from . import prompts

#: Lines around a site, tokens and clusters of a request, samples and members of a cluster, tokens above
#: which a hunk is reported, and how many examples of which similarity and length a cluster may show.
CONTEXT, PAYLOAD, ITEMS, SHOWN, MEMBERS, OVERSIZED = 6, 2400, 6, 2, 40, 400
EXAMPLES, SIMILAR, EXAMPLE_TOKENS = 2, 0.25, 200
#: Clusters that one task packs in sequence; more are cut by range of their order.
LANE = 100_000


@dataclass
class Levers:
    """Steps that can be left out, to see what each is worth."""

    deterministic: bool = True
    windowing: bool = True
    clustering: bool = True
    packing: bool = True
    exemplars: bool = True


@dataclass
class Migration:
    codemod: DataFrame  # path, key (of the original), original, text, n_resolved, n_unresolved, error, found
    hunks: DataFrame
    clusters: DataFrame  # fingerprint, shapes, size, body, examples, token_cost
    members: DataFrame  # fingerprint, path, start, site_lines
    answers: DataFrame
    usage: DataFrame  # request_id, attempt, model, input_tokens, output_tokens, prefix_cached_tokens
    told: list[DataFrame]  # warnings of all stages before the replay
    first: DataFrame  # the first model's answers
    escalations: int
    rounds: int
    final: bool  # no model is left to ask
    replay: Callable[[], DataFrame]

    @cached_property
    def output(self) -> DataFrame:
        """path, text, changed, errors, failures, warnings of every file; made when first asked for."""
        return self.replay()

    @cached_property
    def declined(self) -> int:
        """How many clusters the first model declined."""
        return self.first.where(F.coalesce("escalate", F.lit("")) != "").count()

    @cached_property
    def warnings(self) -> DataFrame:
        """stage, path, warning."""
        rows = [*self.told, _warned(self.output.select("path", F.explode("errors").alias("e")), "apply", F.col("e"))]
        if self.final:
            rows.append(_warned(self.unverified(), "escalate", F.lit("unverified, and there is no model left to ask")))
        return reduce(DataFrame.unionByName, rows)

    def unverified(self) -> DataFrame:
        return self.output.where(F.size("failures") > 0).select("path", "failures")

    def rules(self) -> DataFrame:
        """The rules applied, by fingerprint."""
        told = F.transform("rules", lambda r: T.described(r["action"], r["params"]))
        return self.answers.where(F.coalesce("escalate", F.lit("")) == "").select("fingerprint", told.alias("rules")).orderBy("fingerprint")


def _warned(rows: DataFrame, stage: str, text: Column) -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), "path", text.alias("warning"))


def hunks(findings: DataFrame, files: DataFrame, windowing: bool = True) -> DataFrame:
    """(path, start, end, shapes, reasons, signature, site_lines, enclosing, code, token_cost, oversized): open sites that
    lie together in one function. The line that defines the function is shown where the window holds no definition.
    Without windowing a file is one hunk, never oversized."""
    return coded(windows(findings, files, windowing))


def coded(rows: DataFrame) -> DataFrame:
    """windows() with their code, headed by path and lines, in place of what is shown of their text."""
    head = F.concat(F.lit("--- "), "path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return rows.withColumn("code", F.concat_ws("\n", head, "shown")).drop("shown")


def windows(findings: DataFrame, files: DataFrame, windowing: bool) -> DataFrame:
    """hunks() without code but with ``shown``, which like the rest depends on the file's text alone."""
    total = files.select("path", F.size(T.source_lines(F.col("text"))).alias("total"))
    spans = findings.where("not resolved").join(total, "path")
    cut = (F.greatest(F.lit(1), F.col("line") - CONTEXT), F.least("total", F.col("end_line") + CONTEXT)) if windowing else (F.lit(1), F.col("total"))
    spans = R.islands(spans.withColumn("start", cut[0]).withColumn("end", cut[1]), ["path"], "start", "end", "def_line" if windowing else None, ["finding_ord"])
    rows = F.array_sort(F.collect_list(F.struct("finding_ord", "shape", "reason", "signature", "line", "def_line")))
    out = spans.groupBy("path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), rows.alias("f"))
    each = lambda name: F.transform("f", lambda x: x[name])
    out = out.select("path", "start", "end", each("shape").alias("shapes"), F.array_distinct(each("reason")).alias("reasons"), F.flatten(each("signature")).alias("signature"), F.sort_array(each("line")).alias("site_lines"), F.col("f")[0]["def_line"].alias("def_line"))
    lines = T.source_lines(F.col("text"))
    out = out.join(files.select("path", "text"), "path").withColumn("window", F.slice(lines, F.col("start"), F.col("end") - F.col("start") + 1))
    hidden = (F.col("def_line") > 0) & (F.col("def_line") < F.col("start")) & ~F.exists("window", lambda x: F.ltrim(x).startswith("def "))
    out = out.withColumn("enclosing", F.when(hidden if windowing else F.lit(False), F.trim(F.get(lines, F.col("def_line") - 1))))
    shown = F.concat_ws("\n", F.concat(F.lit("     | (in) "), "enclosing"), T.rendered(F.col("window"), F.col("start")))
    out = out.withColumn("shown", shown).withColumn("token_cost", T.tokens(F.array_join("window", "\n")))
    return out.withColumn("oversized", (F.col("token_cost") > OVERSIZED) & F.lit(windowing)).drop("text", "window", "def_line")


def texts_hunks(files: DataFrame, texts: DataFrame, findings: Callable[[DataFrame], DataFrame], windowing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, hunks): texts (key, text, found, error) with open sites are cut into windows, each with ``hunk``, an id; all
    files (path, key) that hold a text get its windows."""
    one = texts.withColumnRenamed("key", "path")
    cut = kept(windows(findings(one), one, windowing).withColumnRenamed("path", "key").withColumn("hunk", F.monotonically_increasing_id()), "hunks")
    return files.join(cut, "key").drop("key"), cut


def clustered(rows: DataFrame, texts: DataFrame, levers: Levers = Levers()) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of texts_hunks(): hunks of one fingerprint, at most MEMBERS of them, so that no answer reaches
    further; a larger group becomes numbered clusters. A cluster shows its cheapest members and, as examples, the approved
    decisions most similar to all its members' shapes and signatures. No code takes part before it is shown."""
    named = T.fingerprint(F.col("shapes"), F.col("signature"))
    named = named if levers.clustering else F.concat(F.lit("solo-"), F.substring(F.md5(F.concat_ws("|", "path", F.col("start").cast("string"))), 1, 12))
    rows = rows.select("path", "start", "end", "site_lines", "shapes", "signature", "token_cost", "hunk", named.alias("fingerprint"))
    rows = R.sharded(rows, "fingerprint", ["path", "start", "end", "site_lines"], MEMBERS)
    rows = kept(rows.withColumn("fingerprint", F.col("shard")).drop("shard"), "members")
    shown = R.first_k(rows.select("fingerprint", "token_cost", "path", "start", "end", "hunk"), ["fingerprint"], ["token_cost", "path", "start"], SHOWN)
    shown = coded(shown.join(texts.select("hunk", "reasons", "shown"), "hunk"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    bodies = shown.groupBy("fingerprint").agg(F.array_join(in_order("code"), "\n").alias("code"), F.array_join(F.array_distinct(F.flatten(in_order("reasons"))), "; ").alias("reasons"))
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat("shapes", "signature"))))).alias("keys")
    sizes = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.array_distinct("shapes"), F.struct("path", "start")).alias("shapes"), keys)
    head = F.concat_ws("\n", F.concat(F.lit("CLUSTER "), "fingerprint"), F.concat(F.lit("SHAPES "), F.array_join("shapes", " ")), F.concat(F.lit("MEMBERS "), F.col("size").cast("string")), F.concat(F.lit("WHY "), "reasons"), "code")
    clusters = sizes.join(bodies, "fingerprint").withColumn("body", head)
    told = examples(clusters.select("fingerprint", "keys")) if levers.exemplars else clusters.select("fingerprint", F.expr("cast(array() as array<string>)").alias("examples"))
    clusters = clusters.join(told, "fingerprint", "left").withColumn("examples", F.coalesce("examples", F.expr("cast(array() as array<string>)")))
    cost = T.tokens(F.col("body")) + T.tokens_all(F.col("examples"))
    return kept(clusters.select("fingerprint", "shapes", "size", "body", "examples", cost.alias("token_cost")), "clusters"), rows.select("fingerprint", "path", "start", "site_lines")


def library(spark: SparkSession) -> DataFrame:
    """Approved decisions: keys, code, answer, shown (the text a request holds), token_cost."""
    rows = [F.struct(F.array(*map(F.lit, keys)).alias("keys"), F.lit(code).alias("code"), F.lit(answer).alias("answer")) for keys, code, answer in prompts.LIBRARY]
    rows = spark.range(1).select(F.inline(F.array(*rows)))
    return rows.withColumn("shown", F.concat_ws("\n", F.lit("EXAMPLE"), "code", "answer")).withColumn("token_cost", T.tokens(F.col("shown")))


def examples(clusters: DataFrame) -> DataFrame:
    """clusters (fingerprint, keys): each one's examples, the most similar first, where any is similar enough."""
    short = library(clusters.sparkSession).where(F.col("token_cost") <= EXAMPLE_TOKENS)
    best = R.similar_topk(clusters.select(F.col("fingerprint").alias("q"), "keys"), short.select(F.struct("code", "shown").alias("e"), "keys"), EXAMPLES, SIMILAR)
    return best.groupBy(F.col("q").alias("fingerprint")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda x: x["e"]["shown"]).alias("examples"))


def requests_of(clusters: DataFrame, packing: bool = True) -> DataFrame:
    """(request_id, expected, text): clusters, the largest first, packed greedily; an example stands once a request."""
    n = clusters.count()
    order = [F.desc("size"), F.col("fingerprint")]
    if n > LANE:
        items = kept(clusters.repartitionByRange(-(-n // LANE), *order).withColumn("lane", F.spark_partition_id()), "items")
    else:
        items = clusters.withColumn("lane", F.lit(0))
    named = items.withColumn("key", F.struct((-F.col("size")).alias("least"), "fingerprint"))
    packs = R.packed(named, ["lane"], "key", "token_cost", PAYLOAD, ITEMS if packing else 1)
    ids = packs.select("lane", "request", F.posexplode("items").alias("n", "key")).withColumn("fingerprint", F.col("key.fingerprint"))
    rows = F.array_sort(F.collect_list(F.struct("n", "fingerprint", "body", "examples")))
    out = ids.join(items.select("fingerprint", "body", "examples"), "fingerprint").groupBy((F.col("lane") * F.lit(1 << 32) + F.col("request")).alias("request_id")).agg(rows.alias("b"))
    each = lambda c: F.transform("b", lambda x: x[c])
    shown = F.array_distinct(F.flatten(each("examples")))
    return out.select("request_id", each("fingerprint").alias("expected"), F.array_join(F.concat(shown, each("body"), F.array(F.lit(prompts.CLOSING))), "\n\n").alias("text"))


def ask(clusters: DataFrame, model: A.Model, name: str, attempt: int, packing: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, usage, warnings). A model instance pays the fixed part of a request once in full. Usage and warnings are
    made from the table of responses when they are asked for."""
    requests = kept(spread(requests_of(clusters, packing), "request_id"), "requests")
    said = requests.select("request_id", "expected", F.col("text").alias("asked")).join(model.complete(requests.select("request_id", "text")), "request_id", "left").fillna("", ["text"])
    said = kept(said, "responses")
    fixed = T.tokens(F.lit(prompts.SYSTEM))
    first = said.agg(F.min("request_id").alias("first"))
    usage = said.join(F.broadcast(first)).select(
        "request_id",
        F.lit(attempt).alias("attempt"),
        F.lit(name).alias("model"),
        (fixed + T.tokens(F.col("asked"))).alias("input_tokens"),
        T.tokens(F.col("text")).alias("output_tokens"),
        F.when((F.col("request_id") == F.col("first")) & F.lit(attempt <= 1), F.lit(0)).otherwise(fixed).cast("long").alias("prefix_cached_tokens"),
    )
    answers, warnings = A.parsed(said.drop("asked"))
    return kept(answers, "answers"), usage, warnings.select(F.lit("answer").alias("stage"), F.lit(None).cast("string").alias("path"), "warning")


def replayed(files: DataFrame, members: DataFrame, answers: DataFrame) -> DataFrame:
    """Every rule on every member of its cluster, verified. An answer that escalates is not applied, whatever rules it has."""
    told = answers.where((F.size("rules") > 0) & (F.coalesce("escalate", F.lit("")) == ""))
    work = members.join(told.select("fingerprint", "rules"), "fingerprint")
    return rules.migrated(files, work.select("path", F.struct("start", "fingerprint").alias("batch_ord"), F.col("site_lines").alias("lines"), "rules"))


@dataclass
class Asked:
    """What is known before any model is asked; the columns are Migration's."""

    codemod: DataFrame
    hunks: DataFrame
    clusters: DataFrame
    members: DataFrame
    told: list[DataFrame]


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows that are few bytes but much work, dealt out to all tasks, which Spark would join into few."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), by)


def scanned(files: DataFrame, deterministic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): files (path, text) are read once, into a table; rows are path and key, texts what codemod() says of
    each text, by key. Each text is parsed once in all."""
    own = kept(files.select("path", T.named("text").alias("key"), "text"), "files")
    different = spread(own.select("key", "text").distinct(), "key")
    return own.select("path", "key"), kept(syntax.codemod(different.withColumnRenamed("key", "path"), deterministic).withColumnRenamed("path", "key"), "codemod")


def gathered(files: DataFrame, levers: Levers = Levers()) -> Asked:
    """The stages before the model: files (path, text) scanned, open sites cut into hunks, hunks clustered."""
    own, texts = scanned(files, levers.deterministic)
    base = own.join(texts, "key").select("path", "key", "original", "text", "n_resolved", "n_unresolved", "error", "found")

    def found(rows: DataFrame) -> DataFrame:
        rows = syntax.sites(rows)
        return rows if levers.deterministic else rows.withColumn("resolved", F.col("error").isNotNull())

    rows, cut = texts_hunks(own, texts.where("n_unresolved > 0").select("key", "text", "found", "error"), found, levers.windowing)
    clusters, members = clustered(rows, cut, levers)
    large = F.concat(F.lit("lines "), F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string"), F.lit(" cost "), F.col("token_cost").cast("string"), F.lit(" tokens"))
    warnings = [_warned(base.where("error is not null"), "scan", F.col("error")), _warned(rows.where("oversized"), "hunk", large)]
    return Asked(base, coded(rows).drop("hunk"), clusters, members, warnings)


def migrate(files: DataFrame, model: A.Model, strong: A.Model | None = None, attempts: int = 1, levers: Levers = Levers()) -> Migration:
    """files (path, text), paths unique. With a strong model, clusters that have a member in an unverified file are asked
    again, at most ``attempts`` times; new answers replace old ones and all rules run anew on the mechanical result."""
    own = gathered(files, levers)
    clusters, members = own.clusters, own.members
    texts = own.codemod.withColumn("n_found", F.col("n_resolved") + F.col("n_unresolved"))
    answers, usage, told = ask(clusters, model, "cheap", 0, levers.packing)
    first, warnings = answers, [*own.told, told]
    output, rounds, escalations, ledgers = None, 0, 0, [usage]
    while strong and rounds < attempts:
        output = replayed(texts, members, answers) if output is None else output
        failed = output.where(F.size("failures") > 0).select("path")
        again = kept(clusters.join(members.join(failed, "path").select("fingerprint").distinct(), "fingerprint"), "implicated")
        if again.isEmpty():
            break
        new, usage, told = ask(again, strong, "strong", rounds + 1, levers.packing)
        ledgers.append(usage)
        warnings.append(told)
        escalations += new.count()
        answers, rounds, output = kept(R.upsert(answers, new, ["fingerprint"]), "answers"), rounds + 1, None
    replay = lambda: replayed(texts, members, answers) if output is None else output
    return Migration(own.codemod, own.hunks, clusters, members, answers, reduce(DataFrame.unionByName, ledgers), warnings, first, escalations, rounds, not strong, replay)


def ledger(usage: DataFrame) -> DataFrame:
    """One row: requests, tokens and cost of a usage table; a cached prefix costs half."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    each: Column = T.cost(F.col("input_tokens") - F.col("prefix_cached_tokens"), F.col("output_tokens"), F.col("prefix_cached_tokens"), F.col("model") == "strong")
    out = usage.agg(F.count(F.lit(1)).alias("requests"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("prefix_cached_tokens").alias("cached_tokens"), F.round(F.coalesce(F.sum(each), F.lit(0.0)), 4).alias("cost"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def report(done: Migration) -> DataFrame:
    """One row of counters, the ledger's among them."""
    n_found = F.col("n_resolved") + F.col("n_unresolved")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    scan = done.codemod.agg(F.count(F.lit(1)).alias("files"), F.count_if(n_found > 0).alias("touched"), total(n_found).alias("sites"), total(F.col("n_resolved")).alias("sites_by_codemod"), total(F.col("n_unresolved")).alias("sites_by_model"))
    parts = [
        done.output.agg(F.count_if(F.col("changed")).alias("migrated"), F.count_if(F.size("failures") > 0).alias("unverified")),
        done.hunks.agg(F.count(F.lit(1)).alias("hunks")),
        done.clusters.agg(F.count(F.lit(1)).alias("clusters")),
        ledger(done.usage),
    ]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), parts, scan)  # one row each
    return row.withColumn("declined", F.lit(done.declined)).withColumn("escalations", F.lit(done.escalations))


def naive(files: DataFrame) -> DataFrame:
    """The usage of whole files in and out, for files that name the old library anywhere."""
    asked = F.concat(F.lit("File "), "path", F.lit("\n\n"), "text", F.lit("\n\n" + prompts.NAIVE_CLOSING))
    rows = files.where(F.contains("text", F.lit("requests")))
    return rows.select(F.col("path"), F.lit(0).alias("attempt"), F.lit("strong").alias("model"), (T.tokens(F.lit(prompts.NAIVE_SYSTEM)) + T.tokens(asked)).alias("input_tokens"), T.tokens(F.col("text")).alias("output_tokens"), F.lit(0).cast("long").alias("prefix_cached_tokens"))


def comparison(files: DataFrame, done: Migration) -> DataFrame:
    """One row a measure: whole files against the migration, and the share saved in per cent."""
    both = ledger(naive(files)).withColumn("run", F.lit("naive")).unionByName(ledger(done.usage).withColumn("run", F.lit("migration")))
    measures = ["requests", "input_tokens", "output_tokens", "total_tokens", "cost"]
    long = both.select("run", F.explode(F.map_from_arrays(F.array(*map(F.lit, measures)), F.array(*[F.col(c).cast("double") for c in measures]))).alias("measure", "value"))
    return long.groupBy("measure").agg(F.max(F.when(F.col("run") == "naive", F.col("value"))).alias("naive"), F.max(F.when(F.col("run") == "migration", F.col("value"))).alias("migration")).withColumn("saved", T.saved(F.col("naive"), F.col("migration")))


#: One lever off at a time.
ABLATIONS = {
    "all levers": Levers(),
    "no deterministic pass": Levers(deterministic=False),
    "no windowing": Levers(windowing=False),
    "no clustering": Levers(clustering=False),
    "no packing": Levers(packing=False),
    "no exemplars": Levers(exemplars=False),
}


def ablation(files: DataFrame, model: A.Model, configurations: dict[str, Levers] = ABLATIONS) -> DataFrame:
    """A row a configuration: tokens, requests, clusters, files left unverified, clusters declined."""
    rows = [report(migrate(files, model, levers=levers)).select(F.lit(name).alias("configuration"), "total_tokens", "requests", "clusters", "unverified", "declined") for name, levers in configurations.items()]
    return reduce(DataFrame.unionByName, rows)
