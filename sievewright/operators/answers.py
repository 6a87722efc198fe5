"""The model seam: request texts in, answers out, and a strict parser of what comes back. Native columns throughout.

An answer is lines: `CLUSTER <name>` opens a block, `ACTION <name> k=v ...`, `NOTE <text>` and `ESCALATE <reason>` belong
to it. Nothing a model says is trusted: blocks nobody asked for and unknown actions go, with a warning each.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import relational as R
from .rules import ACTIONS
from .syntax import EXCEPTIONS

#: Seconds the planner gives batch and interactive calls.
BATCH_TIMEOUT, INTERACTIVE_TIMEOUT = "120.0", "10.0"
#: Fixed: the line format that requests ask for.
HEAD = r"^CLUSTER\s+(\S+)\s*$"


class Model(Protocol):
    """requests (request_id, text) to responses (request_id, text)."""

    def complete(self, requests: DataFrame) -> DataFrame: ...


def _blocks(texts: DataFrame, *keep: str) -> DataFrame:
    """(request_id, keep, block, n, line): trimmed lines with text, under the block whose header stands at line ``block``."""
    rows = texts.select("request_id", *keep, F.posexplode(T.lines(F.col("text"))).alias("n", "raw")).select("*", F.trim("raw").alias("line")).where("line != ''")
    return R.carried(rows, ["request_id"], ["n"], F.when(F.col("line").rlike(HEAD), F.col("n")), "block").where("block is not null").drop("raw")


class Planner:
    """Answers by fixed rules: a timeout by the kind of function, each known exception by its counterpart, else it declines.
    A request is cut before its header lines, as the parser knows them; no line of it becomes a row."""

    def complete(self, requests: DataFrame) -> DataFrame:
        head = r"^ *CLUSTER[^\S\n]+\S+[^\S\n]*$"
        pieces = F.split(F.regexp_replace("text", r"\r\n?", "\n"), f"(?dm)(?={head})")
        blocks = requests.select("request_id", F.posexplode_outer(pieces).alias("block", "body")).where(F.col("body").rlike(rf"(?dm)\A{head}"))
        has = lambda word: F.contains("body", F.lit(word))
        batch = T.looks_batch(F.col("body"))
        said = [F.when(has("ambiguous_timeout"), F.concat(F.lit("ACTION set_timeout value="), F.when(batch, BATCH_TIMEOUT).otherwise(INTERACTIVE_TIMEOUT)))]
        said += [F.when(has(old), F.lit(f"ACTION map_exception from={old} to={new}")) for old, new in sorted(EXCEPTIONS.items())]
        actions = F.array_compact(F.array(*said))
        note = F.when(has("ambiguous_timeout"), F.when(batch, "NOTE a batch may wait, but not for ever").otherwise("NOTE short, so that no worker hangs")).otherwise("NOTE the closest new exception")
        rest = F.when(F.size(actions) == 0, F.array(F.lit("ESCALATE no action fits"))).otherwise(F.concat(actions, F.array(note)))
        answer = F.concat(F.lit("CLUSTER "), F.regexp_extract("body", r"CLUSTER\s+(\S+)", 1), F.lit("\n"), F.array_join(rest, "\n"))
        out = blocks.select("request_id", "block", answer.alias("answer")).groupBy("request_id")
        return out.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "answer"))), lambda x: x["answer"]), "\n\n").alias("text"))


class Scripted:
    """Canned replies for requests 0, 1, ... over all calls; empty when they run out."""

    def __init__(self, replies: Sequence[str]):
        self.replies = list(replies)

    def complete(self, requests: DataFrame) -> DataFrame:
        canned = F.array(*map(F.lit, self.replies)) if self.replies else F.expr("cast(array() as array<string>)")
        return requests.select("request_id", F.coalesce(F.try_element_at(canned, F.col("request_id").cast("int") + 1), F.lit("")).alias("text"))


def parsed(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses (request_id, expected, text) to answers (request_id, fingerprint, rules, note, escalate) and warnings
    (request_id, warning). The last block of a cluster wins, as does the last value of a parameter."""
    rows = _blocks(responses, "expected").withColumn("kind", F.regexp_extract("line", r"^(ACTION\s+\w|NOTE\s|ESCALATE\s)", 1))
    rows = rows.withColumn("kind", F.when(F.col("n") == F.col("block"), "head").otherwise(F.regexp_extract("kind", r"^([A-Z]+)", 1)))
    rest = F.trim(F.regexp_extract("line", r"^ACTION\s+\w+\s*(.*)$", 1))
    pick = lambda i: F.regexp_extract_all("rest", F.lit(r"(\w+)=(\S+)"), F.lit(i))
    rows = rows.withColumn("rest", rest).withColumn("keys", pick(1)).withColumn("pairs", F.arrays_zip("keys", pick(2).alias("vals")))
    last = F.filter("pairs", lambda x, i: ~F.array_contains(F.slice("keys", i + 2, F.size("keys") + 1), x["keys"]))
    rows = rows.withColumn("params", F.map_from_arrays(F.transform(last, lambda x: x["keys"]), F.transform(last, lambda x: x["vals"])))
    action, is_action = F.regexp_extract("line", r"^ACTION\s+(\w+)", 1), F.col("kind") == "ACTION"
    rows = rows.withColumn("action", action).withColumn("known", is_action & F.col("action").isin(*ACTIONS))
    after = lambda word: F.trim(F.regexp_extract("line", rf"^{word}\s+(.*)$", 1))
    latest = lambda word: F.max_by(F.when(F.col("kind") == word, after(word)), F.when(F.col("kind") == word, F.col("n")))
    rules = F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("n", "action", F.map_entries("params").alias("params"))))), lambda x: F.struct(x["action"].alias("action"), F.map_from_entries(x["params"]).alias("params")))
    named = F.max(F.when(F.col("kind") == "head", F.regexp_extract("line", HEAD, 1)))
    blocks = rows.groupBy("request_id", "block").agg(F.first("expected").alias("expected"), named.alias("fingerprint"), rules.alias("rules"), latest("NOTE").alias("note"), latest("ESCALATE").alias("escalate"))
    wanted = F.array_contains("expected", F.col("fingerprint"))
    answers = R.last_wins(blocks.where(wanted), ["request_id", "fingerprint"], [F.desc("block")]).drop("block", "expected")
    warn = lambda d, *parts: d.select("request_id", F.concat(*parts).alias("warning"))
    missing = responses.select("request_id", F.explode("expected").alias("fingerprint")).distinct().join(answers, ["request_id", "fingerprint"], "left_anti")
    odd = rows.where(is_action & (F.col("rest") != "") & (F.size(F.split("rest", r"\s+")) != F.size("params")))
    warnings = warn(blocks.where(~wanted), F.lit("unrequested cluster "), "fingerprint")
    warnings = warnings.unionAll(warn(rows.where(is_action & ~F.col("known")), F.lit("unknown action "), "action"))
    warnings = warnings.unionAll(warn(odd, F.lit("unparsed parts in "), "line")).unionAll(warn(rows.where("kind = ''"), F.lit("ignored line "), "line"))
    return answers, warnings.unionAll(warn(missing, F.lit("no answer for "), "fingerprint"))
