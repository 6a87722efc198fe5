import pytest
from pyspark.sql import functions as F
from sievewright.functions import text as T
from sievewright.operators import answers, rules, syntax
from sievewright.plans import migrate
from sievewright.sources import corpus as source
from sievewright.sources import files

TIMEOUT = [("set_timeout", {"value": "5"})]


@pytest.mark.parametrize(
    ("call", "want"),
    [
        ("requests.get(u)", "httpx.get(u, timeout=5)"),
        ("requests.get(\n    u,\n    headers=h,  # é\n)", "httpx.get(\n    u,\n    headers=h, timeout=5,  # é\n)"),
        ("requests.get((u))", "httpx.get((u), timeout=5)"),
        ("'é', requests.get(u, **kw)", "'é', httpx.get(u, **kw, timeout=5)"),
        ("requests.get()", "requests.get()"),
        ("requests.get(u, timeout=1)", "requests.get(u, timeout=1)"),
    ],
)
def test_set_timeout(call, want):
    once = rules.applied(call, TIMEOUT)[0]
    assert once == want and rules.applied(once, TIMEOUT)[0] == want


def test_rules_run_in_order_and_report():
    text = "try:\n    requests.get(u)\nexcept (requests.exceptions.Timeout, KeyError):\n    pass\n"
    new, done, skipped, errors = rules.applied(text, [*TIMEOUT, ("map_exception", {"from": "requests.exceptions.Timeout", "to": "httpx.TimeoutException"}), ("set_timeout", {"value": "soon"}), ("drop", {})])
    assert "except (httpx.TimeoutException, KeyError)" in new and (done, skipped, len(errors)) == (2, 1, 2)
    assert rules.applied(text, [*TIMEOUT, ("rename_symbol", {"from": "httpx.get", "to": "1x("})])[0] == text
    assert rules.applied(text, TIMEOUT, {9})[0] == text


def test_parser_trusts_nothing(spark):
    text = "hello\nCLUSTER a\nACTION set_timeout value=1 value=2\nACTION fly x=1\nACTION set_timeout value=3 or so\nNOTE fine\nwhat\nESCALATE\nCLUSTER z\nACTION set_timeout value=9\nCLUSTER b\nESCALATE too hard"
    rows = spark.createDataFrame([(0, ["a", "b", "c"], text), (1, ["d"], "")], "request_id long, expected array<string>, text string")
    found, warnings = answers.parsed(rows)
    got = {r.fingerprint: r for r in found.collect()}
    assert [(x.action, x.params["value"]) for x in got["a"].rules] == [("set_timeout", "2"), ("set_timeout", "3")]
    assert got["a"].note == "fine" and got["a"].escalate is None and got["b"].escalate == "too hard" and set(got) == {"a", "b"}
    assert sorted(r.warning.split()[0] for r in warnings.collect()) == sorted(["unrequested", "unknown", "unparsed", "unparsed", "ignored", "ignored", "no", "no"])


CALL = "import requests\n\n\ndef nightly_{0}(u):\n    return requests.get(u)\n"
RETRY = "import requests\n\n\ndef f{0}(u):\n    try:\n        return requests.post(u, json={{}})\n    except requests.exceptions.Timeout:\n        return None\n"
ODD = "import requests\n\n\ndef g(u):\n    try:\n        return u()\n    except requests.Timeout:\n        return None\n"


def corpus(spark):
    rows = [(f"a{i}.py", CALL.format(i)) for i in range(8)] + [(f"b{i}.py", RETRY.format(i)) for i in range(8)] + [("odd.py", ODD), ("plain.py", "x = 1\n"), ("broken.py", "def"), ("empty.py", "")]
    return spark.createDataFrame(rows, "path string, text string")


def test_migration_and_escalation(spark, tmp_path):
    first = migrate.migrate(corpus(spark), answers.Planner())
    got = {r.path: r for r in first.output.collect()}
    assert len(got) == 20 and got["plain.py"].text == "x = 1\n" and not got["plain.py"].changed
    assert "httpx.get(u, timeout=120.0)" in got["a3.py"].text and "import httpx" in got["a3.py"].text
    assert "timeout=10.0" in got["b0.py"].text and "httpx.TimeoutException" in got["b0.py"].text and not got["b0.py"].failures
    assert first.clusters.count() == 3 and {r.path for r in first.unverified().collect()} == {"odd.py"}
    assert {(r.stage, r.path) for r in first.warnings.collect() if r.path} == {("scan", "broken.py"), ("escalate", "odd.py")}
    with pytest.raises(files.Unverified):
        files.write_verified(first.output, f"{tmp_path}/refused")

    class Strong:
        def complete(self, requests):
            name = F.regexp_extract("text", r"CLUSTER\s+(\S+)", 1)
            return requests.select("request_id", F.concat(F.lit("CLUSTER "), name, F.lit("\nACTION map_exception from=requests.Timeout to=httpx.TimeoutException")).alias("text"))

    second = migrate.migrate(corpus(spark), answers.Planner(), Strong(), 3)
    assert second.rounds == 1 and second.unverified().isEmpty()
    assert files.write_verified(second.output, f"{tmp_path}/done") == 17


def test_no_files_and_scripted_model(spark):
    none = migrate.migrate(corpus(spark).limit(0), answers.Scripted([]), answers.Planner())
    assert none.output.count() == 0 and none.rounds == 0
    silent = migrate.migrate(corpus(spark).where("path = 'a1.py'"), answers.Scripted([]), levers=migrate.Levers(windowing=False, clustering=False, packing=False))
    assert silent.unverified().count() == 1 and {r.stage for r in silent.warnings.collect()} == {"answer", "escalate"}


def test_large_clusters_are_asked_in_shards_of_forty(spark):
    rows = [(f"a{i:03}.py", CALL.format(i)) for i in range(90)]
    found = migrate.migrate(spark.createDataFrame(rows, "path string, text string"), answers.Planner())
    sizes = {r.fingerprint: r["size"] for r in found.clusters.collect()}
    assert sorted(sizes.values()) == [10, 40, 40] and sorted(name[-2:] for name in sizes) == ["-0", "-1", "-2"]
    assert found.answers.count() == 3 and found.unverified().isEmpty()
    first = next(name for name in sizes if name.endswith("-0"))
    assert sorted(r.path for r in found.members.where(F.col("fingerprint") == first).collect()) == [r[0] for r in rows[:40]]


def test_actions_of_an_answer_that_escalates_are_not_applied(spark):
    class Unsure:
        def complete(self, requests):
            name = F.regexp_extract("text", r"CLUSTER\s+(\S+)", 1)
            return requests.select("request_id", F.concat(F.lit("CLUSTER "), name, F.lit("\nACTION set_timeout value=5\nESCALATE not sure")).alias("text"))

    out = migrate.migrate(corpus(spark).where("path = 'a1.py'"), Unsure())
    assert "timeout" not in out.output.first().text and out.unverified().count() == 1


def test_files_are_read_byte_for_byte(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.py").write_bytes("é = 1\r\n\n".encode())
    (tmp_path / "bad.py").write_bytes(b"\xff")
    (tmp_path / "y.txt").write_bytes(b"no")
    rows, refused = files.read_files(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("d/x.py", "é = 1\r\n\n")] and [r.path for r in refused.collect()] == ["bad.py"]
    assert syntax.codemod(rows).count() == 1


def test_small_clusters_share_one_request(spark):
    found = migrate.migrate(corpus(spark), answers.Planner())
    row = migrate.report(found).first()
    assert (row.clusters, row.requests, row.declined, row.escalations) == (3, 1, 1, 0)
    assert row.files == 20 and row.touched == 17 and row.migrated == 16 and row.cached_tokens == 0


TWO = """import requests


class A:
    def run(self, u):
        return requests.get(u)


class B:
    def run(self, u):
        return requests.get(u)
"""
FAR = "import requests\n\n\ndef nightly_copy(u):\n" + "    u = u + 1\n" * 20 + "    return requests.get(u)\n"


def hunks_of(spark, text):
    rows = spark.createDataFrame([("x.py", text)], "path string, text string")
    return sorted(migrate.hunks(syntax.findings(rows), rows).collect(), key=lambda r: r.start)


def test_methods_of_one_name_stay_apart(spark):
    assert [list(r.site_lines) for r in hunks_of(spark, TWO)] == [[6], [11]]


def test_a_far_definition_is_shown(spark):
    row = hunks_of(spark, FAR)[0]
    assert row.enclosing == "def nightly_copy(u):" and row.code.split("\n")[:2] == ["--- x.py:19-25", "     | (in) def nightly_copy(u):"]
    assert "fn:batch" in row.signature and hunks_of(spark, TWO)[0].enclosing is None and not row.oversized
    assert hunks_of(spark, FAR.replace("u + 1", "u + " + "1" * 300))[0].oversized


def test_examples_are_similar_or_absent(spark):
    rows = [("t", ["ambiguous_timeout", "call", "get", "params", "fn:interactive"]), ("z", ["nothing", "alike"])]
    got = {r.fingerprint: r.examples for r in migrate.examples(spark.createDataFrame(rows, "fingerprint string, keys array<string>")).collect()}
    assert set(got) == {"t"} and len(got["t"]) == 2 and "somebody waits" in got["t"][0]


def test_requests_are_the_same_each_time(spark):
    texts = [migrate.requests_of(migrate.migrate(source.built(spark, 40), answers.Planner()).clusters).orderBy("request_id").collect() for _ in range(2)]
    assert texts[0] == texts[1]


def test_pinned_bounds_on_the_published_corpus(spark):
    """The published inequalities, over 120 files."""
    files_ = files.kept(source.built(spark), "corpus")
    key = source.stats(files_).first()
    done = migrate.migrate(files_, answers.Planner())
    row, naive = migrate.report(done).first(), migrate.ledger(migrate.naive(files_)).first()
    assert (row.sites, row.sites_by_codemod, row.touched) == (key.sites, key.mechanical, key.touched)
    assert row.unverified == 0 and row.migrated == row.touched and row.declined == 0
    assert row.total_tokens < 0.15 * naive.total_tokens and row.output_tokens < 0.05 * naive.output_tokens and row.requests < naive.requests / 10
    assert row.clusters < row.hunks / 5 and row.requests < row.clusters
    texts = done.codemod.where("n_unresolved > 0").agg(F.sum(T.tokens(F.col("text")))).first()[0]
    touched = done.codemod.where("n_unresolved + n_resolved > 0").agg(F.sum(T.tokens(F.col("text")))).first()[0]
    shown = done.hunks.agg(F.sum("token_cost")).first()[0]
    assert shown < 0.8 * texts and shown < 0.6 * touched
    off = {r.configuration: r for r in migrate.ablation(files_, answers.Planner(), {k: v for k, v in migrate.ABLATIONS.items() if k in ("no deterministic pass", "no clustering", "no packing")}).collect()}
    assert off["no deterministic pass"].total_tokens > 1.8 * row.total_tokens and off["no deterministic pass"].unverified > 50
    assert off["no clustering"].total_tokens > 8 * row.total_tokens and off["no clustering"].clusters == row.hunks
    assert off["no packing"].requests == row.clusters
    saved = {r.measure: r.saved for r in migrate.comparison(files_, done).collect()}
    assert set(saved) == {"requests", "input_tokens", "output_tokens", "total_tokens", "cost"} and min(saved.values()) > 80


def test_escalation_recovers_from_a_model_that_says_nothing(spark):
    files_ = source.built(spark, 20, seed=11)
    poor = migrate.migrate(files_, answers.Scripted([]))
    row = migrate.report(poor).first()
    assert row.unverified > 0 and row.declined == 0
    good = migrate.migrate(files_, answers.Scripted([]), answers.Planner())
    row = migrate.report(good).first()
    assert row.unverified == 0 and row.escalations == row.clusters and good.usage.where("model = 'strong'").count() >= 1


def test_equal_files_with_equal_work_are_rewritten_once_and_others_apart(spark):
    text = "import requests\n\n\ndef f(u):\n    return requests.get(u)\n"
    rows = [(f"{i}.py", text, text, 1) for i in range(60)] + [("null.py", None, None, 0), ("broken.py", "def", "def", 0), ("odd.py", "x = 1\n", "x = 2\n", 0)]
    work = [(f"{i}.py", 1, [5], [("set_timeout", {"value": str(i % 3)})]) for i in range(40)] + [("40.py", 1, [5], [("set_timeout", {"value": "soon"})]), ("40.py", 2, [5], [("set_timeout", {"value": "7"})])]
    shape = "path string, batch_ord int, lines array<int>, rules array<struct<action:string,params:map<string,string>>>"
    out = rules.migrated(spark.createDataFrame(rows, "path string, text string, original string, n_found int").coalesce(1), spark.createDataFrame(work, shape))
    got = {r.path: r for r in out.collect()}
    assert len(got) == 63 and all(got[f"{i}.py"].text == text.replace("requests", "httpx").replace("get(u)", f"get(u, timeout={i % 3})") for i in range(40))
    assert "timeout=7" in got["40.py"].text and len(got["40.py"].errors) == 1 and got["41.py"].text == text and got["41.py"].failures == ["residual reference"]
    assert (got["null.py"].text, got["null.py"].changed, got["broken.py"].failures, got["odd.py"].changed) == ("", False, [], True)
    before = len(rules._outcomes.held)
    assert rules.outcome(text, text, 1, None) is rules.outcome(text, text, 1, None) and len(rules._outcomes.held) == before + 1


def test_the_migration_scans_its_files_once(spark, monkeypatch):
    scans, scan = [], syntax._scanned
    monkeypatch.setattr(syntax, "_scanned", lambda *a: scans.append(a) or scan(*a))
    found = migrate.migrate(corpus(spark), answers.Planner())
    assert len(scans) == 1 and found.rules().count() == 2


def test_equal_texts_are_cut_and_rewritten_once(spark, monkeypatch):
    cut, done, windows = [], [], migrate.windows
    monkeypatch.setattr(migrate, "windows", lambda found, rows, w: cut.append(rows.count()) or windows(found, rows, w))
    rows = [(f"a{i}.py", CALL.format("x")) for i in range(6)] + [(f"b{i}.py", RETRY.format(i)) for i in range(2)] + [("null.py", None), ("empty.py", "")]
    files_ = spark.createDataFrame(rows, "path string, text string")
    found = migrate.migrate(files_, answers.Planner())
    apply = type(files_).mapInArrow
    monkeypatch.setattr(type(files_), "mapInArrow", lambda d, *a: done.append(d.count()) or apply(d, *a))
    got = {r.path: r for r in found.output.collect()}
    assert cut == [3] and done == [5] and len(got) == 10 and found.hunks.count() == 8
    assert {r.code.split("\n")[0] for r in found.hunks.collect() if r.path < "b"} == {f"--- a{i}.py:1-5" for i in range(6)}
    assert all(not r.failures for r in got.values()) and (got["null.py"].text, got["null.py"].changed) == ("", False)
    assert {got[f"a{i}.py"].text for i in range(6)} == {CALL.format("x").replace("requests", "httpx").replace("get(u)", "get(u, timeout=120.0)")}


def test_a_query_runs_no_stage_that_its_result_does_not_hold(spark, monkeypatch, tmp_path):
    from sievewright.plans import sources

    def never(*_):
        raise AssertionError

    spark.range(30).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(migrate, "replayed", never)
    assert sources.migration_rules(spark, str(tmp_path)).count() > 0
    made, read = [], sources.files
    monkeypatch.setattr(sources, "files", lambda *a: made.append(a) or read(*a))
    monkeypatch.setattr(migrate, "naive", lambda rows, naive=migrate.naive: naive(rows) if any("codemod-" in f for f in rows.inputFiles()) else never())
    assert sources.migration_comparison(spark, str(tmp_path)).count() == 5 and len(made) == 1
    monkeypatch.setattr(migrate, "ask", never)
    assert sources.migration_clusters(spark, str(tmp_path)).count() > 0


def test_the_planner_cuts_requests_where_the_parser_does(spark):
    body = "SHAPES ambiguous_timeout\n\n  12 | def nightly_x():\n"
    texts = [f"EXAMPLE\nCLUSTER of two words\n\n  CLUSTER a-1001  \n{body}\n\nCLUSTER\tb-111\r\nWHY requests.exceptions.Timeout\rCLUSTER c\nnothing CLUSTER d", "no header\nCLUSTER\ne", "", None, "CLUSTER f\nSHAPES ambiguous_timeout"]
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    got = {r.request_id: [x.split("\n")[:2] for x in r.text.split("\n\n")] for r in answers.Planner().complete(rows).collect()}
    assert got == {
        0: [["CLUSTER a-1001", "ACTION set_timeout value=120.0"], ["CLUSTER b-111", "ACTION map_exception from=requests.exceptions.Timeout to=httpx.TimeoutException"], ["CLUSTER c", "ESCALATE no action fits"]],
        4: [["CLUSTER f", "ACTION set_timeout value=10.0"]],
    }


def test_rules_parse_each_text_once_and_keep_no_table_they_do_not_hold(spark, monkeypatch):
    parsed, tables, scan, keep = [], [], syntax._scanned, migrate.kept
    monkeypatch.setattr(syntax, "_scanned", lambda rows, *a: parsed.append(sorted(r.text or "-" for r in rows.collect())) or scan(rows, *a))
    monkeypatch.setattr(migrate, "kept", lambda df, name: tables.append(name) or keep(df, name))
    texts = [CALL.format("x"), RETRY.format(0), ODD, None, "def"]
    found = migrate.migrate(spark.createDataFrame([(f"{i:02}.py", texts[i % 5]) for i in range(60)], "path string, text string").repartition(7), answers.Planner())
    assert found.rules().count() == 2 and parsed == [sorted(t or "-" for t in texts)]
    assert tables == ["files", "codemod", "hunks", "members", "clusters", "requests", "responses", "answers"]
    assert found.declined == 1 and found.codemod.count() == 60 and found.hunks.count() == 36 and found.output.where("changed").count() == 24
    assert {(r.stage, r.warning) for r in found.warnings.collect() if r.path == "04.py"} == {("scan", "SyntaxError")}
    assert {r.path for r in found.codemod.where("original is null").collect()} == {f"{i:02}.py" for i in range(3, 60, 5)}
