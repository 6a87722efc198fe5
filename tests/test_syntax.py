from pyspark.sql import functions as F
from sievewright.operators import syntax

SOURCE = '''"""requests.get in a docstring"""
import requests

def nightly_sync():
    "é"; r = requests.get("ü", allow_redirects=True, timeout=3)
    return requests.Session()
'''


def test_mechanical_file_is_settled_on_bytes():
    text, found, error = syntax.settled(SOURCE)
    assert error is None and [f["shape"] for f in found] == ["mechanical_redirect", "mechanical_session"]
    assert 'httpx.get("ü", follow_redirects=True, timeout=3)' in text and "import httpx" in text and syntax.checked(text) == ([], [])


def test_unresolved_keeps_the_import():
    text, found, _ = syntax.settled("import requests\nfor x in y:\n    try:\n        requests.post(x)\n    except (requests.exceptions.Timeout, KeyError):\n        pass\n")
    assert [(f["shape"], f["resolved"]) for f in found] == [("ambiguous_timeout", False), ("ambiguous_retry", False)]
    assert found[0]["signature"] == ["call", "post", "in_loop", "in_try", "fn:module"] and "import requests" in text


def test_broken_files_pass_through(spark):
    files = spark.createDataFrame([("a.py", "def"), ("b.py", SOURCE), ("c.py", "x = 1\n"), ("d.py", None)], "path string, text string")
    got = {r.path: r for r in syntax.codemod(files).collect()}
    assert got["a.py"].error == "SyntaxError" and got["a.py"].text == "def" and got["b.py"].n_resolved == 2 and got["c.py"].text == "x = 1\n"
    assert syntax.findings(files).count() == 3


def test_a_table_of_one_row_group_is_scanned_by_many_tasks(spark):
    from sievewright.plans import sources

    spread = sources.files(spark, "/root/testdata/sf0.001").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(spread) > 8 and max(r["count"] for r in spread) < 40


def test_memory_keeps_what_was_used_last_within_its_room():
    asked = []
    memory = syntax.Memory(lambda text: asked.append(text) or text.upper(), 230)
    assert [memory(x) for x in ["a", "b", "a", "c", "a", "b"]] == ["A", "B", "A", "C", "A", "B"]
    assert asked == ["a", "b", "c", "b"] and len(memory.held) == 2 and memory("z" * 500) == "Z" * 500 and not memory.held and memory.used == 0


def test_equal_texts_of_a_batch_are_parsed_once_and_all_get_their_rows(spark, tmp_path):
    from sievewright.operators.syntax import codemod

    texts = [SOURCE, None, "def", "", SOURCE.replace("timeout=3", "json=3")] * 400
    rows = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(texts)], "path string, text string").coalesce(1)
    got = {r.path: r for r in codemod(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        new, found, error = syntax.settled(text or "")
        r = got[f"{i}.py"]
        assert (r.original, r.text, r.error, len(r.found), r.n_resolved) == (text, new, error, len(found), sum(f["resolved"] for f in found))
        assert r.failures == (syntax.checked(new)[0] if found else [])
    open_ = {r.path: (r.text, r.n_resolved, r.n_unresolved, r.failures) for r in codemod(rows.limit(5), deterministic=False).collect()}
    assert open_["0.py"] == (SOURCE, 0, 2, ["residual reference", "line 5: allow_redirects"])


def test_source_hunks_scans_each_file_once(spark):
    from sievewright.plans import sources

    plan = sources.source_hunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and "scanned-" in sources.source_hunks(spark, "/root/testdata/sf0.001").inputFiles()[0]


def test_rewritten_hands_over_texts_alone_and_they_are_codemods(spark):
    texts = [SOURCE, None, "def", "", "x = 'ü'\n", SOURCE.replace("timeout=3", "json=3"), SOURCE.replace("sync", "é")] * 50
    rows = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(texts)], "path string, text string").coalesce(1)
    got = syntax.rewritten(rows)
    assert got.columns == ["path", "text"] and {tuple(r) for r in got.collect()} == {(f"{i}.py", syntax.settled(t or "")[0]) for i, t in enumerate(texts)}
    assert syntax.rewritten(rows.limit(0)).count() == 0


def test_codemod_texts_scans_for_texts_and_the_corpus_looks_them_up(spark):
    from sievewright.plans import sources

    plan = sources.codemod_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "original" not in plan and "lambdafunction" not in plan
