import sievewright.__main__ as cli
from sievewright.streaming import files as stream

CLEAN = "import requests\n\n\ndef f(u):\n    return requests.get(u, timeout=1)\n"
STUCK = "import requests\n\n\ndef f(u):\n    return requests.options()\n"


def test_summary_lookup_write_and_exit_status(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text(CLEAN)
    (tmp_path / "in" / "bad.py").write_bytes(b"\xff")
    assert cli.main([f"{tmp_path}/in", "--rules", "--write", f"{tmp_path}/out"]) == 0
    said = capsys.readouterr().out
    assert "skipped, not UTF-8: bad.py" in said and "1 files written" in said and "codemod_share  100.0" in said
    assert spark.read.parquet(f"{tmp_path}/out").first().text == CLEAN.replace("requests", "httpx")
    assert cli.main([f"{tmp_path}/in", "--show", "a.py"]) == 0 and "httpx.get" in capsys.readouterr().out
    assert cli.main([f"{tmp_path}/in", "--show", "b.py"]) == 1 and "a.py" in capsys.readouterr().out
    (tmp_path / "in" / "b.py").write_text(STUCK)
    assert cli.main([f"{tmp_path}/in", "--write", f"{tmp_path}/none", "--strong"]) == 1
    said = capsys.readouterr().out
    assert "nothing written" in said and "unverified: b.py residual reference" in said and not (tmp_path / "none").exists()


def test_files_that_arrive_are_settled_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.py").write_text(CLEAN)
        stream.settle_arriving(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/seen").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.path for r in rows) == ["0.py", "1.py", "2.py"] and all(r.text == CLEAN.replace("requests", "httpx") for r in rows)
