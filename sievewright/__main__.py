"""python -m sievewright [FOLDER] [--show FILE] [--rules] [--write TABLE] [--strong]: migrates the Python files of a folder,
or the synthetic corpus where none is named. Ends with 1 if a file was left unverified."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.answers import Planner
from .plans import migrate as M
from .session import session
from .sources import corpus
from .sources.files import Unverified, kept, read_files, write_verified

FIRST = 10


def summary(done: M.Migration) -> DataFrame:
    """The report as rows (measure, value), with the share of sites that the mechanical pass settled."""
    row = M.report(done)
    row = row.withColumn("codemod_share", F.round(F.col("sites_by_codemod") * 100.0 / F.nullif(F.col("sites"), F.lit(0)), 1))
    pairs = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in row.columns]
    return row.select(F.inline(F.array(*pairs)))


def lookup(output: DataFrame, path: str) -> tuple[str | None, list[str]]:
    """(text of one file, the first paths where there is none of that name)."""
    found = output.where(F.col("path") == path).select("text").first()
    return (found.text, []) if found else (None, [r.path for r in output.select("path").orderBy("path").limit(FIRST).collect()])


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="sievewright", description=__doc__)
    ask.add_argument("folder", nargs="?")
    ask.add_argument("--show", metavar="FILE")
    ask.add_argument("--rules", action="store_true")
    ask.add_argument("--write", metavar="TABLE")
    ask.add_argument("--strong", action="store_true", help="ask again about clusters whose files fail")
    told = ask.parse_args(argv)
    if told.write and not told.folder:
        ask.error("--write needs a folder")
    spark = session()
    files, refused = read_files(spark, told.folder) if told.folder else (corpus.built(spark), None)
    files = kept(files.select("path", "text"), "files")
    done = M.migrate(files, Planner(), Planner() if told.strong else None)
    if told.show:
        text, others = lookup(done.output, told.show)
        print(text if text is not None else "\n".join(["no such file; the first are:", *others]))
        return int(text is None)
    for r in refused.orderBy("path").collect() if refused else ():
        print(f"skipped, not UTF-8: {r.path}")
    for r in summary(done).collect():
        print(f"{r.measure:>18}  {r.value}")
    if told.rules:
        for r in done.rules().collect():
            print(r.fingerprint, *r.rules)
    for r in done.warnings.orderBy("stage", "path", "warning").limit(FIRST).collect():
        print("warning:", r.stage, r.path or "", r.warning)
    failed = done.unverified().orderBy("path").limit(FIRST).collect()
    for r in failed:
        print("unverified:", r.path, *r.failures)
    if told.write:
        try:
            print(write_verified(done.output, told.write), "files written")
        except Unverified as e:
            print("nothing written:", e)
    return int(bool(failed))


if __name__ == "__main__":
    raise SystemExit(main())
