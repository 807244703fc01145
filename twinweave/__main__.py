"""Command line: compare two archives, or two sets of single files.

    python -m twinweave zip ORIGINAL.zip MODIFIED.zip [--out FOLDER] [--as-coded]
    python -m twinweave files [--html A B] [--css A B] [--jsx A B] [--js A B]
    python -m twinweave classes ARCHIVE.zip
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .plans import report
from .session import session
from .sources import files

KINDS = ("html", "css", "jsx", "js")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twinweave")
    commands = parser.add_subparsers(dest="command", required=True)
    z = commands.add_parser("zip")
    z.add_argument("original")
    z.add_argument("modified")
    z.add_argument("--out")
    z.add_argument("--as-coded", action="store_true")
    f = commands.add_parser("files")
    for kind in KINDS:
        f.add_argument(f"--{kind}", nargs=2)
    c = commands.add_parser("classes")
    c.add_argument("archive")
    a = parser.parse_args(args)
    if a.command == "zip" and not (a.original.endswith(".zip") and a.modified.endswith(".zip")):
        print("both files must be .zip archives", file=sys.stderr)
        return 2
    if a.command == "files" and not any(getattr(a, k) for k in KINDS):
        print("no pair of files was given", file=sys.stderr)
        return 2
    spark = session()
    if a.command == "zip":
        raw = spark.read.format("binaryFile").load([a.original, a.modified]).select("path", "content")
        side = F.when(F.endswith("path", F.lit("/" + a.original.rsplit("/", 1)[-1])), "original").otherwise("modified")
        everything = files.from_archives(raw.select(side.alias("project_id"), "content"))
        pairs = spark.createDataFrame([(1, "original", "modified")], "pair_id int, original_id string, modified_id string")
        whole = tuple(everything.where(F.col("project_id") == p).withColumn("pair_id", F.lit(1)) for p in ("original", "modified"))
        reports = report.project_report(report.compare_projects(*files.sides(everything, pairs), as_coded=a.as_coded, all_files=whole))
        if a.out:
            report.write_reports(reports, a.out)
        print(reports.first().report)
        return 0
    if a.command == "classes":
        raw = spark.read.format("binaryFile").load(a.archive).select(F.lit("archive").alias("project_id"), "content")
        rows = files.typed(files.from_archives(raw)).where("file_type in ('html', 'jsx')")
        for r in report.class_text(rows, ["path"]).orderBy("path").toLocalIterator():
            print(f"{r.path}\n{r.text}\n")
        return 0
    texts = {f"{k}{n + 1}": open(getattr(a, k)[n], encoding="utf-8", errors="replace").read() if getattr(a, k) else None for k in KINDS for n in (0, 1)}
    row = spark.createDataFrame([(1, *texts.values())], "pair_id int, " + ", ".join(f"{c} string" for c in texts))
    print(report.file_pair_report(row).select(F.to_json(F.struct("*"))).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
