"""python -m claimloom check-env | extract PDF... --out DIR | validate DIR... | render DIR... | schema [--out FILE]
| site DIR... --out DIR [--definitions FILE]

Ends with 0 if all is well, 1 for an invalid or unsettled record, 2 for wrong use, 3 for a missing program.
Every command takes all its records in one job.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


STAGED, ABANDONED = ".staged-", 3600  # a build's own folder, and the seconds after which it is nobody's


def session() -> SparkSession:
    return SparkSession.builder.appName("claimloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def load(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    from .sources import records as R

    return R.read_records(spark, [f"{f}/claims.json" for f in folders]), R.read_texts(spark, [f"{f}/text.txt" for f in folders]), R.read_pdfs_beside(spark, folders)


def told(table: DataFrame, mark: str) -> int:
    """Print problems in order; their number. Reports are for people to read, so rows come one by one."""
    n = 0
    for p in table.orderBy("paper_key", "ord").toLocalIterator():
        print(f"{mark} {p.paper_key} {p.rule} {p.label}: {p.message}")
        n += 1
    return n


def check_env(_: argparse.Namespace) -> int:
    from .sources import pdf

    print(f"spark {SparkSession.builder.getOrCreate().version}; pdftotext {'found' if pdf.available() else 'missing'}")
    return 0 if pdf.available() else 3


def extract(args: argparse.Namespace) -> int:
    from .operators import layout as L
    from .sources import pdf

    if not pdf.available():
        return 3
    from .stages import cut

    files = cut(pdf.read_pdfs(session(), args.pdf))
    bad = 0
    for f in files.where("error is not null or length(trim(text)) < 500").select("src_name", "error").toLocalIterator():
        print(f"UNREADABLE {f.src_name}: {f.error or 'almost no text'}")
        bad += 1
    lines = L.clean(pdf.page_lines(files.where("error is null and length(trim(text)) >= 500")))
    texts = L.to_text(lines).join(files.select("paper_key", "src_name", "src_sha256"), "paper_key")
    for t in texts.toLocalIterator():
        folder = Path(args.out) / t.paper_key
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "text.txt").write_text(f"=== paper {t.src_name} sha256:{t.src_sha256} ===\n{t.text}", encoding="utf-8")
        print(f"text: {folder / 'text.txt'}")
    return 1 if bad else 0


def validate(args: argparse.Namespace) -> int:
    from .plans.advise import advise
    from .plans.validate import validate as problems

    records, texts, files = load(session(), args.folder)
    if told(problems(records, texts, files), "PROBLEM"):
        return 1
    told(advise(records, texts, files), "WARNING")
    print("VALID")
    return 0


def render(args: argparse.Namespace) -> int:
    from .operators import record_model as G
    from .plans.render import markdown
    from .plans.validate import validate as problems
    from .sources import records as R

    records, texts, files = load(session(), args.folder)
    if told(problems(records, texts, files), "PROBLEM"):
        return 1
    folder_of = {Path(f).name: Path(f) for f in args.folder}
    for r in markdown(records).toLocalIterator():
        (folder_of[r.paper_key] / "claims.md").write_text(r.markdown, encoding="utf-8")
        print(f"written: {folder_of[r.paper_key] / 'claims.md'}")
    unsure = G.unsettled(R.entries(R.parse(records))).select("paper_key", "label").collect()  # a few of a few records
    for u in unsure:
        print(f"UNSETTLED {u.paper_key} {u.label}")
    if unsure:
        return 1
    from .plans.page import html

    for r in html(records).toLocalIterator():
        (folder_of[r.paper_key] / "claims.html").write_text(r.html, encoding="utf-8")
    return 0


def site(args: argparse.Namespace) -> int:
    """All records or none: everything is checked and built aside before the first file is published, and
    the index goes last. Pages of papers that are no longer given stay and are named."""
    import shutil
    import tempfile

    from pyspark.sql import functions as F

    from .operators import record_model as G
    from .plans import page
    from .plans.advise import advise
    from .plans.definitions import definitions
    from .plans.render import markdown
    from .plans.validate import validate as problems
    from .sources import records as R
    from .stages import cut

    spark, out = session(), Path(args.out)
    if out.exists() and not out.is_dir():
        print(f"PROBLEM {out} is no folder")
        return 2
    records, texts, files = load(spark, args.folder)
    parsed = R.parse(records)
    ids = parsed.select("paper_key", F.try_variant_get("v", "$.paper.id", "string").alias("paper_id"), F.try_variant_get("v", "$.paper.pdf", "string").alias("pdf"))
    name = {r.paper_key: (r.paper_id, r.pdf) for r in ids.toLocalIterator()}
    refused = set()
    for c in G.collisions(ids.select("paper_key", "paper_id")).toLocalIterator():
        print(f"PROBLEM {', '.join(c.records)}: the same paper id but for case")
        refused |= set(c.records)
    wrong = cut(problems(records, texts, files))
    if told(wrong, "PROBLEM"):
        refused |= {r.paper_key for r in wrong.select("paper_key").distinct().toLocalIterator()}
    for u in G.unsettled(R.entries(parsed)).toLocalIterator():
        print(f"UNSETTLED {u.paper_key} {u.label}")
        refused.add(u.paper_key)
    if refused:
        for key in sorted(refused):
            old = out / (name.get(key, (None,))[0] or "") / "claims.html"
            if old.parent != out and old.is_file():
                print(f"WARNING {old} is still published as the last build left it")
        return 1
    told(advise(records, texts, files), "WARNING")

    out.mkdir(parents=True, exist_ok=True)
    for old in out.glob(STAGED + "*"):
        if time.time() - old.stat().st_mtime > ABANDONED:  # of a build that was stopped
            shutil.rmtree(old, ignore_errors=True)
    staged = Path(tempfile.mkdtemp(prefix=STAGED, dir=out))
    try:
        republished = records.select("paper_key", "raw").toLocalIterator()
        for kind, rows in (("claims.html", page.html(records, files).toLocalIterator()), ("claims.md", markdown(records).toLocalIterator()), ("claims.json", republished), ("text.txt", texts.toLocalIterator())):
            for key, body in rows:
                if kind == "claims.json":
                    record = {k: v for k, v in json.loads(body).items() if k != "$schema"}
                    body = json.dumps(record, indent=2, ensure_ascii=False) + "\n"
                (staged / name[key][0]).mkdir(exist_ok=True)
                (staged / name[key][0] / kind).write_text(body, encoding="utf-8")
        for folder in map(Path, args.folder):
            paper_id, pdf = name[folder.name]
            if (folder / pdf).is_file():
                shutil.copyfile(folder / pdf, staged / paper_id / pdf)
        if args.definitions:
            made = spark.createDataFrame([(Path(args.definitions).read_text(encoding="utf-8"),)], "markdown string").select(definitions("markdown")).first()[0]
            (staged / "definitions").mkdir(exist_ok=True)
            (staged / "definitions" / "index.html").write_text(page.definitions_html(made), encoding="utf-8")
        front = page.index_html(records, bool(args.definitions))
        shutil.copytree(staged, out, dirs_exist_ok=True)
        (out / "index.html").write_text(front, encoding="utf-8")
        for paper_id, pdf in name.values():  # what an earlier build published and this one did not
            if not (staged / paper_id / pdf).exists():
                (out / paper_id / pdf).unlink(missing_ok=True)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    built = {paper_id for paper_id, _ in name.values()}
    for old in sorted(p.parent for p in out.glob("*/claims.html") if p.parent.name not in built):
        print(f"WARNING {old} is still published although the index no longer lists it")
    print(f"written: {out / 'index.html'}")
    return 0


def refusals(folders: list[str], *names: str) -> list[str]:
    """Folders and files that can't be read (V-01, V-07) or are missing."""
    out = []
    for folder in map(Path, folders):
        if not folder.is_dir():
            out.append(f"PROBLEM {folder.name} V-01: {folder} is no folder")
            continue
        for path in (folder / x for x in names):
            if not path.is_file():
                out.append(f"MISSING {path}")
            elif not os.access(path, os.R_OK):
                out.append(f"PROBLEM {folder.name} V-07: cannot read {path}")
    return out


def schema(args: argparse.Namespace) -> int:
    from .sources.records import schema_json

    if args.out:
        Path(args.out).write_text(schema_json(), encoding="utf-8")
    else:
        sys.stdout.write(schema_json())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, f, *arguments in (("check-env", check_env), ("extract", extract, "pdf"), ("validate", validate, "folder"), ("render", render, "folder"), ("site", site, "folder"), ("schema", schema)):
        p = commands.add_parser(name)
        p.set_defaults(run=f)
        for a in arguments:
            p.add_argument(a, nargs="+")
        if name in ("extract", "schema", "site"):
            p.add_argument("--out", required=name != "schema")
        if name == "site":
            p.add_argument("--definitions")
    args = parser.parse_args(argv)
    if missing := refusals(getattr(args, "folder", []), "claims.json", "text.txt"):
        print("\n".join(missing))
        return 2
    if getattr(args, "definitions", None) and not Path(args.definitions).is_file():
        print(f"MISSING {args.definitions}")
        return 2
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
