"""PDF files as lines, through the pdftotext program where it is installed.

Each file is read where it lies by one task; a file that can't be read gives a row with an error and no
lines, so one bad file doesn't end a job over many.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = 300  # for one file


def available() -> bool:
    return shutil.which("pdftotext") is not None


def _extract(content: bytes) -> tuple[str | None, str | None]:
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # a task's own scratch, gone when it returns
        f.write(content)
        f.flush()
        try:
            done = subprocess.run(["pdftotext", "-layout", f.name, "-"], capture_output=True, timeout=SECONDS)
        except (OSError, subprocess.TimeoutExpired) as e:
            return None, type(e).__name__
    return (done.stdout.decode("utf-8", "replace"), None) if done.returncode == 0 else (None, done.stderr.decode("utf-8", "replace").strip()[:500] or "unreadable")


def read_pdfs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(paper_key, src_name, src_sha256, text, error): text has form feeds between pages."""
    files = spark.read.format("binaryFile").load(paths)
    name = F.regexp_extract("path", "([^/]+)$", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_extract(c) for c in b["content"]]
            yield b[["src_name", "src_sha256"]].assign(text=[t for t, _ in made], error=[e for _, e in made])

    rows = files.select(name.alias("src_name"), F.sha2("content", 256).alias("src_sha256"), "content").mapInPandas(run, "src_name string, src_sha256 string, text string, error string")
    key = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("src_name", r"(?i)\.pdf$", "")), "[^a-z0-9]+", "-"), "^-|-$", "")
    return rows.select(key.alias("paper_key"), "src_name", "src_sha256", "text", "error")


def page_lines(texts: DataFrame) -> DataFrame:
    """(paper_key, page, line_no, line) of texts with form feeds between pages. An empty page at the end
    is none; empty ones inside count."""
    whole = F.regexp_replace("text", r"\f$", "")
    pages = texts.where("text is not null").select("paper_key", F.posexplode(F.split(whole, "\f", -1)).alias("page", "body"))
    return pages.select("paper_key", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))
