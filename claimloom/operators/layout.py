"""Cleaning a paper's extracted lines, as set-based steps over all papers at once.

Input everywhere: lines(paper_key, page, line_no, line), line_no counting within a page. A removed line stays as
an empty one, so positions hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import cut

# What edges, captions, headings and bibliography entries look like.
EDGE_NUMBER = r"^[\d:.\s]+|[\d:.\s]+$"
NUMBERS_ONLY = r"^\s*(?:\d{1,4}\s{2,}){0,2}\d{1,4}\s*$"
REFERENCE_HEADINGS = ["references", "bibliography", "referencesandnotes", "literaturecited", "workscited"]
APPENDIX_HEADINGS = ["appendix", "appendices", "supplementarymaterial", "supplementalmaterial", "onlineappendix"]
APPENDIX_WORDS = ["supplementary", "supplemental", "additional", "online"]
HEADER_NUMBER = r"(?i)^(?:\d+[.)]?|[ivxlc]+[.)])\s+"
LETTER_LABEL = r"^[A-Z](?:\.\d+)?[.)]?\s+(?=[A-Z])"
BIB_ENTRY = r"(?U)^\s*(?:\[\d{1,3}\]|\d{1,3}\.\s+[A-Z]|[A-Z][\w'’-]+,\s+(?:[A-Z]\.|[A-Z][a-z]+\.)|(?:[A-Z]\.\s?){1,3}[A-Z][\w'’-]+|[A-Z][\w'’-]+(?:\s+(?:and\s+)?[A-Z][\w'’-]+)+\.\s+(?:19|20)\d{2}\.)"
BIB_LOOK = r"https?:|doi|\bpp\.|\bvol\.|\bno\.|\bProc\b|\bConf\b|\bJ\.|\bIEEE\b|\bACM\b|\(\d{4}\)|\b(?:19|20)\d{2}[.,)]?$|\b(?:19|20)\d{2}[.,]"
NOT_A_HEADING = r"(?i)https?:|doi|\bpp\.|\bvol\.|\bProc\b|\(\d{4}\)"
FIGURE_HEAD = r"^(Fig\.|Figure|FIGURE|Table|TABLE|Listing|Algorithm)\s*([\dIVXLC]+)"
REMOVED = "[references removed]"
BODY_RUN = 6


def filled(c: Column | str = "line") -> Column:
    return F.col(c).rlike(r"(?U)\S") if isinstance(c, str) else c.rlike(r"(?U)\S")


def edges(lines: DataFrame) -> DataFrame:
    """First and last line with text of every page that has five or more: edge (top, bottom), apart
    (what is beyond the body's side is blank), norm (without its numbers)."""
    page = Window.partitionBy("paper_key", "page").orderBy("line_no")
    near = lines.withColumn("_below", F.lead("line").over(page)).withColumn("_above", F.lag("line").over(page)).where(filled())
    whole = Window.partitionBy("paper_key", "page")
    placed = near.withColumn("_first", F.min("line_no").over(whole)).withColumn("_last", F.max("line_no").over(whole)).withColumn("_n", F.count("*").over(whole)).where("_n >= 5 and line_no in (_first, _last)")
    top = F.col("line_no") == F.col("_first")
    beyond = F.when(top, F.col("_below")).otherwise(F.col("_above"))
    norm = F.trim(F.regexp_replace(F.regexp_replace("line", EDGE_NUMBER, ""), r"(?U)\s+", " "))
    return placed.select("paper_key", "page", "line_no", "line", F.when(top, "top").otherwise("bottom").alias("edge"), (beyond.isNull() | ~filled(beyond)).alias("apart"), norm.alias("norm"))


def running_headers(lines: DataFrame) -> DataFrame:
    """(paper_key, norm): edge lines that stand apart and repeat on three pages, or on two if they say
    enough to be known again. Rows of a table, with two wide gaps or more, are none."""
    word = r"\p{L}{2,}"
    rows = edges(lines).where(F.col("apart") & F.col("norm").rlike(word) & (F.regexp_count("line", F.lit(r"\S\s{3,}(?=\S)")) < 2))
    counts = rows.groupBy("paper_key", "norm").agg(F.count("*").alias("n"))
    telling = (F.length("norm") >= 20) & (F.regexp_count("norm", F.lit(word)) >= 3)
    return counts.where((F.col("n") >= 3) | ((F.col("n") >= 2) & telling)).select("paper_key", "norm")


def page_numbers(lines: DataFrame) -> DataFrame:
    """(paper_key, page, line_no): edge lines of numbers alone, one of which counts up by one to the same
    edge of the next page."""
    numbers = edges(lines).where(F.col("line").rlike(NUMBERS_ONLY)).select("paper_key", "page", "edge", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\d+"), F.lit(0))).alias("v")).withColumn("v", F.col("v").cast("int"))
    key = ["paper_key", "edge", "page", "v"]
    step = lambda d: numbers.select("paper_key", "edge", (F.col("page") + d).alias("page"), (F.col("v") + d).alias("v"))
    counted = numbers.join(step(-1).unionByName(step(1)).distinct(), key, "left_semi")
    return counted.select("paper_key", "page", "line_no").distinct()


def without_edges(lines: DataFrame) -> DataFrame:
    """lines with running headers, footers and page numbers blanked; two may be stacked at an edge.

    Headers and numbers are found once, on the lines as they came.
    """
    lines = cut(lines)
    headers, numbers = running_headers(lines), page_numbers(lines)
    for _ in range(2):
        e = edges(lines)
        gone = e.join(headers, ["paper_key", "norm"], "left_semi").select("paper_key", "page", "line_no").unionByName(e.join(numbers, ["paper_key", "page", "line_no"], "left_semi").select("paper_key", "page", "line_no")).distinct().withColumn("_gone", F.lit(True))
        lines = cut(lines.join(gone, ["paper_key", "page", "line_no"], "left").withColumn("line", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("line"))).drop("_gone"))
    return lines


def _heading_key(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), "[ .:]+$", "")), HEADER_NUMBER, ""), F.lit(" "), F.lit(""))


def bibliography(lines: DataFrame) -> DataFrame:
    """(paper_key, start, stop, resumed, by_appendix): where each paper's bibliography stands, as
    (page, line_no) structs; stop, the first line after it, is null if it runs to the end.

    It starts at the first heading that an entry follows within twelve lines, and ends at an appendix
    heading; one that starts in the first two thirds also ends where six lines in a row are no entries.
    """
    text = F.trim("line")
    w = Window.partitionBy("paper_key").orderBy("page", "line_no")
    entry, look = F.col("line").rlike(BIB_ENTRY), F.col("line").rlike(BIB_LOOK)
    real = entry & (look | ~F.col("line").rlike(r"^\s*\d{1,3}\."))
    rows = lines.where(filled()).select("paper_key", F.struct("page", "line_no").alias("at"), "page", "line_no", text.alias("text"), entry.alias("entry"), real.alias("real"), (real | look).alias("listed"))
    ahead = w.rowsBetween(1, 12)
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("paper_key"))).withColumn("entry_follows", F.coalesce(F.bool_or("entry").over(ahead), F.lit(False))).withColumn("real_follows", F.coalesce(F.bool_or("real").over(ahead), F.lit(False)))
    key, rest = _heading_key(F.col("text")), F.regexp_replace("text", LETTER_LABEL, "")
    size = F.length("text")
    starts = lambda c, words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda x: F.startswith(c, x)), True)
    is_start = (size <= 40) & ~F.col("text").rlike("[.:]$") & key.isin(REFERENCE_HEADINGS) & F.col("entry_follows")
    plain = (size <= 60) & ~F.col("text").rlike("[.,]$") & ~F.col("text").rlike(NOT_A_HEADING) & ~F.col("real_follows")
    rest_key = _heading_key(rest)
    title = starts(key, APPENDIX_HEADINGS) | starts(rest_key, APPENDIX_HEADINGS)
    worded = plain & (starts(key, APPENDIX_WORDS) | starts(rest_key, APPENDIX_WORDS))
    cited = F.col("text").rlike(r"^[A-Z](?:\.\d+)?[.)]\s") & (rest.rlike("[,\"'“”]") | (F.size(F.split(rest, r"\s+")) > 8))
    is_end = (size <= 80) & (title | worded | ((rest != F.col("text")) & plain & ~cited))
    marked = rows.select("*", is_start.alias("is_start"), is_end.alias("is_end"))
    first = marked.where("is_start").groupBy("paper_key").agg(F.min(F.struct("at", "n", "total")).alias("s")).select("paper_key", F.col("s.at").alias("start"), F.col("s.n").alias("start_n"), ((F.col("s.n") - 1) * 3 < 2 * F.col("s.total")).alias("early"))
    after = marked.join(first, "paper_key").where("n > start_n")
    end = after.where("is_end").groupBy("paper_key").agg(F.min("at").alias("end"))
    # Runs of lines that are no entries: the first of six or more is where the text resumes.
    free = after.where("early").withColumn("_in", F.row_number().over(Window.partitionBy("paper_key").orderBy("n"))).where("not listed")
    runs = free.withColumn("_run", F.col("_in") - F.row_number().over(Window.partitionBy("paper_key").orderBy("n"))).groupBy("paper_key", "_run").agg(F.min("at").alias("at"), F.count("*").alias("length"))
    resumes = runs.where(F.col("length") >= BODY_RUN).groupBy("paper_key").agg(F.min("at").alias("resumes"))
    both = first.join(end, "paper_key", "left").join(resumes, "paper_key", "left")
    stop = F.least("end", "resumes")
    return both.select("paper_key", "start", stop.alias("stop"), F.coalesce((F.col("resumes") == stop) & ~F.coalesce(F.col("end") == stop, F.lit(False)), F.lit(False)).alias("resumed"), F.coalesce(F.col("end") == stop, F.lit(False)).alias("by_appendix"))


def without_bibliography(lines: DataFrame) -> DataFrame:
    """lines with the bibliography blanked and a note in the place of its heading."""
    at = F.struct("page", "line_no")
    met = lines.join(bibliography(lines), "paper_key", "left")
    inside = (at >= F.col("start")) & (F.col("stop").isNull() | (at < F.col("stop")))
    line = F.when(at == F.col("start"), F.lit(REMOVED)).when(inside, F.lit("")).otherwise(F.col("line"))
    return met.select("paper_key", "page", "line_no", line.alias("line"))


def to_text(lines: DataFrame) -> DataFrame:
    """(paper_key, text): pages after their markers, runs of blank lines as one, none at a page's ends; a
    body line that reads like a marker is indented. Pages without lines keep their marker only if they
    have a row."""
    trimmed = lines.withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    w = Window.partitionBy("paper_key", "page").orderBy("line_no")
    blank = F.col("line") == ""
    kept = trimmed.withColumn("_blank", blank).withColumn("_before", F.coalesce(F.lag("_blank").over(w), F.lit(True))).withColumn("_more", F.coalesce(F.max((~F.col("_blank")).cast("int")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    body = F.when(~F.col("_blank") | (~F.col("_before") & (F.col("_more") == 1)), F.when(F.col("line").rlike(r"^=== page \d{1,6} ===$"), F.concat(F.lit(" "), "line")).otherwise(F.col("line")))
    pages = kept.groupBy("paper_key", "page").agg(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("line_no", body.alias("line"))))).alias("b"))
    text = F.concat(F.lit("=== page "), "page", F.lit(" ===\n"), F.when(F.size("b") > 0, F.concat(F.array_join(F.col("b.line"), "\n"), F.lit("\n"))).otherwise(""))
    return pages.groupBy("paper_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page", text.alias("text"))))["text"], "").alias("text"))


def captions(lines: DataFrame) -> DataFrame:
    """(paper_key, label, page): every figure's and table's first page; spellings of one label fold."""
    kind, number = F.regexp_extract(F.trim("line"), FIGURE_HEAD, 1), F.regexp_extract(F.trim("line"), FIGURE_HEAD, 2)
    label = F.concat(F.when(F.lower(kind).startswith("fig"), F.lit("Fig.")).otherwise(F.initcap(kind)), F.lit(" "), number)
    return lines.where(kind != "").groupBy("paper_key", label.alias("label")).agg(F.min("page").alias("page"))


def report(lines: DataFrame) -> DataFrame:
    """(paper_key, pages, empty_pages, characters, captions) of each paper's cleaned lines."""
    by_page = lines.groupBy("paper_key", "page").agg(F.sum(F.length(F.trim("line"))).alias("chars"))
    counts = by_page.groupBy("paper_key").agg(F.count("*").alias("pages"), F.count_if(F.col("chars") == 0).alias("empty_pages"), F.sum("chars").alias("characters"))
    return counts.join(captions(lines).groupBy("paper_key").agg(F.count("*").alias("captions")), "paper_key", "left").fillna(0, ["captions"])


LINES = "paper_key string, page int, line_no int, line string"


def _by_paper(lines: DataFrame, work) -> DataFrame:
    """One paper's pages at a time: a paper is as large as a file, not as the table."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["page", "line_no"])
        numbers = sorted(pdf["page"].unique())
        made = work([pdf.loc[pdf["page"] == n, "line"].tolist() for n in numbers])
        rows = [(pdf["paper_key"].iloc[0], n, i, x) for n, page in zip(numbers, made, strict=True) for i, x in enumerate(page)]
        return pd.DataFrame(rows, columns=["paper_key", "page", "line_no", "line"])

    return lines.select("paper_key", F.col("page").cast("int").alias("page"), F.col("line_no").cast("int").alias("line_no"), "line").groupBy("paper_key").applyInPandas(run, LINES)


def without_line_numbers(lines: DataFrame) -> DataFrame:
    from ..functions.columns import without_line_numbers as work

    return _by_paper(lines, work)


def reading_order(lines: DataFrame) -> DataFrame:
    from ..functions.columns import reading_order as work

    return _by_paper(lines, lambda pages: work(pages)[0])


def clean(lines: DataFrame) -> DataFrame:
    """All steps in their order: edges, line numbers, columns, bibliography."""
    return without_bibliography(cut(reading_order(without_line_numbers(without_edges(lines)))))
