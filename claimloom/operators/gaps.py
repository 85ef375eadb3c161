"""What a quote's [...] may not skip: a section heading, the step from one row of a table to another, or the
paper's running text.

Only the matcher that finds the quote runs in Python. What its gaps skip is exploded to lines, which column
expressions classify; windows cut captions and footnotes with the lines they run on for, and runs of
prose are islands of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as X
from ..stages import cut
from .lines import carry_forward, islands

# How a caption, a footnote, a heading and a table's cells look, how many lines a caption may
# run on for, and how much of the skipped text a problem shows.
CAPTION = r"^(?:Fig\.|Figure|FIGURE|Table|TABLE|Listing|Algorithm)\s*[\dIVXLC]+(?:[.:]|\s+[A-Z]|\s*$)"
FOOTNOTE_LINE = r"^\d{1,2}(?:\s+(?=[A-Z]|https?://|(?:[\w-]+\.)+[a-z]{2,}(?:[/\s]|$))|(?=[A-Z][a-z]))"
HEADING = r"^(?:[IVXLC]+(?:-[A-Z])?\.|\d+(?:\.\d+)*\.|\d+(?:\.\d+)+|[A-Z]\.)\s+[A-Z][\w &,:'’-]*$"
CAPITALS_HEADING = r"^(?:[IVXLC]+|\d+(?:\.\d+)*)\s+(?=(?:[A-Z]\s?){4})[A-Z][A-Z \t]*$"
SENTENCE_WORD = r"(?i)\b(?:is|are|was|were|be|been|has|have|had|with|we|our|us|their|it)\b"
WIDE_GAP = r"\S\s{3,}\S"
PANEL = r"^\((?:[a-z]|[ivx]{1,4})\)\s|^\([^()]*\)$"
A_NUMBER = r"(?<!\S)[(]?[-+]?\d[\d.,:%±/-]*[)]?[.,;]?(?!\S)"
ADDRESS_END = r"(?<!\S)(?:https?://|(?:[\w-]+\.)+[a-z]{2,}[/,.]?)\S*$"
CAPTION_LINES, TITLE_WORDS, TICK_GAP, SHOWN = 5, 9, 8, 90


def is_like(line: Column, pattern: str) -> Column:
    return line.rlike("(?U)" + pattern)


def wide_gaps(line: Column) -> Column:
    return F.regexp_count(line, F.lit("(?U)" + WIDE_GAP))


def is_heading(raw: Column) -> Column:
    """A numbered title, or a numbered line in spaced capitals that is no row of cells. An indented number
    far from its title is the tick of an axis, and a long or verbal title is a sentence."""
    line = X.strip(raw)
    title = F.regexp_extract(line, r"(?Us)^\S+\s+(.*)$", 1)
    sentence = is_like(title, SENTENCE_WORD) | (F.size(F.regexp_extract_all(title, F.lit(r"(?U)\S+"), F.lit(0))) > TITLE_WORDS)
    tick = is_like(raw, r"^\s") & is_like(line, rf"^\S+\s{{{TICK_GAP},}}") & ~X.shouts(line)
    return (is_like(line, HEADING) & ~sentence & ~tick) | (is_like(line, CAPITALS_HEADING) & (wide_gaps(title) < 2))


def is_prose(line: Column) -> Column:
    """Four words or more, no more numbers than words, not laid out in cells, and nothing but running text."""
    tokens = F.regexp_extract_all(line, F.lit(r"(?U)\S+"), F.lit(0))
    worded = F.size(F.filter(tokens, lambda t: F.regexp_count(t, F.lit(r"\p{L}")) >= 2))
    other = is_like(line, CAPTION) | is_like(line, PANEL) | line.contains("http") | line.startswith("[references removed")
    return (F.size(tokens) >= 4) & ~other & (wide_gaps(line) < 2) & (F.regexp_count(line, F.lit("(?U)" + A_NUMBER)) <= worded)


def without_blocks(lines: DataFrame, part: list[str]) -> DataFrame:
    """The lines (line_no, line) that are not blank and belong to no caption or footnote.

    A block is its first line and up to CAPTION_LINES more in the same case; it ends before a blank line or
    the other case and, unless it is in capitals, with a line that ends a sentence or in an address.
    """
    opens = is_like(F.col("line"), CAPTION) | is_like(F.col("line"), FOOTNOTE_LINE)
    ends = is_like(F.col("line"), r"[.?!]$") | (is_like(F.col("line"), ADDRESS_END) & F.regexp_extract("line", r"(?U)(\S+)$", 1).contains("/"))
    seen = lines.withColumns({"opens": opens, "capitals": X.shouts(F.col("line")), "ends": ends})
    seen = carry_forward(seen, F.when(F.col("opens"), F.struct("line_no", "capitals")), "head", part, ["line_no"])
    block = Window.partitionBy(*part, "head.line_no").orderBy("line_no")
    strange = (F.col("line") == "") | (F.col("capitals") != F.col("head.capitals"))
    over = F.col("ends") & ~F.col("head.capitals")
    stopped = F.sum(strange.cast("int")).over(block.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(over.cast("int")).over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("head").isNotNull() & (stopped == 0) & (F.col("line_no") - F.col("head.line_no") <= CAPTION_LINES)
    return seen.withColumn("inside", F.coalesce(inside, F.lit(False))).where(~F.col("inside") & (F.col("line") != "")).select(*lines.columns)


def verdicts(rows: DataFrame, key: list[str], quote: str, page: str) -> DataFrame:
    """key, heading (the first that a gap skips), two_rows (starts in one row of cells and ends in
    another) and prose (the start of the first running text that a gap skips) of the rows whose quote stands
    on its page with a gap. key tells rows apart."""
    spans = cut(rows.select(*key, M.quote_span(quote, page).alias("s"), X.fold(page).alias("text")).where("s.start is not null and size(s.gaps) > 0"))
    row_at = lambda at: F.concat(F.substring_index(F.substring(F.col("text"), F.lit(1), at), "\n", -1), F.substring_index(F.substring(F.col("text"), at + 1, F.length("text")), "\n", 1))
    cells = lambda at: wide_gaps(row_at(at)) >= 2
    ends = spans.select(*key, (cells(F.col("s.start")) & cells(F.col("s")["end"] - 1)).alias("two_rows"))

    part = [*key, "gap"]
    gaps = spans.select(*key, "text", F.posexplode("s.gaps").alias("gap", "g")).select(*part, F.substring(F.col("text"), F.col("g.start") + 1, F.col("g")["end"] - F.col("g.start")).alias("skipped"))
    lines = gaps.select(*part, F.posexplode(F.split("skipped", X.LINE_END, -1)).alias("line_no", "raw")).withColumn("line", X.strip(F.col("raw")))

    figure = F.max(is_like(F.col("line"), CAPTION)).over(Window.partitionBy(*part))
    titles = lines.withColumn("figure", figure).where(~F.col("figure") & is_heading(F.col("raw")))
    heading = titles.groupBy(*key).agg(F.min(F.struct("gap", "line_no", "line")).alias("h")).select(*key, F.col("h.line").alias("heading"))

    rest = cut(without_blocks(lines.drop("raw"), part).withColumn("prose", is_prose(F.col("line"))))
    runs = islands(rest, F.col("prose"), part, ["line_no"]).groupBy(*part).agg(F.max("length").alias("longest"))
    whole = rest.groupBy(*part).agg(F.count("*").alias("n"), F.count_if("prose").alias("n_prose"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("words"))
    shown = F.when(F.length("words") <= SHOWN, F.col("words")).otherwise(F.concat(F.substring("words", 1, SHOWN), F.lit("...")))
    welds = whole.join(runs, part).where((F.col("longest") >= 2) | (F.col("n_prose") >= F.col("n") - 1))
    prose = welds.groupBy(*key).agg(F.min_by(shown, "gap").alias("prose"))
    return ends.join(heading, key, "left").join(prose, key, "left")
