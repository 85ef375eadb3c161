"""What a valid record's checker should look at. Advisories never refuse a record.

Rows have the form of validate's problems. Rules are numbered A-01 to A-32; A-05 needs the
PDF files beside the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as X
from ..operators import entries as E
from ..operators import record_model as G
from ..operators.lines import as_of
from ..sources import records as R
from ..stages import cut
from .validate import collect, each, filled, when

# The words and patterns that the rules look for.
COMPARISON = "more less fewer higher lower greater larger smaller better worse faster slower than most least only".split()
NUMBER = r"\d+(?:[.,]\d+)*"
NEGATION = r"(?U)\b(?:not(?!\s+only\b)|no|never|neither|nor|none|without|cannot)\b|n't\b"
NEGATION_PAIR = r"(?U)\b(?:not(?!\s+only\b)|no|never|neither|nor|none|without|cannot)\s+\w+|\w+n't\s+\w+"
NO_MAIN_RESULT = r"(?i)\bno main result\b"
GROUND = r"(?i)\b(?:describ\w+|repeat\w+|cited|agreement|corpus|codebook|sample\s+size|states?\s+the\s+main\s+resul\w+|out\s+of\s+scope|comes?\s+from|came\s+from|(?:would|does|still)\s+(?:\w+\s+){0,3}?stands?|breaks?\s+\w+\s+down|part\s+of\s+a\s+split)\b"
EMPTY_REASON = r"(?i)^\W*(?:this\s+is\s+|it\s+is\s+)?(?:not\s+)?(?:an?\s+|the\s+)?(?:important|significant|relevant|interesting|major|minor|key|main|central|notable)\b|(?i)^\W*(?:not\s+a\s+claim|no|n/?a|none)\b|(?i)^\W*(?:it\s+)?(?:does\s+not\s+qualify|fails\s+the\s+test|nothing\s+rests\s+on\s+it|judged\s+not\s+to\s+be\s+one|excluded\s+from\s+the\s+set|see\s+the\s+note)\b"
ONLY_THE_NUMBER = r"(?i)repeats?\s+(?:only\s+)?the\s+number|only\s+the\s+number|states?\s+no\s+(?:main\s+)?result|not\s+the\s+main\s+result"
SOME_MISSING = r"(?i)\b(?:only\s+(?:some|part|the\s+parts?)|some\s+of\s+(?:them|these|the)|not\s+all|do(?:es)?\s+not\s+add|shares?\s+of)\b"
PARTS_OF = r"(?i)parts? of (?:the |its )?(?:sentence's )?(?:value |number )?[^\d\n]{0,20}?(?<![RCES])(\d[\d,]*(?:\.\d+)?)"
BOXED = r"(?i)(?:summary|answer)\s*(?:to|for)?\s*rq"
HEADING = r"^(?:[IVXLC]+(?:-[A-Z])?\.|\d+(?:\.\d+)*\.|\d+(?:\.\d+)+|[A-Z]\.)\s+[A-Z][\w &,:'’-]*$|^(?:[IVXLC]+|\d+(?:\.\d+)*)\s+(?=(?:[A-Z]\s?){4})[A-Z][A-Z \t]*$"
A_SENTENCE = r"(?i)\b(?:is|are|was|were|be|been|has|have|had|with|we|our|us|their|it)\b"
SECTION_NUMBER = r"^\s*([IVXLC]+(?:-[A-Z])?|\d+(?:\.\d+)*)(?![A-Za-z])"
ENDS_SENTENCE = r"[.!?:;)\]\"']$"


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(X.ascii_fold(c)), "[^a-z]", "")


def _title(parsed: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """A-01 and A-04."""
    rows = parsed.select("paper_key", F.try_variant_get("v", "$.paper.title", "string").alias("title")).join(pages.where("page = 1").select("paper_key", "text"), "paper_key", "left").join(sources, "paper_key", "left")
    asked = rows.withColumn("printed", F.col("text").isNull() | ~filled("title") | ((letters(F.col("title")) != "") & F.contains(letters(F.col("text")), letters(F.col("title")))))
    lost = asked.withColumn("there", M.quote_on(F.when(~F.col("printed"), F.col("title")), "text"))
    return collect(lost, [when("A-01", ~F.col("printed") & ~F.col("there"), "paper.title", "page 1 does not print this title"), when("A-04", F.col("src_name").isNull(), "text", "names no source paper")])


def headings(lines: DataFrame) -> DataFrame:
    """(paper_key, page, line_no, heading)."""
    line = F.trim("line")
    return lines.where(F.col("page").isNotNull() & line.rlike(HEADING) & ~line.rlike(A_SENTENCE)).select("paper_key", "page", "line_no", line.alias("heading"))


def _sections(entries: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """A-02 and A-03: the section that an entry names against the paper's headings."""
    heads = cut(headings(lines))
    top = lambda c: F.regexp_extract(F.regexp_extract(c, SECTION_NUMBER, 1), r"^[^.-]*", 0)
    known = heads.groupBy("paper_key").agg(F.array_remove(F.array_sort(F.collect_set(top(F.col("heading")))), "").alias("numbers"), F.collect_set(letters(F.col("heading"))).alias("titles"))
    rows = entries.join(known, "paper_key").withColumn("said", top(F.col("section")))
    none = collect(rows, [when("A-02", (F.col("said") != "") & (F.size("numbers") > 0) & ~F.array_contains("numbers", F.col("said")), F.concat("label", F.lit(".section")), F.concat(F.lit("the paper has no section "), "said"))], place=["rank", "pos"])

    # Where each quote starts, as a line of its page; then the last heading at or above it.
    headed = entries.join(known.select("paper_key"), "paper_key", "left_semi")
    starts = R.page_spans(headed.where(F.col("lo").isNotNull() & filled("quote")), pages).where("page_text is not null").withColumn("at", M.quote_span("quote", "page_text"))
    page_first = lines.where("marker is not null").groupBy("paper_key", F.col("page").alias("lo")).agg(F.min("line_no").alias("first_line"))
    placed = starts.where("at.start is not null").join(page_first, ["paper_key", "lo"]).withColumn("line_no", F.col("first_line") + F.size(F.split(F.substring(X.fold("page_text"), F.lit(1), F.col("at.start")), "\n", -1)))
    stands = as_of(placed.select("paper_key", "rank", "pos", "label", "section", "line_no"), heads.select("paper_key", "line_no", "heading"), "paper_key", "line_no", "heading").where("heading is not null").join(known, "paper_key")
    said, here = letters(F.col("section")), letters(F.col("heading"))
    number = lambda c: F.split(F.regexp_extract(c, SECTION_NUMBER, 1), r"\.")
    a, b = number(F.col("section")), number(F.col("heading"))
    depth = F.least(F.size(a), F.size(b))
    nested = (a[0] != "") & (b[0] != "") & (F.slice(a, F.lit(1), depth) == F.slice(b, F.lit(1), depth))
    other = F.exists("titles", lambda t: (t != "") & F.contains(said, t))
    wrong = when("A-03", (said != "") & ~F.contains(said, here) & ~nested & other, F.concat("label", F.lit(".section")), F.concat(F.lit("the quote stands under "), "heading"))
    return none.unionByName(collect(stands, [wrong], place=["rank", "pos"]))


def _quotes(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """A-07 to A-11: a quote's edges on its page, each (quote, page) once."""
    first = F.row_number().over(Window.partitionBy("paper_key", "quote", "page_raw").orderBy("rank", "pos"))
    once = entries.where(F.col("lo").isNotNull() & filled("quote")).withColumn("_n", first).where("_n = 1")
    rows = R.page_spans(once, pages).where("page_text is not null").withColumn("at", M.quote_span("quote", "page_text")).where("at.start is not null").withColumn("page_text", X.fold("page_text"))
    head, tail = F.substring("page_text", F.lit(1), F.col("at.start")), F.substring("page_text", F.col("at.end") + 1, F.length("page_text"))
    body = F.substring("page_text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    before, after = F.regexp_replace(head, r"(?U)\s+\z", ""), F.regexp_replace(tail, r"(?U)^\s+", "")
    gap = F.substring(head, F.length(before) + 1, F.length(head))
    paragraph = F.contains(F.regexp_replace(gap, r"[ \t]+", ""), F.lit("\n\n"))
    opens, closes = F.substring(F.ltrim("quote"), 1, 1), F.rtrim("quote")
    upper = opens.rlike(r"\p{Lu}")
    mid_word = ((gap == "") & before.rlike(r"[\p{L}\p{N}]\z")) | (before.rlike(r"\p{L}-\z") & ~paragraph & ~upper)
    mid_sentence = before.rlike(r"[\p{Ll},;]\z") & ~paragraph & (~F.contains(gap, F.lit("\n")) | ~upper)
    open_end = (after != "") & ~closes.rlike(ENDS_SENTENCE)
    footnote = closes.rlike(r"\p{L}\z") & tail.rlike(r"^\d{1,2}(?:\s|\z)")
    cut_word = (tail == after) & after.rlike(r"(?U)^(?:\w|[.,]\d)") & ~footnote
    prose = F.exists(F.split(body, "\n"), _prose)
    at = F.concat("label", F.lit(".quote"))
    return collect(rows, [
        when("A-07", (F.col("list") == "claims") & ~prose, at, "reads like a row of a table"),
        when("A-08", (before != "") & mid_word, at, "starts in the middle of a word or number"),
        when("A-09", (before != "") & ~mid_word & mid_sentence, at, "starts in the middle of a sentence"),
        when("A-10", open_end & cut_word, at, "ends in the middle of a word or number"),
        when("A-11", open_end & ~cut_word & after.rlike(r"^[\p{Ll},;]"), at, "ends in the middle of a sentence"),
    ], place=["rank", "pos"])


def _prose(line: Column) -> Column:
    """A line of running text: four words or more, no cells, no more numbers than words."""
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    numbers = F.size(F.filter(tokens, lambda t: t.rlike(r"^[(]?[-+]?\d[\d.,:%±/-]*[)]?[.,;]?$")))
    worded = F.size(F.filter(tokens, lambda t: F.regexp_count(t, F.lit(r"\p{L}")) >= 2))
    caption = line.rlike(r"^(?:Fig\.|Figure|FIGURE|Table|TABLE|Listing|Algorithm)\s*[\dIVXLC]+(?:[.:]|\s+[A-Z]|\s*$)")
    return (F.size(tokens) >= 4) & ~caption & (F.regexp_count(line, F.lit(r"\S\s{3,}(?=\S)")) < 2) & (numbers <= worded) & ~F.contains(line, F.lit("http"))


def _reasons(entries: DataFrame) -> DataFrame:
    """A-06, A-12 to A-16, A-20, A-21."""
    results = G.results(entries).groupBy("paper_key").agg(F.collect_set("id").alias("results"))
    claims = entries.where("list = 'claims'").groupBy("paper_key").agg(F.map_from_entries(F.collect_list(F.struct("id", "serves"))).alias("claim_serves"))
    rows = entries.join(results, "paper_key", "left").join(claims, "paper_key", "left").withColumn("results", F.coalesce("results", F.array().cast("array<string>")))
    at = lambda f: F.concat("label", F.lit(f".{f}"))
    reason, why = F.coalesce("reason", F.lit("")), F.coalesce("selection_reason", F.lit(""))
    n_words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    is_claim, is_out = F.col("list") == "claims", F.col("list") == "excluded"
    names_one = F.exists("serves", lambda r: F.regexp_like(why, F.concat(F.lit(r"\b"), r, F.lit(r"\b"))))
    duplicate = F.coalesce("duplicate_of", F.array().cast("array<string>"))
    named = (F.size(duplicate) > 0) | filled("split_from") | reason.rlike(r"\bR\d+\b")
    no_result = reason.rlike(NO_MAIN_RESULT) & (F.size("results") > 0) & ~named
    verdict = reason.rlike(EMPTY_REASON)
    wanted = F.array_distinct(F.flatten(F.transform(duplicate, lambda d: F.coalesce(F.try_element_at("claim_serves", d), F.array().cast("array<string>")))))
    wanted = F.array_intersect(wanted, F.col("results"))
    repeats_claim = F.exists(duplicate, lambda d: F.coalesce(F.array_contains(F.map_keys("claim_serves"), d), F.lit(False)))
    uncovered = F.size(F.array_except(wanted, F.coalesce("breaks_down", F.array().cast("array<string>")))) > 0
    singles = [
        when("A-12", is_claim & ~names_one, at("selection_reason"), "names none of the main results it serves"),
        when("A-13", is_claim & names_one & (n_words(why) < 5), at("selection_reason"), "names the main result and nothing else"),
        when("A-14", is_out & no_result, at("reason"), "says that no main result depends on it and names no ground"),
        when("A-15", is_out & ~no_result & ((n_words(reason) < 3) | (verdict & (n_words(reason) <= 8) & ~reason.rlike(GROUND))), at("reason"), "gives no ground"),
        when("A-16", is_out & repeats_claim & (F.size(F.array_intersect(duplicate, F.col("results"))) == 0) & uncovered & ~reason.rlike(ONLY_THE_NUMBER), at("duplicate_of"), "names a claim but no main result"),
        when("A-20", (F.col("list") == "main_results") & F.col("section").rlike(BOXED) & (F.col("source") != "rq_answer"), at("source"), "the section names a boxed answer"),
        when("A-21", _sum_differs(F.coalesce("note", F.lit(""))), at("note"), "names a whole and then values that do not add up to it"),
    ]
    unknown = lambda f, c: each("A-06", F.array_sort(F.array_except(F.regexp_extract_all(c, F.lit(r"\bR\d+\b"), F.lit(0)), F.col("results"))), at(f), lambda r: F.concat(F.lit("names "), r, F.lit(", which is no main result")))
    return collect(rows, singles, [F.when(~F.col("list").isin("main_results"), unknown("reason", reason)), F.when(is_claim, unknown("selection_reason", why))], ["rank", "pos"])


def _sum_differs(note: Column) -> Column:
    """Some whole that a note names, with two or more values after it that add up to something else."""
    named, wholes = (F.regexp_extract_all(note, F.lit(PARTS_OF), F.lit(g)) for g in (0, 1))
    texts = F.split(note, PARTS_OF, -1)  # before the first whole, between them, after the last one
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    size = lambda array: F.aggregate(array, F.lit(0), lambda a, x: a + F.length(x))

    def hedged(i: Column) -> Column:
        """Whether the sentence around the whole says that some parts are missing."""
        at = size(F.slice(texts, F.lit(1), i + 1)) + size(F.slice(named, F.lit(1), i))
        before, after = F.substring(note, F.lit(1), at), F.substring(note, at + F.length(F.get(named, i)) + 1, F.length(note))
        return F.concat(F.regexp_extract(before, r"[^.]*\z", 0), F.get(named, i), F.regexp_extract(after, r"\A[^.]*", 0)).rlike(SOME_MISSING)

    def differs(whole: Column, i: Column) -> Column:
        clean = F.get(texts, i + 1)
        for pattern in (r"\([^)]*%\)|\b\d[\d,]*(?:\.\d+)?\s*%", r"\b(?:Table|Fig\.|Figure)\s*[\dIVXLC]+|\bpages?\s+[\d-]+", r"(?i)\bpp?\.?\s*\d+(?:\s*[-–]\s*\d+)?\b", r"\b(?:19|20)\d{2}\b", r"[A-Za-z]+-?\d[\d.]*", r"=\s*\d[\d,]*(?:\.\d+)?"):
            clean = F.regexp_replace(clean, pattern, " ")
        parts = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"\b\d[\d,]*(?:\.\d+)?\b"), F.lit(0)), number), lambda x: x.isNotNull() & (x != number(whole)))
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return (F.size(parts) >= 2) & (F.abs(total - number(whole)) > 1e-9) & ~hedged(i)

    return F.exists(F.transform(wholes, differs), lambda x: F.coalesce(x, F.lit(False)))


def _support(entries: DataFrame) -> DataFrame:
    """A-17 to A-19: results by the claims that support them, meeting only over shared claims."""
    groups = cut(G.one_result(entries))
    name = F.concat("paper_key", F.lit("\u0000"), "result")
    sets = groups.where("size(claims) > 0").select("paper_key", "result", "pos", "group", name.alias("name"), F.transform("claims", lambda c: F.concat("paper_key", F.lit("\u0000"), c)).alias("claims"))
    wider = E.proper_subsets(sets, "claims", "name")
    size = sets.select(F.col("name").alias("wide"), F.size("claims").alias("n"), F.col("result").alias("wide_id"))
    widest = wider.join(size, "wide").groupBy("narrow").agg(F.max_by("wide_id", F.struct("n", "wide_id")).alias("widest"))
    broken = cut(sets.join(widest, F.col("name") == F.col("narrow")).select("paper_key", "result", "pos", "group", "widest"))
    out = [collect(broken.withColumn("rank", F.lit(0)), [when("A-17", F.lit(True), "result", F.concat(F.lit("every claim that serves it also serves "), "widest"))], place=["rank", "pos"])]
    whole = groups.join(broken.select("paper_key", "group").distinct(), ["paper_key", "group"], "left_anti")
    same = whole.groupBy("paper_key", "group").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "result")))["result"].alias("members"))
    out.append(collect(same, [when("A-18", F.col("n") > 1, F.array_join("members", ", "), "the same claims serve all of them")]))
    lead = sets.join(whole.select("paper_key", F.col("group").alias("result")).distinct(), ["paper_key", "result"], "left_semi")
    pairs = E.overlapping(lead, "claims", "name", 0.5)
    ids = lead.select(F.col("name").alias("a"), "paper_key", F.col("result").alias("id_a"), F.col("pos").alias("pos_a"))
    jac = pairs.join(ids, "a").join(lead.select(F.col("name").alias("b"), F.col("result").alias("id_b"), F.col("pos").alias("pos_b")), "b")
    ordered = F.when(F.col("pos_a") < F.col("pos_b"), F.concat("id_a", F.lit(" and "), "id_b")).otherwise(F.concat("id_b", F.lit(" and "), "id_a"))
    out.append(collect(jac, [when("A-19", F.lit(True), ordered, "most of the claims that serve one serve the other")]))
    return reduce(DataFrame.unionByName, out)


def _sentences(entries: DataFrame) -> DataFrame:
    """A-22 to A-24."""
    long = entries.where((F.contains("section", F.lit("?")) & (F.length("section") > 60)) | (F.length("section") > 100))
    whole = long.groupBy("paper_key").agg(F.count("*").alias("n"), F.max(F.length("section")).alias("longest"))
    out = [collect(whole, [when("A-22", F.lit(True), "section", F.concat(F.lit("a heading is copied whole into "), "n", F.lit(" sections, the longest of "), "longest", F.lit(" characters")))])]

    quoted = entries.where("quote_key is not null").select("paper_key", "rank", "pos", "label", "quote_key", "id", "list", "serves", "split_from")
    inner = quoted.select("paper_key", F.col("quote_key").alias("inner"), F.col("label").alias("inner_label"), F.struct("rank", "pos").alias("inner_at"))
    inside = quoted.join(inner, "paper_key").where("label <> inner_label and quote_key <> inner and contains(quote_key, inner)")
    first = inside.groupBy("paper_key", "rank", "pos", "label").agg(F.min_by("inner_label", "inner_at").alias("inner_label"))
    out.append(collect(first, [when("A-23", F.lit(True), F.concat("label", F.lit(".quote")), F.concat(F.lit("contains the quote of "), "inner_label"))], place=["rank", "pos"]))

    w = Window.partitionBy("paper_key", "quote_key").orderBy("rank", "pos")
    again = quoted.where("split_from is null").withColumn("first", F.first(F.struct("label", "id", "serves")).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    linked = F.array_contains("serves", F.col("first.id")) | F.array_contains("first.serves", F.col("id"))
    out.append(collect(again, [when("A-24", ~F.coalesce(linked, F.lit(False)), F.concat("label", F.lit(".quote")), F.concat("first.label", F.lit(" quotes the same sentence on another page")))], place=["rank", "pos"]))
    return reduce(DataFrame.unionByName, out)


def _parts(entries: DataFrame) -> DataFrame:
    """A-25 to A-32: what the parts of a sentence, or a result's own words, lose or reorder."""
    numbers = lambda c: F.regexp_extract_all(X.ascii_fold(c), F.lit(NUMBER), F.lit(0))
    kept = F.array(*map(F.lit, COMPARISON))
    compared = lambda c: F.array_intersect(X.word_set(c), kept)
    flat = lambda c: F.regexp_replace(F.lower(X.ascii_fold(c)), r"\s+", " ")
    pairs = lambda c: F.array_distinct(F.regexp_extract_all(flat(c), F.lit(NEGATION_PAIR), F.lit(0)))
    at = F.concat("label", F.lit(".states"))
    parts = entries.where(filled("split_from") & filled("states") & filled("quote"))
    out = [collect(parts, [when("A-25", ~X.in_order(numbers("states"), numbers("quote")), at, "gives its numbers in another order than the quote")], place=["rank", "pos"])]

    body = F.regexp_replace(F.coalesce("note", F.lit("")), r"(?i)\b(?:Table|Fig\.|Figure)\s*[\dIVXLC]+|\bpp?\.?\s*\d+|\bpages?\s+[\d-]+", " ")
    own = F.regexp_extract_all("states", F.lit(NUMBER), F.lit(0))
    paired = (F.size(own) == 0) | F.arrays_overlap(own, F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)))
    groups = parts.withColumn("_paired", F.coalesce(paired, F.lit(False))).groupBy("paper_key", "split_from").agg(
        F.min_by("quote", F.struct("rank", "pos")).alias("quote"), F.collect_list("states").alias("all"), F.bool_and("_paired").alias("paired"))
    said = F.array_distinct(F.flatten(F.transform("all", compared)))
    dropped = F.array_sort(F.array_except(compared(F.col("quote")), said))
    lost = F.filter(pairs(F.col("quote")), lambda p: ~F.exists("all", lambda s: F.contains(flat(s), p)))
    name = F.concat(F.lit("split_from "), "split_from")
    out.append(collect(groups, [
        when("A-26", F.col("quote").rlike(r"(?i)\brespectively\b") & ~F.col("paired"), name, "the quote pairs items and numbers with \"respectively\""),
        when("A-27", F.size(dropped) > 0, name, F.concat(F.lit("no part keeps "), F.array_join(dropped, ", "))),
        when("A-28", flat(F.col("quote")).rlike(NEGATION) & ~F.exists("all", lambda s: flat(s).rlike(NEGATION)), name, "no part keeps the quote's negation"),
    ], [each("A-29", F.array_sort(lost), name, lambda p: F.concat(F.lit("no part keeps "), p))]))

    own_words = G.results(entries).where(filled("states") & filled("quote") & (F.col("states_key") != F.col("quote_key")))
    less = F.array_sort(F.array_except(compared(F.col("quote")), compared(F.col("states"))))
    words = F.split(flat(F.col("states")), " ")
    turned = F.filter(pairs(F.col("quote")), lambda p: F.array_contains(words, F.element_at(F.split(p, " "), -1)) & ~F.contains(flat(F.col("states")), p))
    out.append(collect(own_words, [
        when("A-30", F.size(less) > 0, at, F.concat(F.lit("does not keep "), F.array_join(less, ", "))),
        when("A-31", ~X.in_order(numbers("states"), numbers("quote")), at, "gives its numbers in another order than the quote"),
    ], [each("A-32", F.array_sort(turned), at, lambda p: F.concat(F.lit("keeps a word of the quote without the negation in "), p))], ["rank", "pos"]))
    return reduce(DataFrame.unionByName, out)


def _strays(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """A-05. Names count as the same whatever their case, as on many file systems."""
    pdf = F.try_variant_get("v", "$.paper.pdf", "string")
    named = parsed.select("paper_key", F.element_at(F.split(pdf, "/", -1), -1).alias("pdf")).where(filled("pdf"))
    others = named.join(files, "paper_key").where(F.lower("name") != F.lower("pdf")).groupBy("paper_key", "pdf").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return collect(others, [when("A-05", F.lit(True), "paper.pdf", F.concat(F.lit("names "), "pdf", F.lit(", and beside it stands "), F.array_join("names", ", ")))])


def advise(records: DataFrame, texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All advisories of valid (paper_key, raw) records with (paper_key, text) page texts, and of the
    (paper_key, name, sha256) PDF files beside them."""
    parsed = cut(R.parse(records))
    lines = cut(R.text_lines(texts))
    pages = cut(R.pages(lines))
    entries = cut(R.entries(parsed).withColumn("quote_key", F.when(filled("quote"), M.quote_key("quote"))).withColumn("states_key", F.when(filled("states"), M.quote_key("states"))))
    parts = [*([_strays(parsed, files)] if files is not None else []), _title(parsed, pages, R.provenance(texts)), _sections(entries, lines, pages), _quotes(entries, pages), _reasons(entries), _support(entries), _sentences(entries), _parts(entries)]
    return reduce(DataFrame.unionByName, [p.withColumn("phase", F.lit(i)) for i, p in enumerate(parts)]).select("paper_key", "rule", "label", "message", F.struct("phase", "at", "n").alias("ord"))
