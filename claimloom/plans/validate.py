"""What refuses a record, as tables of problems.

Every rule is a row-local predicate, a lookup of ids, or a grouped condition over all records at once;
nothing runs record by record. A problem is (paper_key, rule, label, message, ord): ord follows list,
entry and rule. Rules are numbered V-01 to V-87; folders that are absent and files that can't be read
(V-01, V-07) are found by the commands, before any job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as X
from ..operators import gaps as GAPS
from ..sources import records as R
from ..stages import cut

PROBLEM = "array<struct<rule:string,label:string,message:string>>"
HALF = "\ufdd0"  # a character of no text
GAP = r"\[(?:\.\.\.|…)\]"
DEEPEST = 1000  # how far the parser follows arrays and objects in each other
PUBLISHED = ["claims.json", "claims.md", "claims.html", "text.txt", "index.html"]  # fixed values


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def when(rule: str, condition: Column, label: Column | str, message: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), as_column(label).alias("label"), as_column(message).alias("message")))


def each(rule: str, values: Column, label: Column, message) -> Column:
    """A problem for every element of an array."""
    return F.transform(values, lambda x: F.struct(F.lit(rule).alias("rule"), label.alias("label"), message(x).alias("message")))


def collect(rows: DataFrame, singles: list[Column], arrays: list[Column] = (), place: list[str] = ()) -> DataFrame:
    one = F.filter(F.array(*singles).cast(PROBLEM), lambda p: p.isNotNull())
    every = reduce(lambda a, b: F.concat(a, F.coalesce(b.cast(PROBLEM), F.array().cast(PROBLEM))), arrays, one)
    ord_ = F.struct(*(F.col(c).cast("int").alias(f"o{i}") for i, c in enumerate(place or [])), *(F.lit(0).alias(f"o{i}") for i in range(len(place or []), 2)))
    return rows.select("paper_key", ord_.alias("at"), F.posexplode(every).alias("n", "p")).select("paper_key", "p.rule", "p.label", "p.message", "at", "n")


def _fields(has: Column, name: str, label: Column | str) -> list[Column]:
    """V-15 and V-16 by the fields that an object has."""
    required, optional = R.FIELDS[name]
    known = F.array(*map(F.lit, required + optional))
    lab = F.lit(label) if isinstance(label, str) else label
    return [
        each("V-15", F.array_sort(F.array_except(F.array(*map(F.lit, required)), has)), lab, lambda f: F.concat(F.lit("missing field "), f)),
        each("V-16", F.array_sort(F.array_except(has, known)), lab, lambda f: F.concat(F.lit("unknown field "), f)),
    ]


def file_rules(records: DataFrame, texts: DataFrame, files: DataFrame | None) -> DataFrame:
    """V-02, V-03 and, where the PDF files beside the records are given, V-11."""
    keys = lambda df, mark: df.select("paper_key").distinct().withColumn(mark, F.lit(True))
    both = keys(records, "has_record").join(keys(texts, "has_text"), "paper_key", "full")
    out = collect(both, [when("V-02", F.col("has_text").isNull(), "text", "there is no text of this record"), when("V-03", F.col("has_record").isNull(), "record", "there is no record of this text")])
    if files is None:
        return out
    named = R.provenance(texts.join(records.select("paper_key"), "paper_key", "left_semi"))
    beside = named.join(files.withColumnRenamed("name", "src_name"), ["paper_key", "src_name"])
    return out.unionByName(collect(beside, [when("V-11", F.col("sha256") != F.col("src_sha256"), "text", F.concat("src_name", F.lit(" beside the record is not the file that the text was extracted from")))]))


def _depth(raw: Column) -> Column:
    """How many arrays and objects are open at once, at most."""
    brackets = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), '"[^"]*"', ""), F.lit(r"[\[\]{}]"), F.lit(0))
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def record_rules(parsed: DataFrame) -> DataFrame:
    """V-04 to V-06, V-08, V-13, V-14, V-31 to V-33."""
    v, is_object, has = F.col("v"), F.col("ok"), F.col("has")
    top = F.array(*map(F.lit, R.FIELDS))
    utf8 = F.coalesce(F.is_valid_utf8("raw"), F.lit(True))
    too_deep = F.coalesce(_depth(F.col("raw")) > DEEPEST, F.lit(False))
    singles = [when("V-04", ~utf8, "record", "not UTF-8"), when("V-05", utf8 & v.isNull() & ~too_deep, "record", "not valid JSON"), when("V-06", utf8 & v.isNull() & too_deep, "record", "is nested too deeply to read"), when("V-08", ~is_object, "record", "must be an object")]
    singles += [when("V-31", is_object & ~R.kind(v, "$.paper").startswith("OBJECT"), "paper", "must be an object")]
    singles += [when("V-32", is_object & F.array_contains(has, x) & F.try_variant_get(v, f"$.{x}", "array<variant>").isNull(), x, "must be a list") for x in R.LISTS]
    arrays = [
        F.when(is_object, each("V-13", F.array_sort(F.array_except(has, F.array_append(top, F.lit("$schema")))), F.lit("record"), lambda f: F.concat(F.lit("unknown top-level field "), f))),
        F.when(is_object, each("V-14", F.array_sort(F.array_except(top, has)), F.lit("record"), lambda f: F.concat(F.lit("missing top-level field "), f))),
    ]
    return collect(parsed.withColumns({"ok": R.is_object(v), "has": R.keys(v)}), singles, arrays)


def paper_rules(parsed: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """V-09, V-10, V-12, V-15 to V-30."""
    paper = parsed.where(R.is_object(F.col("v")) & R.kind(F.col("v"), "$.paper").startswith("OBJECT")).select("paper_key", F.try_variant_get("v", "$.paper", "variant").alias("p"))
    counts = pages.groupBy("paper_key").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.when(F.col("opened") > 1, F.col("page")))).alias("again"))
    rows = paper.join(counts, "paper_key", "left").join(sources, "paper_key", "left")
    p = F.col("p")
    text = {f: R.value(p, f) for f in ("id", "title", "pdf", "doi")}
    singles = [when("V-09", F.col("n_pages").isNull(), "text", "has no page marker")]
    for f in ("id", "title", "pdf"):
        here = R.kind(p, f"$.{f}")
        singles += [
            when("V-17", here.isNotNull() & ~filled(text[f]), f"paper.{f}", "must be a non-empty string"),
            when("V-22", text[f].rlike(X.UNSHOWABLE), f"paper.{f}", "holds a character that shows something else than the record says"),
        ]
    pdf, doi = text["pdf"], text["doi"]
    base = F.element_at(F.split(pdf, "/", -1), -1)
    bare = F.regexp_replace(doi, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    whole = lambda c, pattern: c.rlike(rf"^(?:{pattern})\z")
    singles += [
        when("V-10", filled(pdf) & (base != F.col("src_name")), "paper.pdf", "the text was extracted from another file"),
        when("V-18", filled(pdf) & (base != pdf), "paper.pdf", "must be a file's name, not a path"),
        when("V-19", pdf == "..", "paper.pdf", "must be a file's name"),
        when("V-20", pdf.rlike(r"[\x00-\x1f]"), "paper.pdf", "must not hold a control character"),
        when("V-23", (bare != doi) & whole(bare, R.DOI), "paper.doi", "write the DOI itself, not its address"),
        when("V-24", R.kind(p, "$.doi").isNotNull() & ~F.coalesce(whole(doi, R.DOI) | whole(bare, R.DOI), F.lit(False)), "paper.doi", "is not a DOI"),
        when("V-25", filled(pdf) & ~filled(base), "paper.pdf", "must name a file"),
        when("V-26", F.lower(base).isin(PUBLISHED), "paper.pdf", "is the name of a published file"),
        when("V-27", F.length(text["id"]) > 200, "paper.id", "is over 200 characters"),
        when("V-28", filled(text["id"]) & (F.length(text["id"]) <= 200) & ~whole(text["id"], R.PAPER_ID), "paper.id", "must be a plain name"),
        when("V-29", R.kind(p, "$.pages").isNotNull() & (R.kind(p, "$.pages") != "BIGINT"), "paper.pages", "must be a whole number"),
        when("V-30", (R.kind(p, "$.pages") == "BIGINT") & (F.try_variant_get(p, "$.pages", "int") != F.coalesce("n_pages", F.lit(0))), "paper.pages", "is not the text's number of pages"),
    ]
    again = each("V-12", F.col("again"), F.lit("text"), lambda n: F.concat(F.lit("opens page "), n, F.lit(" more than once")))
    return collect(rows, singles, [*_fields(R.keys(p), "paper", "paper"), again])


def raw_rules(records: DataFrame) -> DataFrame:
    """V-21 and V-37: unpaired surrogates, which parsing would hide. Records that have any are parsed once more
    with HALF in their place; where no field of the paper or of an entry shows it, the record itself is named."""
    half = r"(?i)(?<!\\)((?:\\\\)*)(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f])|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"
    told = "must not hold an unpaired surrogate"
    shown = cut(R.parse(records.where(F.col("raw").rlike(half)).withColumn("raw", F.regexp_replace("raw", half, "$1" + HALF))))
    bad = lambda v: F.map_keys(F.map_filter(F.coalesce(F.from_json(F.to_json(v), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: F.contains(k, F.lit(HALF)) | F.coalesce(F.contains(x, F.lit(HALF)), F.lit(False))))
    plain = lambda c: F.replace(c, F.lit(HALF), F.lit("\ufffd"))
    named = lambda rule, v, label: F.transform(F.array_sort(bad(v)), lambda f: F.struct(F.lit(rule).alias("rule"), F.concat(label, F.lit("."), plain(f)).alias("label"), F.lit(told).alias("message")))
    is_object = lambda v, path: R.kind(v, path).startswith("OBJECT")
    paper = collect(shown, [], [F.when(is_object(F.col("v"), "$.paper"), named("V-21", F.try_variant_get("v", "$.paper", "variant"), F.lit("paper")))])
    entries = collect(R.entries(shown), [], [F.when(is_object(F.col("e"), "$"), named("V-37", F.col("e"), plain(F.col("label"))))], ["rank", "pos"])
    found = cut(paper.unionByName(entries))
    return found.unionByName(collect(shown.join(found.select("paper_key"), "paper_key", "left_anti"), [when("V-21", F.lit(True), "record", told)]))


def entry_rules(entries: DataFrame) -> DataFrame:
    """Rules that one entry decides: V-15, V-16, V-33, V-34, V-36, V-38 to V-42, V-52 to V-57, V-59 to
    V-63, V-66, V-67 to V-69, V-71, V-72, V-74 to V-76."""
    e, lab = F.col("e"), F.col("label")
    at = lambda f: F.concat(lab, F.lit(f".{f}"))
    rows = entries.withColumns({"ok": R.is_object(e), "has": R.keys(e)})
    kind = {x: F.col("list") == x for x in R.LISTS}
    has = lambda f: F.array_contains("has", f)
    split = filled("split_from")
    states, quote = F.col("states"), F.col("quote")
    quote_words = F.array_union(F.array_union(X.word_set(quote), X.word_set(F.regexp_replace(quote, r"\s*\[(?:\.\.\.|…)\]\s*", ""))), X.word_set(F.regexp_replace(quote, r"\s*\[(?:\.\.\.|…)\]\s*", " ")))
    borrowed = F.regexp_replace(states, r"\[([^\[\]\d]+?)\]", " ")
    order_words, quote_order = X.words(borrowed), X.words(F.regexp_replace(quote, r"\s*\[(?:\.\.\.|…)\]\s*", " "))
    joined_order = X.words(F.regexp_replace(quote, r"\s*\[(?:\.\.\.|…)\]\s*", ""))
    bound = filled(quote) & filled(states) & (kind["main_results"] | split)
    extra = F.array_sort(F.array_except(X.word_set(borrowed), quote_words))
    disorder = ~(X.in_order(order_words, quote_order) | X.in_order(order_words, joined_order))
    prefix = reduce(lambda out, x: F.when(kind[x], F.lit(R.PREFIX[x])).otherwise(out), R.LISTS, F.lit(""))
    singles = [
        when("V-33", ~F.col("ok"), lab, "must be an object"),
        when("V-34", F.col("ok") & ~filled("id"), at("id"), "must be a non-empty string"),
        when("V-36", filled("id") & ~F.regexp_like("id", F.concat(F.lit("^"), prefix, F.lit(r"\d{1,6}\z"))), at("id"), "must be the list's letter and a number"),
        when("V-42", (F.col("page_kind") == "STRING") & (F.col("hi") != F.col("lo") + 1), at("page"), "must name two consecutive pages"),
        when("V-41", F.col("ok") & has("page") & F.col("lo").isNull(), at("page"), "must be a page number or two consecutive pages"),
        when("V-52", kind["main_results"] & bound & (F.size(extra) > 0), at("states"), F.concat(F.lit("uses words that are not in the quote: "), F.array_join(F.slice(extra, 1, 5), ", "))),
        when("V-53", kind["main_results"] & bound & (F.size(extra) == 0) & disorder, at("states"), "uses the quote's words in another order"),
        when("V-54", kind["main_results"] & has("source") & ~F.coalesce(F.col("source").isin(R.SOURCES), F.lit(False)), at("source"), "is none of the sources"),
        when("V-55", kind["main_results"] & (F.col("source") == "other") & ~filled("note"), at("note"), "source other needs a note"),
        when("V-56", F.coalesce(R.kind(e, "$.split_from") != "VOID", F.lit(False)) & ~split, at("split_from"), "must be null or a non-empty string"),
        when("V-57", split & ~F.col("split_from").rlike(r"^S\d+\z"), at("split_from"), "must be S and a number"),
        when("V-59", ~kind["main_results"] & bound & (F.size(extra) > 0), at("states"), F.concat(F.lit("uses words that are not in the quote: "), F.array_join(F.slice(extra, 1, 8), ", "))),
        when("V-60", ~kind["main_results"] & bound & (F.size(extra) == 0) & disorder, at("states"), "uses the quote's words in another order"),
        when("V-61", kind["claims"] & F.col("ok") & (F.size("serves") == 0), at("serves"), "must list at least one main result"),
        when("V-66", kind["claims"] & ~split & filled(quote) & filled(states) & (F.col("states_key") != F.col("quote_key")), at("states"), "differs from the quote although the claim is not split"),
        when("V-74", F.arrays_overlap("duplicate_of", "breaks_down"), at("breaks_down"), "names what duplicate_of names as well"),
        when("V-75", kind["excluded"] & split & ~filled(states), at("states"), "an excluded part needs the words of that part"),
        when("V-76", kind["excluded"] & ~split & has("states"), at("states"), "only a part of a split statement has words of its own"),
    ]
    needed = {"main_results": ["quote", "section", "states"], "claims": ["quote", "section", "states", "selection_reason"], "excluded": ["quote", "section", "reason"]}
    for f in ("quote", "section", "states", "selection_reason", "reason"):
        lists = [x for x in R.LISTS if f in needed[x]]
        singles.append(when("V-39", F.col("list").isin(lists) & has(f) & ~filled(f), at(f), "must be a non-empty string"))
    singles.append(when("V-40", has("note") & ~filled("note"), at("note"), "must be a non-empty string"))
    singles += [when("V-38", F.col(f).rlike(X.UNSHOWABLE), at(f), "holds a character that shows something else than the record says") for f in R.STRINGS]
    for f, rule in (("duplicate_of", "V-67"), ("breaks_down", "V-71")):
        singles.append(when(rule, kind["excluded"] & has(f) & ((F.size(f) == 0) | F.exists(f, lambda x: x.isNull() | ~x.rlike(r"(?U)\S"))), at(f), "must be a list of ids"))
    singles.append(when("V-62", kind["claims"] & F.exists("serves", lambda x: x.isNull()), at("serves"), "must list ids as strings"))
    singles.append(when("V-69", F.array_contains("duplicate_of", F.col("id")), at("duplicate_of"), "an entry cannot repeat itself"))
    twice = lambda f: F.array_distinct(F.filter(f, lambda x: F.size(F.filter(f, lambda y: y == x)) > 1))
    arrays = [F.when(F.col("ok") & kind[x], a) for x in R.LISTS for a in _fields(F.col("has"), x, lab)]
    arrays += [each(rule, twice(F.col(f)), at(f), lambda x: F.concat(x, F.lit(" is listed twice"))) for f, rule in (("serves", "V-63"), ("duplicate_of", "V-68"), ("breaks_down", "V-72"))]
    return collect(rows, singles, arrays, ["rank", "pos"])


def reference_rules(entries: DataFrame) -> DataFrame:
    """Rules that look ids up: V-35, V-58, V-64, V-65, V-70, V-73, V-82, V-83."""
    own = entries.where(filled("id")).select("paper_key", F.col("id").alias("target"), "rank", "pos", "list", "label")
    ids = own.groupBy("paper_key", "target").agg(F.min_by("label", F.struct("rank", "pos")).alias("owner"), F.min(F.struct("rank", "pos")).alias("first"), F.max((F.col("list") == "main_results").cast("int")).alias("is_result"))
    repeated = own.join(ids, ["paper_key", "target"]).where(F.struct("rank", "pos") != F.col("first"))
    out = [collect(repeated, [when("V-35", F.lit(True), F.concat("label", F.lit(".id")), F.concat(F.lit("is also used by "), "owner"))], place=["rank", "pos"])]

    named = entries.select("paper_key", "rank", "pos", "label", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("refs")) for f in R.REFERENCES))).alias("r")).select("paper_key", "rank", "pos", "label", "r.field", F.explode("r.refs").alias("target")).where("target is not null")
    met = named.join(ids, ["paper_key", "target"], "left")
    no_result = F.coalesce("is_result", F.lit(0)) == 0
    where = F.concat("label", F.lit("."), "field")
    singles = [
        when("V-64", (F.col("field") == "serves") & no_result, where, F.concat("target", F.lit(" is not a main result"))),
        when("V-73", (F.col("field") == "breaks_down") & no_result, where, F.concat("target", F.lit(" is not a main result"))),
        when("V-70", (F.col("field") == "duplicate_of") & F.col("owner").isNull(), where, F.concat("target", F.lit(" is no entry's id"))),
    ]
    out.append(collect(met, singles, place=["rank", "pos"]))

    clash = entries.where(filled("split_from")).join(ids.select("paper_key", F.col("target").alias("split_from")), ["paper_key", "split_from"])
    out.append(collect(clash, [when("V-58", F.lit(True), F.concat("label", F.lit(".split_from")), "must not be an entry's id")], place=["rank", "pos"]))

    results = entries.where((F.col("list") == "main_results") & filled("id"))
    served = named.where("field = 'serves'").select("paper_key", F.col("target").alias("id")).distinct()
    bare = results.where(~filled("note")).join(served, ["paper_key", "id"], "left_anti")
    out.append(collect(bare, [when("V-82", F.lit(True), F.concat("label", F.lit(".note")), "no claim serves this main result; a note must say why")], place=["rank", "pos"]))

    sentence = results.where("quote_key is not null").groupBy("paper_key", "quote_key").agg(F.max_by("id", "pos").alias("result"))
    same = entries.where((F.col("list") == "claims") & ~filled("split_from")).join(sentence, ["paper_key", "quote_key"]).where(~F.coalesce(F.array_contains("serves", F.col("result")), F.lit(False)))
    out.append(collect(same, [when("V-65", F.lit(True), F.concat("label", F.lit(".serves")), F.concat(F.lit("quotes the sentence of "), "result", F.lit(" and must serve it")))], place=["rank", "pos"]))

    parts = entries.where(filled("split_from")).groupBy("paper_key", "split_from").agg(F.min_by("quote_key", F.struct("rank", "pos")).alias("quote_key"), F.flatten(F.collect_list("serves")).alias("serving"))
    unserved = parts.join(sentence, ["paper_key", "quote_key"]).where(~F.coalesce(F.array_contains("serving", F.col("result")), F.lit(False)))
    out.append(collect(unserved, [when("V-83", F.lit(True), F.concat(F.lit("split_from "), "split_from"), F.concat(F.lit("no part serves "), "result"))]))
    return reduce(DataFrame.unionByName, out)


def sentence_rules(entries: DataFrame) -> DataFrame:
    """Rules over entries with one sentence, or one split: V-77 to V-81, V-84 to V-87."""
    quoted = entries.where("quote_key is not null")
    use = F.when(F.col("list") == "main_results", "results").when(filled("split_from"), "split").otherwise(F.col("list"))
    rows = quoted.withColumn("use", use).withColumn("place", F.struct("rank", "pos", "label"))
    second = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("place"))))
    results = rows.groupBy("paper_key", "quote_key").agg(second(F.col("use") == "results").alias("r"))
    out = [collect(results.where("size(r) > 1"), [when("V-78", F.lit(True), F.concat(F.col("r")[1]["label"], F.lit(".quote")), F.concat(F.col("r")[0]["label"], F.lit(" already quotes the same sentence")))])]

    by_page = rows.groupBy("paper_key", "quote_key", "page_raw").agg(second(F.col("use").isin("claims", "excluded")).alias("w"), F.array_sort(F.collect_set(F.when(F.col("use") == "split", F.col("split_from")))).alias("s"))
    out.append(collect(by_page, [
        when("V-79", F.size("w") > 1, F.concat(F.get("w", F.lit(1))["label"], F.lit(".quote")), F.concat(F.get("w", F.lit(0))["label"], F.lit(" already quotes the same sentence"))),
        when("V-80", (F.size("w") > 0) & (F.size("s") > 0), F.concat(F.get("w", F.lit(0))["label"], F.lit(".quote")), F.concat(F.lit("the parts of "), F.get("s", F.lit(0)), F.lit(" quote the same sentence"))),
        when("V-81", F.size("s") > 1, F.concat(F.lit("split_from "), F.get("s", F.lit(0))), F.concat(F.get("s", F.lit(1)), F.lit(" quotes the same sentence"))),
    ]))

    covered = rows.where("use = 'results' and lo is not null").select("paper_key", "quote_key", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + 1))).alias("lo"), F.col("label").alias("result"))
    both = rows.where("use = 'excluded'").join(covered.groupBy("paper_key", "quote_key", "lo").agg(F.min("result").alias("result")), ["paper_key", "quote_key", "lo"])
    out.append(collect(both, [when("V-77", F.lit(True), F.concat("label", F.lit(".quote")), F.concat("result", F.lit(" quotes the same sentence on the same page")))], place=["rank", "pos"]))

    parts = entries.where(filled("split_from"))
    groups = parts.groupBy("paper_key", "split_from").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("quote_key", F.lit(""))).alias("quotes"), F.count_distinct(F.coalesce("states_key", F.lit(""))).alias("texts"))
    name = F.concat(F.lit("split_from "), "split_from")
    out.append(collect(groups, [when("V-84", F.col("n") < 2, name, "has no other part"), when("V-85", F.col("quotes") > 1, name, "the parts must share the same quote"), when("V-86", F.col("texts") < F.col("n"), name, "two parts have the same text")]))
    out.append(collect(parts, [when("V-87", filled("states") & (F.col("states_key") == F.col("quote_key")), F.concat("label", F.lit(".states")), "repeats the whole quote")], place=["rank", "pos"]))
    return reduce(DataFrame.unionByName, out)


def quote_rules(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """V-43 to V-51: whether each quote stands where its entry says, and if not, where it does.

    The page that is named is searched first; only quotes that are not there meet all their paper's pages.
    """
    spans = entries.where(F.col("lo").isNotNull() & ((F.col("hi") == F.col("lo")) | (F.col("hi") == F.col("lo") + 1)))
    rows = R.page_spans(spans, pages)
    out = [collect(rows.where("page_text is null"), [when("V-43", F.lit(True), F.concat("label", F.lit(".page")), "names a page that the text does not have")], place=["rank", "pos"])]
    asked = cut(rows.where(F.col("page_text").isNotNull() & filled("quote")).withColumn("on", M.quote_stands(F.col("quote"), F.col("page_text"))).select("paper_key", "rank", "pos", "label", "quote", "page_raw", "lo", "hi", "on"))

    wide = asked.where("on and hi > lo")
    each_page = wide.join(pages.select("paper_key", "page", "text"), "paper_key").where("page between lo and hi").where(M.quote_stands(F.col("quote"), F.col("text")))
    alone = each_page.groupBy("paper_key", "rank", "pos", "label").agg(F.min("page").alias("page"))
    out.append(collect(alone, [when("V-47", F.lit(True), F.concat("label", F.lit(".page")), F.concat(F.lit("the quote is on page "), "page", F.lit(" alone")))], place=["rank", "pos"]))

    gapped = GAPS.verdicts(rows.where(F.col("page_text").isNotNull() & F.col("quote").rlike(GAP)), ["paper_key", "rank", "pos", "label"], "quote", "page_text")
    at = F.concat("label", F.lit(".quote"))
    out.append(collect(gapped, [
        when("V-44", F.col("heading").isNotNull(), at, F.concat(F.lit("a gap skips the heading "), "heading")),
        when("V-45", F.col("heading").isNull() & F.col("two_rows"), at, "starts in one row of a table and ends in another"),
        when("V-46", F.col("heading").isNull() & ~F.col("two_rows") & F.col("prose").isNotNull(), at, F.concat(F.lit("a gap skips running text: "), "prose")),
    ], place=["rank", "pos"]))

    lost = asked.where("not on")
    key = ["paper_key", "rank", "pos", "label", "page_raw"]
    singles = pages.select("paper_key", F.lit(0).alias("wide"), "page", F.col("page").cast("string").alias("name"), "text")
    pairs = R.page_spans(pages.select("paper_key", F.col("page").alias("lo"), (F.col("page") + 1).alias("hi")), pages).where("page_text is not null").select("paper_key", F.lit(1).alias("wide"), F.col("lo").alias("page"), F.concat("lo", F.lit("-"), "hi").alias("name"), F.col("page_text").alias("text"))
    texts = singles.unionByName(pairs).join(lost.select("paper_key").distinct(), "paper_key", "left_semi").withColumn("keys", M.page_keys("text"))
    sought = lost.withColumn("pieces", M.piece_keys("quote")).withColumn("names", _hyphenated(F.col("quote")))
    everywhere = sought.join(texts, "paper_key").withColumn("may", M.may_stand_on(F.col("pieces"), F.col("keys")))
    open_ = lambda c, more=F.lit(True): F.when(F.col("may") & more, F.col(c))
    tried = everywhere.withColumn("there", M.quote_stands(open_("quote"), open_("text")))
    gap = ~F.col("there") & F.col("quote").rlike(GAP)  # without one no other length of gaps finds more
    tried = tried.withColumn("far", M.quote_on_any_gap(open_("quote", gap), open_("text", gap)))
    best = lambda c: F.min(F.when(F.col(c), F.struct("wide", "page", "name")))
    found = tried.groupBy(*key).agg(best("there").alias("there"), best("far").alias("far"), F.max(_digit_dropped(F.col("names"), F.col("text"))).alias("name"))
    where = F.concat("label", F.lit(".quote"))
    out.append(collect(found, [
        when("V-48", F.col("there").isNotNull(), where, F.concat(F.lit("not on page "), "page_raw", F.lit(", but on page "), "there.name")),
        when("V-49", F.col("there").isNull() & F.col("far").isNotNull(), where, F.concat(F.lit("on page "), "far.name", F.lit(", but a gap skips more than "), F.lit(M.MAX_GAP), F.lit(" characters"))),
        when("V-50", F.col("there").isNull() & F.col("far").isNull() & F.col("name").isNotNull(), where, F.concat(F.lit("leaves the digit off "), "name")),
        when("V-51", F.col("there").isNull() & F.col("far").isNull() & F.col("name").isNull(), where, "not found in the text"),
    ], place=["rank", "pos"]))
    return reduce(DataFrame.unionByName, out)


def _hyphenated(quote: Column) -> Column:
    """The hyphenated names in a quote."""
    return F.array_distinct(F.regexp_extract_all(X.ascii_fold(quote), F.lit(r"(?U)[^\W\d_]+(?:-[^\W\d_]+)+"), F.lit(0)))


def _digit_dropped(names: Column, page: Column) -> Column:
    """The first of a quote's hyphenated names that the page writes with a digit after it, and never without."""
    text = X.ascii_fold(page)
    cut_short = F.filter(names, lambda n: F.regexp_like(text, F.concat(F.lit(r"\Q"), n, F.lit(r"\E\d"))) & ~F.regexp_like(text, F.concat(F.lit(r"(?U)\Q"), n, F.lit(r"\E(?![\w-])"))))
    return F.get(F.array_sort(cut_short), F.lit(0))


def validate(records: DataFrame, texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All problems of (paper_key, raw) records with (paper_key, text) page texts, in order of `ord`.

    A record without any is valid. Records that have no text, or are no JSON object, get no other problems.
    files holds the (paper_key, name, sha256) of PDF files beside the records.
    """
    parsed = cut(R.parse(records.join(texts.select("paper_key"), "paper_key", "left_semi")))
    pages = cut(R.pages(R.text_lines(texts)))
    rows = R.entries(parsed.where(R.is_object(F.col("v"))))
    same = F.col("states").eqNullSafe(F.col("quote"))
    keyed = rows.withColumn("quote_key", M.quote_key(F.when(filled("quote"), F.col("quote")))).withColumn("own_key", M.quote_key(F.when(filled("states") & ~same, F.col("states"))))
    entries = cut(keyed.withColumn("states_key", F.when(same, F.col("quote_key")).otherwise(F.col("own_key"))).drop("own_key"))
    parts = [file_rules(records, texts, files), record_rules(parsed), paper_rules(parsed, pages, R.provenance(texts)), raw_rules(records), entry_rules(entries), reference_rules(entries), sentence_rules(entries), quote_rules(entries, pages)]
    ranked = [p.withColumn("phase", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked).select("paper_key", "rule", "label", "message", F.struct("phase", "at", "n").alias("ord"))
