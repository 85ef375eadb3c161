"""claims.md: a record as Markdown, one row for each record.

All that needs the whole record is worked out as columns of its entries (groups, weights, homes, reverse
edges); an entry becomes its lines by expressions, and lines are put in order by one grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import record_model as G
from ..sources import records as R
from ..stages import cut


def _lines(*parts: Column | str | None) -> Column:
    """An array of lines; null ones are left out."""
    made = F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts if p is not None))
    return F.filter(made, lambda x: x.isNotNull())


def _line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _if(condition: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), _line(*parts))


def _comma(ids: Column) -> Column:
    return F.array_join(ids, ", ")


def _block(rows: DataFrame, part: int, order: list[Column], lines: Column) -> DataFrame:
    """(paper_key, part, order keys, lines): lines of one kind of block."""
    padded = [c.cast("int") for c in order] + [F.lit(0)] * (3 - len(order))
    return rows.select("paper_key", F.lit(part).alias("part"), *(c.alias(f"o{i}") for i, c in enumerate(padded)), lines.alias("lines"))


def markdown(records: DataFrame) -> DataFrame:
    """(paper_key, markdown) of valid (paper_key, raw) records."""
    parsed = cut(R.parse(records))
    entries = cut(R.entries(parsed))
    flat = lambda c: X.one_line(F.coalesce(F.col(c), F.lit("")))
    page = F.coalesce("lo", F.lit(0))
    p = lambda f, kind="string": F.try_variant_get("v", f"$.paper.{f}", kind)
    counts = G.overview(entries)
    head = parsed.join(counts, "paper_key", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    doi = F.when(p("doi").isNotNull(), F.concat(F.lit(", DOI [`"), p("doi"), F.lit("`](https://doi.org/"), F.replace(F.replace(F.replace(F.replace(F.replace(p("doi"), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), F.lit("#"), F.lit("%23")), F.lit("["), F.lit("%5B")), F.lit("]"), F.lit("%5D")), F.lit(")"))).otherwise("")
    blocks = [
        _block(head, 0, [], _lines(
            _line("# Claims: ", X.one_line(p("title"))), "",
            _line("Paper `", p("id"), "` (", p("pages"), " pages, `", p("pdf"), "`", doi, "): ", n("main_results"), " main results, ", n("claims"), " claims, ", n("excluded"), " excluded claim candidates."), "",
            "Generated from `claims.json`. To change the record, edit `claims.json` and render again.", "", "## Main results", "", _if(n("main_results") == 0, "None recorded.\n"))),
        _block(head, 2, [], _lines("## Claims", "", _if(n("claims") == 0, "None selected.\n"), _if(n("claims") > 0, "Grouped under each main result they serve, the result the paper states in the most places first. Within a result the claims stand in page order, because the paper puts no order on them.\n"))),
        _block(head.where(n("claims") > 0), 4, [], _lines("### Every claim", "")),
        _block(head, 6, [], _lines("## Excluded claim candidates", "", _if(n("excluded") == 0, "None recorded.\n"))),
    ]
    note = _if(F.col("note").isNotNull() & (F.col("note") != ""), "- Note: ", flat("note"))
    quote = _line("> ", flat("quote"))

    serving = G.reverse_edges(entries).where("rel = 'serves'").select("paper_key", F.col("target").alias("id"), F.col("sources").alias("serving"))
    results = G.results(entries).join(serving, ["paper_key", "id"], "left")
    blocks.append(_block(results, 1, [F.col("pos")], _lines(
        _line("### ", F.col("id"), ": ", F.col("source"), ", page ", F.col("page_raw")), "", quote, "", _line("- Section: ", flat("section")),
        _line("- Claims: ", F.coalesce(_comma(F.col("serving")), F.lit("none selected"))),
        _if(F.col("states").isNotNull() & (flat("states") != flat("quote")), "- States: ", flat("states")), note, "")))

    placed = cut(G.by_weight(entries))
    lead = placed.groupBy("paper_key", "group").agg(F.min("place").alias("place"), *(F.min_by(c, "place").alias(c) for c in ("id", "source", "quote", "stated_in", "shared", "members")))
    met = G.served(entries).join(G.one_result(entries).select("paper_key", "group", "result"), ["paper_key", "result"]).select("paper_key", "claim", "group").distinct()
    elsewhere = met.groupBy("paper_key", "claim").agg((F.count("*") - 1).alias("others"))
    claims = entries.where("list = 'claims'").select("paper_key", F.col("id").alias("claim"), "pos", page.alias("page"), "page_raw")
    per_group = met.join(elsewhere, ["paper_key", "claim"]).join(claims, ["paper_key", "claim"]).groupBy("paper_key", "group").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "claim", "page_raw", "others"))).alias("held"))
    grouped = lead.join(per_group, ["paper_key", "group"])
    size = F.size("held")
    also = F.array_remove(F.col("members"), F.col("id"))
    one = lambda c: F.concat(F.lit("- "), c["claim"], F.lit(", page "), c["page_raw"], F.when(size == 1, F.lit(", the only claim for this result")).otherwise(F.concat(F.lit(", 1 of "), size, F.lit(" for this result"))), F.when(c["others"] > 0, F.concat(F.lit(", and of "), c["others"], F.lit(" other result"), F.when(c["others"] > 1, F.lit("s")).otherwise(""))).otherwise(""))
    title = _line("### ", F.col("id"), " (", F.col("source"), ", stated in ", F.col("stated_in"), " place", F.when(F.col("stated_in") > 1, "s").otherwise(""), F.when(F.col("shared") > 0, F.concat(F.lit(", "), "shared", F.lit(" shared with another result"))).otherwise(""), F.when(F.size(also) > 0, F.concat(F.lit(", also stated as "), _comma(also))).otherwise(""), "): ", flat("quote"))
    blocks.append(_block(grouped, 3, [F.col("place")], F.concat(F.array(title, F.lit("")), F.transform("held", one), F.array(F.lit("")))))

    splits = G.split_groups(entries)
    parts = entries.where("list <> 'main_results'").join(splits, ["paper_key", "split_from"], "left")
    split = F.col("split_from").isNotNull()
    others = F.array_remove(F.col("members"), F.col("id"))
    blocks.append(_block(parts.where("list = 'claims'"), 5, [page, F.col("pos")], _lines(
        _line("#### ", F.col("id"), ": page ", F.col("page_raw"), ", ", flat("section")), "", quote, "", _if(split, "- Part: ", flat("states")), _if(split, "- Split from ", F.col("split_from"), ", with ", _comma(others)),
        _line("- Serves: ", _comma(F.col("serves"))), _line("- Selection reason: ", flat("selection_reason")), note, "")))
    blocks.append(_block(parts.where("list = 'excluded'"), 7, [page, F.col("pos")], _lines(
        _line("### ", F.col("id"), ": page ", F.col("page_raw"), ", ", flat("section")), "", quote, "", _if(split, "- Excluded part: ", flat("states"), " (split from ", F.col("split_from"), ")"),
        _if(F.size("duplicate_of") > 0, "- Repeats: ", _comma(F.col("duplicate_of"))), _if(F.size("breaks_down") > 0, "- Breaks down: ", _comma(F.col("breaks_down"))),
        _line("- Reason: ", flat("reason")), note, "")))

    rows = reduce(DataFrame.unionByName, blocks)
    ordered = F.array_sort(F.collect_list(F.struct("part", "o0", "o1", "o2", "lines")))
    return rows.groupBy("paper_key").agg(F.concat(F.regexp_replace(F.array_join(F.flatten(F.transform(ordered, lambda x: x["lines"])), "\n"), r"\s+\z", ""), F.lit("\n")).alias("markdown"))
