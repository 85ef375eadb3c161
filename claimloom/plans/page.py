"""claims.html and the index of a site, one row for each record; text is escaped where it enters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import record_model as G
from ..sources import records as R
from ..stages import cut

BUCKETS = [("repeat", "Repeats a recorded statement"), ("breakdown", "Breaks a main result into parts"), ("part", "Another part of a split sentence"), ("standing", "Leaves its main result standing"), ("other", "Excluded on the ground its reason gives")]  # fixed values
STYLE = "body{font:16px/1.5 system-ui;margin:2rem auto;max-width:60rem;padding:0 1rem}article{border:1px solid #ccc;border-radius:.4rem;margin:.6rem 0;padding:.6rem}.id{font-weight:700}.stat{display:inline-block;margin-right:2rem}[hidden]{display:none}"
SCRIPT = "const box=document.getElementById('find');const show=()=>{const t=box.value.toLowerCase();const n=document.getElementById('noted').checked;for(const a of document.querySelectorAll('article'))a.hidden=!a.textContent.toLowerCase().includes(t)||(n&&!a.querySelector('.note'))};box.oninput=show;document.getElementById('noted').onchange=show;"


def esc(c: Column) -> Column:
    out = F.coalesce(c, F.lit("")).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def flat(c: str) -> Column:
    return esc(X.one_line(F.coalesce(F.col(c), F.lit(""))))


def field(name: str, c: Column, css: str = "field") -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", cat(f'<p class="{css}"><b>{name}</b> ', c, "</p>")).otherwise("")


def links(ids: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.concat(F.lit('<a href="#'), esc(i), F.lit('">'), esc(i), F.lit("</a>"))), " ")


def _gather(rows: DataFrame, order: list[str], name: str, piece: Column) -> DataFrame:
    made = rows.select("paper_key", *(F.col(c).cast("int").alias(f"o{i}") for i, c in enumerate(order)), piece.alias("piece"))
    return made.groupBy("paper_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct(*[f"o{i}" for i in range(len(order))], "piece")))["piece"], "").alias(name))


def html(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(paper_key, html) of valid (paper_key, raw) records; a paper's PDF is linked where files, the
    (paper_key, name) of those that stand beside the pages, has it."""
    parsed = cut(R.parse(records))
    entries = cut(R.entries(parsed).withColumn("page", F.coalesce("lo", F.lit(0))))
    back = G.reverse_edges(entries)
    edge = lambda rel, name: back.where(F.col("rel") == rel).select("paper_key", F.col("target").alias("id"), F.col("sources").alias(name))
    splits = G.split_groups(entries).select("paper_key", "split_from", F.col("members"))
    rows = reduce(lambda d, e: d.join(e, ["paper_key", "id"], "left"), [edge("serves", "served_by"), edge("duplicate_of", "repeated_by"), edge("breaks_down", "broken_by")], entries).join(splits, ["paper_key", "split_from"], "left")
    card = lambda *body: cat('<article id="', esc(F.col("id")), '"><span class="id">', esc(F.col("id")), "</span> p. ", esc(F.col("page_raw")), ", ", flat("section"), "<blockquote>", flat("quote"), "</blockquote>", *body, field("Note", flat("note"), "note"), "</article>")
    others = F.array_remove(F.coalesce("members", F.array().cast("array<string>")), F.col("id"))
    turned = [field("Repeated by", links(F.col("repeated_by"))), field("Broken down by", links(F.col("broken_by")))]

    placed = cut(G.by_weight(entries))
    results = _gather(rows.join(placed.select("paper_key", "id", "place"), ["paper_key", "id"]), ["place"], "results_html", card(field("Source", esc(F.col("source"))), field("States", flat("states")), field("Claims", links(F.col("served_by"))), *turned))
    claims = _gather(rows.where("list = 'claims'"), ["page", "pos"], "claims_html", card(F.when(F.col("split_from").isNotNull(), field("Part", flat("states"))).otherwise(""), field("Serves", links(F.col("serves"))), field("Selected because", flat("selection_reason")), field("Split with", links(others)), *turned))

    bucketed = rows.where("list = 'excluded'").join(G.candidates(entries).select("paper_key", "id", "bucket", "weighed"), ["paper_key", "id"])
    number = F.array_position(F.array(*(F.lit(b) for b, _ in BUCKETS)), F.col("bucket"))
    body = card(field("Reason", flat("reason")), field("Weighed against", links(F.col("weighed"))), field("Part", flat("states")), field("Split with", links(others)))
    in_bucket = bucketed.select("paper_key", number.cast("int").alias("number"), "page", "pos", body.alias("piece")).groupBy("paper_key", "number").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "piece"))).alias("cards"))
    title = F.element_at(F.array(*(F.lit(t) for _, t in BUCKETS)), F.col("number"))
    candidates = _gather(in_bucket, ["number"], "candidates_html", cat("<h3>", title, " (", F.size("cards"), ")</h3>", F.array_join(F.col("cards.piece"), "")))

    lead = placed.groupBy("paper_key", "group").agg(F.min("place").alias("place"), *(F.min_by(c, "place").alias(c) for c in ("id", "quote", "stated_in", "shared", "members")))
    shown = rows.where("list = 'claims'").select("paper_key", F.col("id").alias("claim"), "page", "pos", X.snippet(X.one_line(F.coalesce("states", F.lit(""))), 170).alias("states"))
    held = G.homes(entries).join(shown, ["paper_key", "claim"]).groupBy("paper_key", "group").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "claim", "states"))).alias("held"))
    node = lambda c: cat('<li><a href="#', esc(c["claim"]), '">', esc(c["claim"]), "</a> ", esc(c["states"]), "</li>")
    row = cat("<section><h3>", links(F.col("members")), " ", flat("quote"), "</h3><p>stated in ", F.col("stated_in"), " sentences", F.when(F.col("shared") > 0, cat(", ", F.col("shared"), " shared with another result")).otherwise(""), "</p><ul>", F.coalesce(F.array_join(F.transform("held", node), ""), F.lit("<li>No claim is filed here.</li>")), "</ul></section>")
    chart = _gather(lead.join(held, ["paper_key", "group"], "left"), ["place"], "chart", row)

    marks = entries.groupBy("paper_key", "section").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.array_sort(F.collect_list(F.struct("page", "rank", G.id_number("id").alias("n"), "id")))["id"].alias("ids"))
    span = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(cat(F.col("first"), "–", F.col("last")))
    named = marks.withColumn("piece", cat("<tr><td>", esc(F.col("section")), "</td><td>", span, "</td><td>", links(F.col("ids")), "</td></tr>"))
    strip = named.groupBy("paper_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", "section", "piece")))["piece"], "").alias("strip"))

    page = reduce(lambda d, e: d.join(e, "paper_key", "left"), [G.overview(entries), results, claims, candidates, chart, strip], parsed)
    p = lambda f: esc(F.try_variant_get("v", f"$.paper.{f}", "string"))
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    pdf = p("pdf")
    if files is not None:
        beside = files.groupBy("paper_key").agg(F.collect_set("name").alias("beside"))
        page = page.join(beside, "paper_key", "left")
        raw = F.try_variant_get("v", "$.paper.pdf", "string")
        pdf = F.when(F.coalesce(F.array_contains("beside", raw), F.lit(False)), cat('<a href="', F.replace(F.url_encode(raw), F.lit("+"), F.lit("%20")), '">', pdf, "</a>")).otherwise(pdf)
    stats = cat(*(x for c, name in [*((x, x.replace("_", " ")) for x in R.LISTS), ("stated_in", "sentences stating a result")] for x in ('<span class="stat"><b>', F.coalesce(F.col(c), F.lit(0)), f"</b> {name}</span>")))
    doi = F.when(p("doi") != "", cat(', DOI <a href="https://doi.org/', p("doi"), '">', p("doi"), "</a>")).otherwise("")
    return page.select("paper_key", cat(
        '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>', p("title"), f"</title><style>{STYLE}</style></head><body><h1>", p("title"), "</h1><p>", p("id"), ", ", p("pages"), " pages, ", pdf, doi, "</p>",
        "<p>", stats, '</p><p><input id="find" placeholder="Filter"> <label><input id="noted" type="checkbox"> with a note</label></p>',
        "<h2>Claim map</h2>", some("chart"), "<h2>Sections</h2><table>", some("strip"), "</table><h2>Main results</h2>", some("results_html"), "<h2>Claims</h2>", some("claims_html"), "<h2>Excluded claim candidates</h2>", some("candidates_html"), f"<script>{SCRIPT}</script></body></html>\n",
    ).alias("html"))


def index(records: DataFrame) -> DataFrame:
    """(paper_key, paper_id, title, pages, counts, stated_in, place): a site's papers by title, without
    its leading marks and whatever its case."""
    from ..operators.entries import ranked

    parsed = R.parse(records)
    counts = G.overview(R.entries(parsed))
    p = lambda f: F.try_variant_get("v", f"$.paper.{f}", "string")
    rows = parsed.select("paper_key", p("id").alias("paper_id"), p("title").alias("title"), p("pages").cast("int").alias("pages")).join(counts, "paper_key", "left").fillna(0, [*R.LISTS, "stated_in"])
    return ranked(rows, [F.lower(F.regexp_replace("title", r"(?U)^[\W_]+", "")).asc(), F.col("paper_id").asc()], "place")


def definitions_html(body: str) -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Definitions</title><style>{STYLE}</style></head><body><p><a href="../index.html">All papers</a></p>{body}</body></html>\n'


def index_html(records: DataFrame, defined: bool = False) -> str:
    """The site's front page. Its rows come to the driver one at a time; a site's papers are few."""
    rows = index(records)
    line = cat('<tr><td><a href="', esc(F.col("paper_id")), '/claims.html">', esc(F.col("title")), "</a></td><td>", F.col("main_results"), "</td><td>", F.col("claims"), "</td><td>", F.col("excluded"), "</td><td>", F.col("stated_in"), "</td></tr>")
    more = '<p><a href="definitions/index.html">Definitions</a></p>' if defined else ""
    body = "".join(r.line for r in rows.orderBy("place").select(line.alias("line")).toLocalIterator())
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Papers</title><style>{STYLE}</style></head><body><h1>Papers</h1>{more}<table><tr><th>Paper</th><th>Main results</th><th>Claims</th><th>Excluded</th><th>Sentences</th></tr>{body}</table></body></html>\n'
