"""Layout steps on pages made by hand."""

from pyspark.sql import functions as F

from claimloom.operators import layout as L
from claimloom.sources import records as R


def table(spark, *pages, paper="p"):
    rows = [(paper, n, i, line) for n, page in enumerate(pages, 1) for i, line in enumerate(page.split("\n"))]
    return spark.createDataFrame(rows, "paper_key string, page int, line_no int, line string")


def pages_of(df):
    out = {}
    for r in df.orderBy("page", "line_no").collect():
        out.setdefault(r.page, []).append(r.line)
    return {n: "\n".join(x) for n, x in out.items()}


BODY = "One line of text here\nand another one of it\nthen a third of them\nthe fourth line of all\nand the last of them"


def test_edges(spark):
    made = table(spark, *(f"A Running Header of Ours {n}\n\n{BODY}\n\n  {n}" for n in (1, 2, 3)), f"{BODY}\n77")
    out = pages_of(L.without_edges(made))
    assert all(out[n] == f"\n\n{BODY}\n\n" for n in (1, 2, 3))
    assert out[4] == f"{BODY}\n77"  # counts up from nothing
    assert L.running_headers(made).collect()[0].norm == "A Running Header of Ours"
    row = table(spark, *(f"Name   Total   Share\n\n{BODY}" for _ in range(3)))
    assert L.running_headers(row).count() == 0


REFS = "R EFERENCES\n[1] A. Smith, Title, Proc. of It, 2001.\n[2] B. Jones, Other, 2002."


def test_bibliography(spark):
    long = "\n".join([BODY] * 3)
    plain = table(spark, long, f"{long}\n{REFS}")
    assert pages_of(L.without_bibliography(plain))[2] == f"{long}\n{L.REMOVED}\n\n"
    appendix = table(spark, long, f"{long}\n{REFS}\nAppendix A Prompts\n{BODY}")
    assert pages_of(L.without_bibliography(appendix))[2] == f"{long}\n{L.REMOVED}\n\n\nAppendix A Prompts\n{BODY}"
    assert L.bibliography(appendix).first().by_appendix
    early = table(spark, f"{REFS}\n{long}", long)
    assert pages_of(L.without_bibliography(early))[1] == f"{L.REMOVED}\n\n\n{long}" and L.bibliography(early).first().resumed
    prompt = table(spark, f"{long}\nReferences:\n[1] A. Smith, Title, 2001.")
    assert L.bibliography(prompt).count() == 0


def test_text_round_trip(spark):
    made = table(spark, "\n\nFirst  \n\n\nsecond\n=== page 9 ===\n\n", "", "third")
    text = L.to_text(made)
    assert text.first().text == "=== page 1 ===\nFirst\n\nsecond\n === page 9 ===\n=== page 2 ===\n=== page 3 ===\nthird\n"
    back = {r.page: r.text for r in R.pages(R.text_lines(text)).collect()}
    assert back[1] == "First\n\nsecond\n === page 9 ===" and back[2] == "" and back[3].rstrip("\n") == "third"


def test_captions_and_report(spark):
    made = table(spark, "Figure 2. A thing\nx", "Fig. 2 again\nTABLE IV Rows\n")
    assert {(r.label, r.page) for r in L.captions(made).collect()} == {("Fig. 2", 1), ("Table IV", 2)}
    r = L.report(made.unionByName(table(spark, "", paper="q").withColumn("page", F.lit(1)))).orderBy("paper_key").collect()
    assert (r[0].pages, r[0].empty_pages, r[0].captions) == (2, 0, 2) and (r[1].pages, r[1].empty_pages, r[1].captions) == (1, 1, 0)


def two_columns(left, right, at=44):
    n = max(len(left), len(right))
    return "\n".join((a.ljust(at) + b).rstrip() for a, b in zip(left + [""] * (n - len(left)), right + [""] * (n - len(right)), strict=True))


def test_columns_and_line_numbers(spark):
    left, right = ([f"{side} column line {w}{v} of it" for w in "abcdefgh" for v in "vwxyz"] for side in ("left", "right"))
    across = "A title that runs right across the whole page and over its gutter too"
    page = f"{across}\n{two_columns(left, right)}"
    numbered = "\n".join(f"{i:3d}   {x}" for i, x in enumerate([f"the text of line {w} goes here" for w in "abcdefghijkl"], 101))
    made = table(spark, page, page).unionByName(table(spark, numbered, paper="q"))
    out = L.reading_order(L.without_line_numbers(made))
    assert pages_of(out.where("paper_key = 'p'"))[2].split("\n") == [across, *left, *right]
    assert [x.strip() for x in pages_of(out.where("paper_key = 'q'"))[1].split("\n")] == [f"the text of line {w} goes here" for w in "abcdefghijkl"]
    plain = table(spark, f"{BODY}\n{BODY}")
    assert pages_of(L.clean(plain)) == pages_of(plain)
    rows = "\n".join(f"{i}   alpha   {i * 3}   beta   {i * 7}" for i in range(1, 12))
    assert pages_of(L.without_line_numbers(table(spark, rows)))[1] == rows
