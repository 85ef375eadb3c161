"""The tolerant quote query against the matcher over all pages of all documents."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.functions import matching as M
from claimloom.operators import entries as E
from claimloom.plans import catalogue

PLAIN = "Remote caching halves the median build time without increasing failures of builds"
QUOTES = [PLAIN, "We saw, in all 48 projects [...] that nothing else had changed", "No loss", "3.5 %", "Ein großer Fußweg führt über die Straße", "İlk ısı ölçümleri kışın yapıldı", "   ", None, "It stands nowhere in any of the documents"]
TEXTS = [
    PLAIN, PLAIN.upper(), PLAIN.replace("median", "med-\nian").replace("build ", "build\n"), PLAIN.replace("time", "time12"), PLAIN.replace("halves", "H ALVES"), PLAIN.replace("median", "mean"),
    "one\ntwo\nthree\n" + PLAIN.replace(" the ", "\nthe "), "We saw, in all 48 projects\nof a kind\nthat nothing else had changed", "a NO LOSS b\nof 3.5 % here", "EIN GROSSER FUSSWEG FÜHRT ÜBER DIE STRASSE", "ilk ısı ölçümleri kışın yapıldı",
    "Remote caﬀing", "", None, PLAIN.replace("caching", "cach­ing"),
]


def brute():
    out = set()
    for i, q in enumerate(QUOTES):
        for d, t in enumerate(TEXTS):
            lines = (t or "").split("\n")
            pages = ["\n".join(lines[k : k + 4]) for k in range(0, len(lines), 4)]
            places = [(False, k + 1, p) for k, p in enumerate(pages)] + [(True, k + 1, pages[k] + "\n" + pages[k + 1]) for k in range(len(pages) - 1)]
            found = [(wide, k) for wide, k, p in places if q and M.find_quote(q, p)]
            if found:
                out.add((i, d, *min(found)))
    return out


def test_tolerant_quotes_equal_brute_force(spark, tmp_path):
    spark.createDataFrame(list(enumerate(QUOTES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalogue.quote_match_tolerant(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute()
    exact = {tuple(r) for r in catalogue.quote_match_page(spark, str(tmp_path)).collect()}
    assert exact < set(got) and {(0, d) for d in (0, 1, 2, 3, 6, 14)} <= {r[:2] for r in got}


@pytest.mark.parametrize("key", ["abcdefghijklmno", "the quick brown fox jumps over".replace(" ", ""), "съешьещёэтихмягких"])
def test_anchors_of_a_key_are_among_those_of_what_contains_it(key):
    assert len(M.anchors(key)) and set(M.anchors(key)) <= set(M.anchors("xyz" + key + "zyxw"))
    assert not len(M.anchors(key[: M.ANCHORED - 1]))


def test_contained_against_all_pairs(spark):
    needles = ["b cd e", "cd", "d\ne", "bcdef", "x", "  ", "", None, "a  b c", "b c", "e f zzz g", "ef", "Straße", " a b", "a b ", "cd"]
    texts = ["a b cd e f", "a bcdef g", "d\ne", "cd", "", None, "a  b c", "Hauptstraße Straßen", "x" * 5000 + " bcdefg", "a b ", "a b cd e f"]
    n = spark.createDataFrame(list(enumerate(needles)), "n int, needle string")
    h = spark.createDataFrame(list(enumerate(texts)), "h int, text string")
    want = sorted((i, j) for i, q in enumerate(needles) for j, t in enumerate(texts) if q and q.strip(" ") and t is not None and q in t)
    assert sorted(map(tuple, E.contained(n, h, ("n", "needle"), ("h", "text")).collect())) == want
    long = n.where("size(split(needle, ' ')) > 2")  # no short ones: the vocabulary isn't made
    assert sorted(map(tuple, E.contained(long, h, ("n", "needle"), ("h", "text")).collect())) == [p for p in want if len(needles[p[0]].split(" ")) > 2]
    assert E.contained(n.limit(0), h, ("n", "needle"), ("h", "text")).count() == 0
    assert E.contained(n, h.limit(0), ("n", "needle"), ("h", "text")).count() == 0


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aB1. ,-\n\x1c\u2009(ﬁ’", max_size=24), st.data())
def test_what_stands_literally_is_found(page, data):
    a = data.draw(st.integers(0, len(page)))
    quote = page[a : data.draw(st.integers(a, len(page)))]
    if M.stands_literally(quote, page):
        assert M.find_quote(quote, page) is not None


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aB12. ,-\n\x1c(ﬁ’ßıİ[]…", max_size=24), st.text(alphabet="aB1. ,-\n", max_size=8), st.integers(0, 3), st.data())
def test_keys_and_literal_places_agree_with_the_expression(page, other, change, data):
    a = data.draw(st.integers(0, len(page)))
    part = page[a : data.draw(st.integers(a, len(page)))]
    quote = [part, part.upper(), part.replace("-", "").replace("1", ""), f"{part} [...] {other[:4]}"][change]
    page = f"{other} {page}\n{other}"
    if quote.strip():
        assert M.find_quote(quote, page) == M.search(quote, page)


def test_literal_and_absent_quotes_compile_no_expression():
    page = "\n".join(f"Order {i} came with the status F." for i in range(100))
    M._pattern.cache_clear()
    assert [M.find_quote(f"Order {i} came with the status F.", page) is None for i in (0, 57, 99, 100, 1000)] == [False, False, False, True, True]
    a, b, _ = M.find_quote("Order 57 came with the status F.", page)
    assert page[a:b] == "Order 57 came with the status F." and M._pattern.cache_info().misses == 0


def test_a_batch_of_texts_is_taken_in_slices(spark):
    import numpy as np
    import pyarrow as pa

    texts = [None, "", *(f"{i} remote caching halves the median build time" for i in "abcdefg" * 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string").coalesce(1)
    want = sorted((i, g) for i, t in enumerate(texts) if t is not None for g in M.anchors(M.letters(t)).tolist())
    assert sorted(map(tuple, M.anchor_rows(docs, "d", "t").collect())) == want
    assert sorted(map(tuple, M.letter_rows(docs, "d", "t").collect())) == [(i, M.letters(t)) for i, t in enumerate(texts) if t is not None]
    held = {}

    class Frame:
        schema = docs.schema

        def select(self, *_):
            return self

        def mapInArrow(self, rows, _):
            held["sizes"] = [b.num_rows for b in rows([pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(["x"] * 1000)], ["d", "t"])])]

    M.letter_rows(Frame(), "d", "t")
    assert max(held["sizes"]) <= M.SLICE and sum(held["sizes"]) == 1000


def test_built_in_forms_of_the_matcher_agree_with_it(spark):
    from pyspark.sql import functions as F

    pages = [PLAIN, PLAIN.replace(" the ", "\nthe "), "Order 57 came\nwith it.", "Order 57 came, 3\twith `it`.", "x Order 57", "a word12\nnext [...] one", "Order 57 ̈ came", "", "ﬁne Straße"]
    quotes = [PLAIN, "Order 57", "Order 57 came", "Order 5", "came with it.", "`it`.", "Order [...] came", "a word next", "[...]", "Order  57", " Order 57", "fine strasse", "Straße", "order 57"]
    rows = spark.createDataFrame([(q, p) for q in quotes for p in pages], "q string, p string").withColumns({"pieces": M.piece_keys("q"), "keys": M.page_keys("p")})
    got = rows.withColumn("w", M.as_written(F.col("q"), F.col("p"))).withColumn("s", M.quote_stands(F.col("q"), F.col("p"))).withColumn("m", M.may_stand_on(F.col("pieces"), F.col("keys"))).collect()
    for r in got:
        assert r.s == (M.find_quote(r.q, r.p) is not None), r
        assert not r.w or M.stands_literally(r.q, r.p), r
        assert r.m or not M.may_stand(r.q, r.p), r
    assert sum(r.w for r in got) > 8 and sum(not r.m for r in got) > 40


def test_validation_sends_no_quote_that_stands_as_written_to_python(spark, monkeypatch):
    """Nor one that the keys of a page rule out: an expression is sought in the single pair that is left open."""
    from pyspark.sql import functions as F

    sent = spark.sparkContext.accumulator(0)

    @F.pandas_udf("boolean")
    def count(quotes, pages):
        sent.add(int((quotes.notna() & pages.notna()).sum()))
        return quotes.isna() & False

    monkeypatch.setattr(M, "quote_on", count)
    rows = spark.createDataFrame([(f"Order {i} came.", "\n".join(f"Order {k} came." for k in range(50))) for i in range(50)] + [("order 7 came.", "Order 7 came.")], "q string, p string")
    assert rows.where(M.quote_stands(F.col("q"), F.col("p"))).count() == 50 and sent.value == 1


def test_contained_at_sizes_around_an_anchor_and_among_copies(spark):
    import random

    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ß\n") for _ in range(700))
    texts = [base, base, base[100:], base[:300], base[:300] + "x" + base[300:], "head " * 30 + base[200:230], *(base[k : k + n] for n in (1, 2, 3, 15, 16, 30, 63, 64, 79, 127, 150, E.SHORT - 20, E.SHORT, 250) for k in (0, 11, 333)), base[250:351].upper(), None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pairs = [(i, j) for i, q in enumerate(texts) for j, t in enumerate(texts) if q and t and q.strip(" ") and q in t]
    assert sorted(map(tuple, E.contained(rows, rows, ("i", "t"), ("i", "t")).collect())) == pairs
    assert sorted(map(tuple, E.contained(rows, rows, ("i", "t"), ("i", "t"), longer=True).collect())) == [(i, j) for i, j in pairs if texts[i] != texts[j]]
    for t in filter(None, texts):
        assert t not in base or set(M.byte_anchors(t.encode())) <= set(M.byte_anchors(base.encode()))
        assert len(M.byte_anchors(t.encode())) > 0 or len(t.encode()) < E.SHORT


def test_texts_meet_over_rare_anchors_not_over_their_rarest_words(spark):
    """All words are frequent; no two texts share as much as an anchor but one and the text around it."""
    import random

    r = random.Random(7)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(300)]
    texts.append(f"{texts[0]} and more")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumns({"_a": E.F.xxhash64("t"), "_b": E.F.xxhash64("t"), "_needle": E.F.col("t"), "_text": E.F.col("t")})
    assert E._met_by_anchor(rows, rows, True).distinct().count() <= 2
    assert E.contained(rows, rows, ("i", "t"), ("i", "t"), longer=True).collect() == [(0, 300)]
