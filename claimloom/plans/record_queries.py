"""The record model's operators over records read into the driver's tables, with SQL that gives the same.

A customer is a record: priorities of its orders are its results, its order years are claims that serve the
priorities they hold, and dear orders are excluded candidates, which by their status repeat results, break
one down, are part of a split sentence, or stand alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import record_model as M
from ..stages import cut
from . import advise as A
from . import validate as V
from .definitions import anchors

VIEW = """
o AS (SELECT CAST(o_custkey AS VARCHAR) AS paper_key, 'R' || left(o_orderpriority, 1) AS r, CAST(left(o_orderpriority, 1) AS INT) AS n, year(o_orderdate) AS y, o_orderkey, o_orderstatus AS st, o_totalprice AS price FROM orders),
res AS (SELECT DISTINCT paper_key, r AS id, n AS pos FROM o), sv AS (SELECT DISTINCT paper_key, r, 'C' || y AS c FROM o),
ex AS (SELECT paper_key, 'E' || o_orderkey AS id, o_orderkey AS pos, st, n, y, CASE WHEN st = 'F' AND price > 400000 THEN ['R' || n, 'R' || (n % 5 + 1)] WHEN st = 'F' THEN ['R' || n] ELSE [] END AS dups,
  CASE WHEN st = 'O' AND n <= 2 THEN ['R' || n] ELSE [] END AS brk, CASE WHEN st = 'P' THEN 'S' || y END AS split FROM o WHERE price > 250000),
s AS (SELECT paper_key, id, pos, string_agg(c, ',' ORDER BY c) AS claims FROM res JOIN sv USING (paper_key) WHERE sv.r = res.id GROUP BY ALL),
g AS (SELECT *, first_value(id) OVER (PARTITION BY paper_key, claims ORDER BY pos) AS grp FROM s),
d AS (SELECT paper_key, id AS sentence, unnest(dups) AS id FROM ex), m AS (SELECT DISTINCT paper_key, sentence, grp FROM d JOIN g USING (paper_key, id)),
k AS (SELECT paper_key, grp, count(*) AS repeats, count(*) FILTER (n > 1) AS shared FROM (SELECT *, count(*) OVER (PARTITION BY paper_key, sentence) AS n FROM m) GROUP BY ALL),
w AS (SELECT paper_key, grp, string_agg(id, ',' ORDER BY pos) AS members, count(*) + coalesce(any_value(repeats), 0) AS stated_in, coalesce(any_value(shared), 0) AS shared FROM g LEFT JOIN k USING (paper_key, grp) GROUP BY ALL),
p AS (SELECT paper_key, id, grp, row_number() OVER (PARTITION BY paper_key ORDER BY stated_in DESC, pos) AS place FROM g JOIN w USING (paper_key, grp)),
e AS (SELECT paper_key, 'main_results' AS list, 'results' AS section, pos AS lo, pos AS hi FROM res UNION ALL SELECT DISTINCT paper_key, 'claims', 'claims', y, y + 1 FROM o UNION ALL SELECT paper_key, 'excluded', st, n, n FROM ex)
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {VIEW} {sql}"
        return f

    return add


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of all customers' records, as sources.records.entries gives them."""
    number = F.substring("o_orderpriority", 1, 1)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("paper_key"), number.cast("int").alias("n"), F.concat(F.lit("R"), number).alias("r"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("price"))
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")

    def rows(df: DataFrame, rank: int, kind: str, **columns) -> DataFrame:
        defaults = dict.fromkeys(("serves", "duplicate_of", "breaks_down"), none) | dict.fromkeys(("split_from", "source", "reason", "selection_reason", "quote", "states", "note"), text)
        made = df.select("paper_key", F.lit(rank).alias("rank"), F.lit(kind).alias("list"), *((columns.get(c, v)).alias(c) for c, v in {**defaults, **dict.fromkeys(("pos", "id", "section", "lo", "hi"))}.items()))
        return made.withColumns({"pos": F.col("pos").cast("long"), "label": F.concat("list", F.lit("."), "id")})

    results = rows(o.select("paper_key", "n", "r").distinct(), 0, "main_results", pos=F.col("n"), id=F.col("r"), section=F.lit("results"), lo=F.col("n"), hi=F.col("n"), source=F.lit("other"))
    claims = rows(o.groupBy("paper_key", "y").agg(F.sort_array(F.collect_set("r")).alias("serves")), 1, "claims", pos=F.col("y"), id=F.concat(F.lit("C"), "y"), section=F.lit("claims"), lo=F.col("y"), hi=F.col("y") + 1, serves=F.col("serves"))
    repeats = F.when((F.col("st") == "F") & (F.col("price") > 400000), F.array("r", F.concat(F.lit("R"), F.col("n") % 5 + 1))).when(F.col("st") == "F", F.array("r")).otherwise(none)
    excluded = rows(
        o.where("price > 250000"), 2, "excluded", pos=F.col("key"), id=F.concat(F.lit("E"), "key"), section=F.col("st"), lo=F.col("n"), hi=F.col("n"), duplicate_of=repeats, breaks_down=F.when((F.col("st") == "O") & (F.col("n") <= 2), F.array("r")).otherwise(none),
        split_from=F.when(F.col("st") == "P", F.concat(F.lit("S"), "y")), reason=F.when(F.col("n") == 5, "Unsure whether it adds anything").otherwise("It adds nothing"),
    )
    return results.unionByName(claims).unionByName(excluded)


def joined(c: str):
    return F.array_join(c, ",").alias(c)


@query("SELECT paper_key, grp AS first, id AS result, claims FROM g")
def record_one_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.one_result(entries(spark, sf_dir)).select("paper_key", F.col("group").alias("first"), "result", joined("claims"))


@query("SELECT paper_key, grp AS first, members, stated_in, shared FROM w")
def record_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weights(entries(spark, sf_dir)).select("paper_key", F.col("group").alias("first"), joined("members"), F.col("stated_in").cast("long").alias("stated_in"), "shared")


@query("SELECT paper_key, id, place FROM p")
def record_weight_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_weight(entries(spark, sf_dir)).select("paper_key", "id", F.col("place").cast("long").alias("place"))


@query("SELECT paper_key, c AS claim, arg_min(grp, best) AS first, count(*) - 1 AS others FROM (SELECT sv.paper_key, c, grp, min(place) AS best FROM sv JOIN (SELECT paper_key, id AS r, grp FROM p) x USING (paper_key, r) JOIN (SELECT paper_key, grp, min(place) AS place FROM p GROUP BY ALL) y USING (paper_key, grp) GROUP BY ALL) GROUP BY ALL")
def record_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.homes(entries(spark, sf_dir)).select("paper_key", "claim", F.col("group").alias("first"), "others")


@query("SELECT paper_key, section, CAST(min(lo) AS BIGINT) AS first_page, CAST(max(hi) AS BIGINT) AS last_page, count(*) FILTER (list = 'main_results') AS main_results, count(*) FILTER (list = 'claims') AS claims, count(*) FILTER (list = 'excluded') AS excluded FROM e GROUP BY ALL")
def record_section_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.section_strip(entries(spark, sf_dir)).select("paper_key", "section", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"), "main_results", "claims", "excluded")


@query("SELECT paper_key, main_results, claims, excluded, main_results + coalesce(n, 0) AS stated_in FROM (SELECT paper_key, count(*) FILTER (list = 'main_results') AS main_results, count(*) FILTER (list = 'claims') AS claims, count(*) FILTER (list = 'excluded') AS excluded FROM e GROUP BY ALL) LEFT JOIN (SELECT paper_key, count(DISTINCT sentence) AS n FROM m GROUP BY ALL) USING (paper_key)")
def record_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overview(entries(spark, sf_dir)).select("paper_key", "main_results", "claims", "excluded", "stated_in")


@query("SELECT paper_key, r AS target, 'serves' AS rel, string_agg(c, ',' ORDER BY c) AS sources FROM sv GROUP BY ALL UNION ALL SELECT paper_key, d, 'duplicate_of', string_agg(id, ',' ORDER BY pos) FROM (SELECT paper_key, id, pos, unnest(dups) AS d FROM ex) GROUP BY ALL UNION ALL SELECT paper_key, d, 'breaks_down', string_agg(id, ',' ORDER BY pos) FROM (SELECT paper_key, id, pos, unnest(brk) AS d FROM ex) GROUP BY ALL")
def record_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reverse_edges(entries(spark, sf_dir)).select("paper_key", "target", "rel", joined("sources"))


@query("SELECT paper_key, id, CASE WHEN len(dups) > 0 THEN 'repeat' WHEN len(brk) > 0 THEN 'breakdown' WHEN split IS NOT NULL THEN 'part' ELSE 'other' END AS bucket, array_to_string(list_sort(list_concat(dups, brk)), ',') AS weighed FROM ex")
def record_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.candidates(entries(spark, sf_dir)).select("paper_key", "id", "bucket", joined("weighed"))


@query("SELECT paper_key, result, string_agg(x.id, ',' ORDER BY x.pos) AS candidates FROM (SELECT paper_key, id, pos, unnest(list_concat(dups, brk)) AS result FROM ex) x JOIN (SELECT paper_key, id AS result FROM res) USING (paper_key, result) GROUP BY ALL")
def record_considered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.considered(entries(spark, sf_dir)).select("paper_key", "result", joined("candidates"))


@query("SELECT paper_key, split AS split_from, string_agg(id, ',' ORDER BY pos) AS members FROM ex WHERE split IS NOT NULL GROUP BY ALL")
def record_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_groups(entries(spark, sf_dir)).select("paper_key", "split_from", joined("members"))


@query("SELECT paper_key, id FROM ex WHERE n = 5")
def record_unsettled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unsettled(entries(spark, sf_dir)).select("paper_key", "id")


@query("SELECT paper_key, c AS id FROM sv WHERE r = 'R1'")
def record_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.related(entries(spark, sf_dir), "R1").select("paper_key", "id")


@query("SELECT paper_key, id FROM ex WHERE n = 5")
def record_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matching(entries(spark, sf_dir), "Whether IT").select("paper_key", "id")


#: A customer as a record file with its text. Priorities are pages and results, filled orders are claims that serve their
#: priority, dear ones the next; open orders are excluded, dear ones from the wrong page, urgent ones as
#: repeats of the next priority.
FILES = """
t AS (SELECT CAST(o_custkey AS VARCHAR) AS paper_key, o_custkey AS k, CAST(left(o_orderpriority, 1) AS INT) AS n, o_orderkey AS key, o_orderstatus AS st, o_totalprice AS price FROM orders),
r AS (SELECT paper_key, k, n, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS pos FROM (SELECT DISTINCT paper_key, k, n FROM t)),
c AS (SELECT *, CASE WHEN price > 300000 THEN n % 5 + 1 ELSE n END AS served, row_number() OVER (PARTITION BY k ORDER BY key) - 1 AS pos FROM t WHERE st = 'F'),
x AS (SELECT *, CASE WHEN price > 250000 THEN n % 5 + 1 ELSE n END AS page, row_number() OVER (PARTITION BY k ORDER BY key) - 1 AS pos FROM t WHERE st = 'O')
"""


def files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paper_key, raw) and (paper_key, text) of all customers."""
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), n.alias("n"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("price"))
    say = lambda form, *c: F.format_string(form, *c)
    following, n = F.col("n") % 5 + 1, F.col("n")
    line = say("Order %d came with the status %s.", F.col("key"), F.col("st"))
    entry = F.when(F.col("st") == "F", say(
        '{"id": "C%d", "quote": "%s", "states": "%s", "page": %d, "section": "Data", "serves": ["R%d"], "split_from": null, "selection_reason": "R%d rests on what it says."}',
        F.col("key"), line, line, n, F.when(F.col("price") > 300000, following).otherwise(n), n)).when(F.col("st") == "O", F.concat(
        say('{"id": "E%d", "quote": "%s", "page": %d, "section": "Data", "reason": "Describes the data."', F.col("key"), line, F.when(F.col("price") > 250000, following).otherwise(n)),
        F.when(n <= 2, say(', "duplicate_of": ["R%d"]', following)).otherwise(""), F.lit("}")))
    head = say("Priority %d was asked for by customer %d.", n, F.col("k"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("key", "line", "entry"))))
    pages = o.select("*", line.alias("line"), entry.alias("entry")).groupBy("k", "n").agg(listed(F.lit(True)).alias("all"), listed(F.col("st") == "F").alias("claims"), listed(F.col("st") == "O").alias("excluded"))
    result = say('{"id": "R%d", "quote": "%s", "page": %d, "section": "Results", "source": "%s"}', n, head, n, F.when(n == 5, "other").otherwise("abstract"))
    page = F.concat_ws("\n", say("=== page %d ===", n), head, F.array_join(F.col("all")["line"], "\n"))
    together = lambda c: F.array_join(F.array_sort(F.flatten(F.collect_list(c)))["entry"], ", ").alias(c)
    whole = cut(pages.groupBy("k").agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list(F.struct("n", result.alias("s"))))["s"], ", ").alias("results"), together("claims"), together("excluded"), F.array_join(F.array_sort(F.collect_list(F.struct("n", page.alias("s"))))["s"], "\n").alias("body")))  # records and texts are both read several times
    key = F.col("k").cast("string").alias("paper_key")
    title = F.when(F.col("k") % 3 == 0, "Another title").otherwise("Priority was asked for by customer")
    raw = say('{"paper": {"id": "P%d", "title": "%s", "pdf": "p.pdf", "pages": %d}, "main_results": [%s], "claims": [%s], "excluded": [%s]}', F.col("k"), title, F.col("pages") + (F.col("k") % 7 == 0).cast("int"), F.col("results"), F.col("claims"), F.col("excluded"))
    source = F.when(F.col("k") % 2 == 0, say("=== paper p.pdf sha256:%s ===\n", F.sha2(F.col("k").cast("string"), 256))).otherwise("")
    return whole.select(key, raw.alias("raw")), whole.select(key, F.concat(source, "body", F.lit("\n")).alias("text"))


def problem_sql(sql: str) -> str:
    return f"WITH {FILES} SELECT paper_key, rule, label, message FROM ({sql})"


def record_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate(*files(spark, sf_dir)).select("paper_key", "rule", "label", "message")


def record_advise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.advise(*files(spark, sf_dir)).select("paper_key", "rule", "label", "message")


def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as headings of one page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select("doc_id", F.posexplode(anchors("lines")).alias("line", "anchor")).select("doc_id", F.col("line").cast("long").alias("line"), "anchor")


QUERIES |= {f.__name__: f for f in (record_validate, record_advise, heading_anchors)}
SQL["record_validate"] = problem_sql("""
SELECT DISTINCT paper_key, 'V-30' AS rule, 'paper.pages' AS label, 'is not the text''s number of pages' AS message FROM t WHERE k % 7 = 0
UNION ALL SELECT paper_key, 'V-55', 'main_results[' || pos || '] (R5).note', 'source other needs a note' FROM r WHERE n = 5
UNION ALL SELECT paper_key, 'V-82', 'main_results[' || pos || '] (R' || n || ').note', 'no claim serves this main result; a note must say why' FROM r WHERE (k, n) NOT IN (SELECT (k, served) FROM c)
UNION ALL SELECT paper_key, 'V-64', 'claims[' || pos || '] (C' || key || ').serves', 'R' || served || ' is not a main result' FROM c WHERE (k, served) NOT IN (SELECT (k, n) FROM r)
UNION ALL SELECT paper_key, 'V-70', 'excluded[' || pos || '] (E' || key || ').duplicate_of', 'R' || (n + 1) || ' is no entry''s id' FROM x WHERE n <= 2 AND (k, n + 1) NOT IN (SELECT (k, n) FROM r)
UNION ALL SELECT paper_key, 'V-43', 'excluded[' || pos || '] (E' || key || ').page', 'names a page that the text does not have' FROM x WHERE (k, page) NOT IN (SELECT (k, n) FROM r)
UNION ALL SELECT paper_key, 'V-48', 'excluded[' || pos || '] (E' || key || ').quote', 'not on page ' || page || ', but on page ' || n FROM x WHERE page <> n AND (k, page) IN (SELECT (k, n) FROM r)""")
SQL["record_advise"] = problem_sql("""
SELECT DISTINCT paper_key, 'A-04' AS rule, 'text' AS label, 'names no source paper' AS message FROM t WHERE k % 2 = 1
UNION ALL SELECT paper_key, 'A-01', 'paper.title', 'page 1 does not print this title' FROM r WHERE n = 1 AND k % 3 = 0
UNION ALL SELECT paper_key, 'A-12', 'claims[' || pos || '] (C' || key || ').selection_reason', 'names none of the main results it serves' FROM c WHERE served <> n""")
SQL["heading_anchors"] = """
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM a),
c AS (SELECT doc_id, line, CASE WHEN s = '' THEN 'h-' || left(sha256(title), 8) ELSE s END AS s FROM b)
SELECT doc_id, line, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY line) AS n FROM c)"""
