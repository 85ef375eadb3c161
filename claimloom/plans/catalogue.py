"""The operators over the driver's tables, each with SQL that gives the same rows.

The tables hold no claim records, so a record is read into them: a document is a paper, its lines are four
to a page, benchmark passages are quotes, labels are decisions, and customers with their order
priorities are claims with the results they serve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import text as X
from ..operators import entries as E
from ..operators import lines as L
from ..sources import records as R
from ..stages import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINES = "l AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL))"
FOUND = "f AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> '')"
SUPPORT = "s AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS support FROM orders GROUP BY 1), g AS (SELECT support, count(*) AS n, min(id) AS first FROM s GROUP BY 1)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_lines(read(spark, sf_dir, "documents"), "doc_id", "text")


def found_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.contained(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), ("item_id", "text"), ("doc_id", "text")).toDF("item_id", "doc_id")


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_support(read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(line_no // 4 + 1 AS BIGINT) AS page, line FROM l")
def doc_lines_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running page number: every fourth line carries a marker, and lines take the last one above."""
    marked = doc_lines(spark, sf_dir).withColumn("marker", F.when(F.col("line_no") % 4 == 0, F.expr("line_no div 4 + 1")))
    paged = L.carry_forward(marked, F.col("marker"), "page", ["doc_id"], ["line_no"])
    return paged.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("page").cast("long").alias("page"), "line")


@query(f"WITH {FOUND} SELECT * FROM f")
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_quotes(spark, sf_dir)


@query("SELECT item_id, text FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def quote_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dangling(read(spark, sf_dir, "benchmark").select("item_id", "text"), found_quotes(spark, sf_dir), "item_id")


@query(f"WITH {FOUND} SELECT item_id, min(doc_id) AS doc_id, min(len(string_split(left(d.text, strpos(d.text, b.text) - 1), chr(10))) - 1) // 4 + 1 AS page FROM f JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE (item_id, doc_id) IN (SELECT (item_id, min(doc_id)) FROM f GROUP BY item_id) GROUP BY item_id")
def quote_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the first document that a quote starts on."""
    first = found_quotes(spark, sf_dir).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    placed = first.join(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")), "item_id").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines_before = F.size(F.split(F.substring("text", F.lit(1), F.call_function("instr", F.col("text"), F.col("quote")) - 1), "\n", -1)) - 1
    return placed.select("item_id", "doc_id", (F.floor(lines_before / 4) + 1).cast("long").alias("page"))


@query(f"WITH {LINES} SELECT line, count(DISTINCT doc_id) AS n FROM l GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeated(doc_lines(spark, sf_dir), "line", "doc_id", 3)


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS down FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, 'top' AS edge, line FROM r WHERE up = 1 UNION ALL SELECT doc_id, CAST(line_no AS BIGINT), 'bottom', line FROM r WHERE down = 1")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edge_rows(doc_lines(spark, sf_dir), ["doc_id"], ["line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "edge", "line")


@query("SELECT sha256(text) AS quote_key, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the same quote, by its digest: the texts themselves are not shuffled."""
    keyed = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("quote_key"))
    return keyed.groupBy("quote_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT a.doc_id AS inner_id, b.doc_id AS outer_id FROM documents a JOIN documents b ON a.doc_id <> b.doc_id AND length(a.text) < length(b.text) AND contains(b.text, a.text) WHERE trim(a.text) <> ''")
def substring_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return E.contained(docs, docs, ("doc_id", "text"), ("doc_id", "text"), longer=True).toDF("inner_id", "outer_id").where("inner_id <> outer_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dangling_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dangling(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT * FROM (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS owner FROM lineitem) WHERE owner > 1")
def duplicate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return E.repeated_ids(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"]).withColumn("owner", F.col("owner").cast("long"))


@query("SELECT event_id, list_contains(json_keys(props), 'k') IS NOT TRUE AS missing, len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 AS unknown FROM events WHERE props IS NOT NULL")
def missing_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without the required field, or with one that isn't allowed."""
    keys = F.json_object_keys("props")
    rows = read(spark, sf_dir, "events").where("props is not null").select("event_id", keys.alias("keys"))
    return rows.select("event_id", (~F.coalesce(F.array_contains("keys", "k"), F.lit(False))).alias("missing"), (F.coalesce(F.size(F.array_except("keys", F.array(F.lit("k")))), F.lit(0)) > 0).alias("unknown"))


@query(f"WITH {SUPPORT} SELECT array_to_string(support, ',') AS support, n, first FROM g")
def same_support_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supports(spark, sf_dir).withColumn("support", F.array_join("support", ","))


@query(f"WITH {SUPPORT} SELECT a.first AS narrow, b.first AS wide FROM g a JOIN g b ON len(a.support) < len(b.support) AND len(list_intersect(a.support, b.support)) = len(a.support)")
def breakdown_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.proper_subsets(supports(spark, sf_dir), "support", "first")


@query(f"WITH {SUPPORT}, p AS (SELECT a.first AS a, b.first AS b, len(a.support) AS na, len(b.support) AS nb, len(list_intersect(a.support, b.support)) AS s FROM g a JOIN g b ON a.first < b.first) SELECT a, b, s / (na + nb - s) AS jaccard FROM p WHERE s < na AND s < nb AND s / (na + nb - s) >= 0.5")
def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overlapping(supports(spark, sf_dir), "support", "first", 0.5)


@query(f"WITH {SUPPORT}, m AS (SELECT support, first, id FROM g JOIN s USING (support)), w AS (SELECT b.first AS wide, a.first AS narrow, len(a.support) AS n FROM g a JOIN g b ON len(a.support) < len(b.support) AND len(list_intersect(a.support, b.support)) = len(a.support)) SELECT narrow, max_by(wide, (len(support), -wide)) AS wide FROM w JOIN g ON g.first = w.wide GROUP BY narrow")
def widest_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest set around each narrower one; ties to the smaller id."""
    g = supports(spark, sf_dir)
    pairs = E.proper_subsets(g, "support", "first").join(g.select(F.col("first").alias("wide"), F.size("support").alias("size")), "wide")
    return pairs.groupBy("narrow").agg(F.max_by("wide", F.struct("size", -F.col("wide"))).alias("wide"))


@query("SELECT min(doc_id) AS first, count(*) AS stated_in, count(DISTINCT source) AS sections FROM documents WHERE text IS NOT NULL GROUP BY text")
def stated_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("stated_in"), F.count_distinct("source").alias("sections")).drop("k")


@query("SELECT first, stated_in, row_number() OVER (ORDER BY stated_in DESC, lang, first) AS weight FROM (SELECT min(doc_id) AS first, count(*) AS stated_in, min(lang) AS lang FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def weight_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated statements by falling number of places, then section, then id.

    The rank over all rows is a range partitioning with each partition's count carried on, not one
    window in one task.
    """
    keyed = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    groups = keyed.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("stated_in"), F.min("lang").alias("lang")).where("stated_in > 1")
    return E.ranked(groups.select("first", "stated_in", "lang"), [F.desc("stated_in"), F.col("lang").asc_nulls_last(), F.col("first").asc()], "weight").select("first", "stated_in", "weight")


@query("SELECT 'R' || item_id AS id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark")
def natural_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("R"), "item_id").alias("id"))
    return E.ranked(ids.withColumn("_n", X.natural_number(F.col("id"))), [F.substring("id", 1, 1).asc(), F.col("_n").asc()], "place").select("id", "place")


@query("SELECT source, min(doc_id) AS first_page, max(doc_id) AS last_page, count(*) AS n, count(*) FILTER (quality = 1) AS claims, count(*) FILTER (quality = 0) AS excluded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def section_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"), F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("claims"), F.count_if(F.col("quality") == 0).alias("excluded"))


@query("SELECT o_custkey, min(o_orderpriority) AS home, count(DISTINCT o_orderpriority) - 1 AS others FROM orders GROUP BY o_custkey")
def home_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim is filed under the first of the results it serves."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("home"), (F.count_distinct("o_orderpriority") - 1).alias("others"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)")
def edge_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return L.next_number(rows, ["l_orderkey"], "l_linenumber", "l_orderkey")


@query(f"WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM l), h AS (SELECT *, rn - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM n WHERE len(list_filter(string_split(line, ' '), lambda x: x <> '')) >= 4) SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first, CAST(max(line_no) AS BIGINT) AS last, count(*) AS length FROM h GROUP BY doc_id, island")
def run_length_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = F.size(F.filter(F.split("line", " ", -1), lambda w: w != "")) >= 4
    runs = L.islands(doc_lines(spark, sf_dir), prose, ["doc_id"], ["line_no"])
    return runs.select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "length")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, coalesce(string_agg(line, '|') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS following FROM l WHERE trim(line) <> ''")
def forward_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).where(F.trim("line") != "")
    return L.forward_frame(lines, F.col("line"), 3, "next", ["doc_id"], ["line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("next", "|").alias("following"))


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM l")
def heading_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last short line at or above every line."""
    lines = doc_lines(spark, sf_dir)
    marks = lines.where(F.length("line") < 40).select("doc_id", "line_no", F.col("line").alias("heading"))
    return L.as_of(lines.select("doc_id", "line_no"), marks, "doc_id", "line_no", "heading").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "heading")


@query(f"WITH {LINES}, r AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM l WHERE trim(line) <> '') SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, rank, total FROM r WHERE 3 * rank < 2 * total")
def position_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = L.position_share(doc_lines(spark, sf_dir).where(F.trim("line") != ""), ["doc_id"], ["line_no"])
    return placed.where("3 * rank < 2 * total").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("rank").cast("long").alias("rank"), "total")


@query(f"WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, n FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE NOT regexp_matches(line, '[.]$')) WHERE n <= 3")
def first_three_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_lines = doc_lines(spark, sf_dir).where(~F.col("line").rlike("[.]$"))
    return E.first_n(open_lines, 3, ["doc_id"], ["line_no"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("n").cast("long").alias("n"))


@query("SELECT doc_id, 'unlabelled' AS rule, 1 AS ord FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'repeated', 2 FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of two rules in one table, in the order of the rules."""
    docs = read(spark, sf_dir, "documents")
    first = E.dangling(docs.select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", F.lit("unlabelled").alias("rule"), F.lit(1).alias("ord"))
    keyed = docs.where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    again = keyed.groupBy("k").count().where("count > 1").select("k")
    return first.unionByName(keyed.join(again, "k", "left_semi").select("doc_id", F.lit("repeated").alias("rule"), F.lit(2).alias("ord")))


@query(r"SELECT conv_id, turn, true AS forward, list_position(w, w[-1]) < len(w) + 1 - list_position(list_reverse(w), w[1]) AS backward FROM (SELECT conv_id, turn, regexp_extract_all(lower(replace(text, '-', ' ')), '[\p{L}\p{N}]+(?:[.,][0-9]+)*') AS w FROM conversations WHERE text IS NOT NULL) WHERE len(w) > 1")
def subsequence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn's first and last words stand in its order of words (always), and in reverse."""
    w = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", X.words(F.col("text")).alias("w")).where("size(w) > 1")
    ends = F.array(F.element_at("w", 1), F.element_at("w", -1))
    return w.select("conv_id", "turn", X.in_order(ends, F.col("w")).alias("forward"), X.in_order(F.reverse(ends), F.col("w")).alias("backward"))


@query(rf"WITH {LINES}, c AS (SELECT doc_id, line_no, line, len(regexp_extract_all(line, '\p{{L}}')) AS letters, len(regexp_extract_all(line, '\p{{Lu}}')) AS capitals FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN letters > 0 AND 10 * capitals >= 7 * letters THEN 'shout' WHEN regexp_matches(line, '[0-9]') THEN 'number' WHEN regexp_matches(line, '[.!?:;)\]]$') THEN 'prose' ELSE 'other' END AS kind FROM c")
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(X.shouts(F.col("line")), "shout").when(F.col("line").rlike("[0-9]"), "number").when(F.col("line").rlike(r"[.!?:;)\]]$"), "prose").otherwise("other")
    return doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), kind.alias("kind"))


@query(r"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(replace(text, '-', ' ')), '[\p{L}\p{N}]+(?:[.,][0-9]+)*') AS w FROM documents WHERE text IS NOT NULL)")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.words(X.ascii_fold(F.col("text")))
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", w.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)\bthe\b')")
def unsure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where(F.col("text").rlike(r"(?i)\bthe\b")).select("conv_id", "turn")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(list_filter(regexp_split_to_array(text, '[ ' || chr(10) || ']+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.digests(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {LINES} SELECT line AS label, min(line_no // 4 + 1) AS page, count(*) AS n FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+[.]$') GROUP BY line")
def caption_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of every label: here, lines of a single capitalised word."""
    labels = doc_lines(spark, sf_dir).where(F.col("line").rlike("^[A-Z][a-z]+[.]$"))
    return labels.groupBy(F.col("line").alias("label")).agg(F.min(F.expr("line_no div 4 + 1")).cast("long").alias("page"), F.count("*").alias("n"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality AS before, b.quality AS after FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS quality FROM labels WHERE doc_id % 3 <> 1) b ON a.doc_id = b.doc_id WHERE a.quality IS DISTINCT FROM b.quality")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the labels, one edited: rows that one lacks or that changed. (The remainders
    make the snapshots; they don't thin out a query.)"""
    labels = read(spark, sf_dir, "labels")
    edited = labels.withColumn("quality", F.when(F.col("toxic") == 1, F.lit(0)).otherwise(F.col("quality")))
    return E.changes(labels.where("doc_id % 3 <> 0"), edited.where("doc_id % 3 <> 1"), "doc_id", "quality")


@query("SELECT source, count(*) AS papers, count(quality) AS labelled, sum(n_chars) AS chars, regexp_replace(lower(source), '^[^a-z0-9]+', '') AS title FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    title = F.regexp_replace(F.lower("source"), "^[^a-z0-9]+", "")
    return rows.groupBy("source").agg(F.count("*").alias("papers"), F.count("quality").alias("labelled"), F.sum("n_chars").alias("chars")).withColumn("title", title).orderBy("title")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("WITH c AS (SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT roles, count(*) AS conversations, sum(n) AS turns FROM c GROUP BY roles")
def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one parent in order as one value, and parents grouped by it."""
    one = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"], ",").alias("roles"))
    return one.groupBy("roles").agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"))


@query("SELECT lower(source) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def id_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.lower("source").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 40)")
def unserved_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(read(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT source, max_by(lang, (n, lang)) AS lang, max(n) AS votes FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common value of each part; ties to the later one in order."""
    counts = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("votes"))


@query(r"SELECT doc_id, CAST(len(v) AS BIGINT) AS n, list_sum(v) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\b[0-9]{1,4}\b'), lambda x: CAST(x AS DOUBLE)) AS v FROM documents) WHERE len(v) >= 2")
def parts_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text names, added up."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,4}\b"), F.lit(0)), lambda x: x.cast("double"))
    rows = read(spark, sf_dir, "documents").select("doc_id", numbers.alias("v")).where("size(v) >= 2")
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(r"SELECT conv_id, turn, CASE WHEN length(text) <= 90 THEN text ELSE left(regexp_replace(left(text, 91), '\s+\S*$', ''), 90) || '…' END AS preview FROM conversations")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.snippet(F.col("text"), 90).alias("preview"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations")
def one_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.one_line(F.col("text")).alias("line"))


@query("SELECT l_partkey AS target, array_to_string(list(l_suppkey ORDER BY l_orderkey, l_linenumber, l_suppkey), ',') AS sources FROM lineitem GROUP BY l_partkey")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What points at each target, in order."""
    rows = read(spark, sf_dir, "lineitem")
    grouped = rows.groupBy(F.col("l_partkey").alias("target")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey")))["l_suppkey"].alias("sources"))
    return grouped.select("target", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') AND n_chars > 500")
def client_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")) & (F.col("n_chars") > 500)).select("doc_id", "source")


@query("SELECT count(*) AS papers, count(DISTINCT source) AS sections, count(DISTINCT text) AS sentences, sum(n_chars) AS characters FROM documents")
def overview_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("k"), "n_chars")
    return docs.agg(F.count("*").alias("papers"), F.count_distinct("source").alias("sections"), F.count_distinct("k").alias("sentences"), F.sum("n_chars").alias("characters"))


@query("SELECT CASE WHEN quality IS NULL THEN 'other' WHEN toxic = 1 THEN 'breakdown' WHEN quality = 0 THEN 'repeat' ELSE 'standing' END AS bucket, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def candidate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first bucket whose condition holds."""
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    bucket = F.when(F.col("quality").isNull(), "other").when(F.col("toxic") == 1, "breakdown").when(F.col("quality") == 0, "repeat").otherwise("standing")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, array_to_string(list_sort(list(DISTINCT c.o_orderkey)), ',') AS served FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F') c ON c.o_custkey = c_custkey GROUP BY c_custkey".replace("list(DISTINCT c.o_orderkey)", "list(DISTINCT c.o_orderkey) FILTER (c.o_orderkey IS NOT NULL)"))
def served_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every result; results without any stay."""
    served = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(served, "c_custkey", "left").groupBy("c_custkey").agg(F.sort_array(F.collect_set("o_orderkey")).alias("s"))
    return joined.select("c_custkey", F.when(F.size("s") > 0, F.array_join(F.transform("s", lambda x: x.cast("string")), ",")).alias("served"))


@query(rf"WITH {LINES}, p AS (SELECT doc_id, line_no // 4 + 1 AS page, string_agg(line, ' ' ORDER BY line_no) AS t FROM l GROUP BY 1, 2), q AS (SELECT item_id, regexp_replace(trim(text), '\s+', ' ', 'g') AS q FROM benchmark WHERE trim(text) <> ''), w AS (SELECT doc_id, page, 0 AS wide, t FROM p UNION ALL SELECT a.doc_id, a.page, 1, a.t || ' ' || b.t FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.page = a.page + 1) SELECT item_id, doc_id, min((wide, page))[1] = 1 AS across, CAST(min((wide, page))[2] AS BIGINT) AS page FROM q JOIN w ON contains(w.t, q.q) GROUP BY item_id, doc_id")
def quote_match_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quote stands: the first page of each document that holds it, or the first of two pages that
    it runs across. Only documents that hold it but for white space meet it, as in its SQL;
    quote_match_tolerant finds those too that hold it in another print."""
    blanks = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    quotes = read(spark, sf_dir, "benchmark").where(F.trim("text") != "").select("item_id", F.col("text").alias("quote"))
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    near = E.contained(quotes.select("item_id", blanks("quote").alias("q")), docs.select("doc_id", blanks("text").alias("t")), ("item_id", "q"), ("doc_id", "t")).toDF("item_id", "doc_id")
    return _placed(near, quotes, docs)


@query(None)
def quote_match_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quote stands by the tolerant matcher, in the form of quote_match_page: in another case, with
    broken words, small capitals, footnote numbers and [...] too. Quotes meet documents over the rarest anchor
    of their letters, or in full where they have fewer letters than an anchor takes; the matcher decides."""
    quotes = read(spark, sf_dir, "benchmark").where(F.trim("text") != "").select("item_id", F.col("text").alias("quote"))
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    pieces = quotes.select("item_id", M.piece_key("quote").alias("piece"))
    grams = pieces.select("item_id", F.explode(M.key_anchors("piece")).alias("gram"))
    index = cut(M.anchor_rows(docs, "doc_id", "text").join(grams.select("gram").distinct(), "gram", "left_semi"))
    frequency = index.groupBy("gram").agg(F.count("*").alias("df"))
    best = grams.join(frequency, "gram", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("b")).select("item_id", "b.gram")
    met = best.join(index, "gram").select("item_id", "doc_id").distinct()
    held = met.join(pieces, "item_id").join(M.letter_rows(docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text"), "doc_id").where(F.contains("letters", "piece"))
    short = pieces.where(F.length("piece") < M.ANCHORED)
    near = held.select("item_id", "doc_id").unionByName(M.letter_rows(docs, "doc_id", "text").join(F.broadcast(short), F.contains("letters", "piece")).select("item_id", "doc_id"))
    return _placed(near, quotes, docs)


def _placed(near: DataFrame, quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, across, page) of the pairs in near that the matcher accepts."""
    lines = L.explode_lines(docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text")
    pages = lines.groupBy(F.col("doc_id").alias("paper_key"), F.expr("line_no div 4 + 1").cast("int").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    singles = pages.select("paper_key", F.lit(0).alias("wide"), "page", "text")
    pairs = R.page_spans(pages.select("paper_key", F.col("page").alias("lo"), (F.col("page") + 1).alias("hi")), pages).where("page_text is not null").select("paper_key", F.lit(1).alias("wide"), F.col("lo").alias("page"), F.col("page_text").alias("text"))
    met = near.join(quotes, "item_id").join(singles.unionByName(pairs).withColumnRenamed("paper_key", "doc_id"), "doc_id")
    first = met.where(M.quote_on("quote", "text")).groupBy("item_id", "doc_id").agg(F.min(F.struct("wide", "page")).alias("f"))
    return first.select("item_id", "doc_id", (F.col("f.wide") == 1).alias("across"), F.col("f.page").cast("long").alias("page"))
