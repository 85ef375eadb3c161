"""Aggregates over valid records: which results are one, how often each is stated, what belongs where.

All take the entries table of sources.records.entries and work on all records at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stance import left_standing
from ..sources.records import LISTS

# The order of sources where results are stated equally often.
SOURCE_ORDER = ["rq_answer", "abstract", "contributions", "conclusion", "other"]


def results(entries: DataFrame) -> DataFrame:
    return entries.where("list = 'main_results'")


def served(entries: DataFrame) -> DataFrame:
    """(paper_key, result, claim) of every claim's references to results."""
    return entries.where("list = 'claims'").select("paper_key", F.explode(F.array_distinct("serves")).alias("result"), F.col("id").alias("claim"))


def one_result(entries: DataFrame) -> DataFrame:
    """(paper_key, group, result): results with equal sets of claims are one; group is its first result in
    the record's order. A result without claims is one of its own."""
    r = results(entries).select("paper_key", F.col("id").alias("result"), "pos")
    sets = r.join(served(entries), ["paper_key", "result"], "left").groupBy("paper_key", "result", "pos").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    key = F.when(F.size("claims") > 0, F.to_json("claims")).otherwise(F.col("result"))
    grouped = sets.withColumn("_key", key)
    first = grouped.groupBy("paper_key", "_key").agg(F.min_by("result", "pos").alias("group"))
    return grouped.join(first, ["paper_key", "_key"]).select("paper_key", "group", "result", "claims", "pos")


def repeating(entries: DataFrame) -> DataFrame:
    """(paper_key, sentence, result) of the excluded sentences that repeat a result. The parts of a split
    are one sentence."""
    rows = entries.where("list = 'excluded'").select("paper_key", F.coalesce("split_from", "id").alias("sentence"), F.explode("duplicate_of").alias("result"))
    return rows.distinct()


def weights(entries: DataFrame) -> DataFrame:
    """(paper_key, group, members, stated_in, shared): in how many sentences each result is stated, and
    how many of those also state another one."""
    groups = one_result(entries)
    met = repeating(entries).join(groups.select("paper_key", "group", "result"), ["paper_key", "result"])
    of_sentence = met.groupBy("paper_key", "sentence").agg(F.count_distinct("group").alias("groups"))
    counted = met.select("paper_key", "sentence", "group").distinct().join(of_sentence, ["paper_key", "sentence"]).groupBy("paper_key", "group").agg(F.count("*").alias("repeats"), F.count_if(F.col("groups") > 1).alias("shared"))
    members = groups.groupBy("paper_key", "group").agg(F.array_sort(F.collect_list(F.struct("pos", "result")))["result"].alias("members"))
    joined = members.join(counted, ["paper_key", "group"], "left")
    return joined.select("paper_key", "group", "members", (F.size("members") + F.coalesce("repeats", F.lit(0))).alias("stated_in"), F.coalesce("shared", F.lit(0)).alias("shared"))


def id_number(c: Column | str) -> Column:
    """The number of an id such as R12; 0 for anything else."""
    return F.coalesce(F.regexp_extract(c, r"^[A-Z]+(\d{1,6})$", 1).try_cast("int"), F.lit(0))


def by_weight(entries: DataFrame) -> DataFrame:
    """results with their group's weight and their place in the record's order of importance: most often
    stated first, then by source, first page and number."""
    rows = results(entries).join(one_result(entries).select("paper_key", "group", F.col("result").alias("id")), ["paper_key", "id"]).join(weights(entries), ["paper_key", "group"])
    source = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source"))
    order = Window.partitionBy("paper_key").orderBy(F.desc("stated_in"), F.when(source > 0, source).otherwise(len(SOURCE_ORDER) + 1), F.coalesce("lo", F.lit(0)), id_number("id"), "id")
    return rows.withColumn("place", F.row_number().over(order))


def homes(entries: DataFrame) -> DataFrame:
    """(paper_key, claim, group, others): each claim under the first group it serves, by weight, and how
    many other groups it serves."""
    places = by_weight(entries).groupBy("paper_key", "group").agg(F.min("place").alias("place"))
    met = served(entries).join(one_result(entries).select("paper_key", "group", "result"), ["paper_key", "result"]).join(places, ["paper_key", "group"])
    return met.groupBy("paper_key", "claim").agg(F.min_by("group", "place").alias("group"), (F.count_distinct("group") - 1).alias("others"))


def reverse_edges(entries: DataFrame) -> DataFrame:
    """(paper_key, target, rel, sources): which entries repeat, break down or serve each entry, in their
    record's order."""
    rels = F.array(*(F.struct(F.lit(f).alias("rel"), F.col(f).alias("targets")) for f in ("serves", "duplicate_of", "breaks_down")))
    edges = entries.select("paper_key", "rank", "pos", "id", F.explode(rels).alias("r")).select("paper_key", "rank", "pos", "id", "r.rel", F.explode("r.targets").alias("target"))
    return edges.groupBy("paper_key", "target", "rel").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "id")))["id"].alias("sources"))


def split_groups(entries: DataFrame) -> DataFrame:
    """(paper_key, split_from, members) in the record's order."""
    return entries.where("split_from is not null").groupBy("paper_key", "split_from").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "id")))["id"].alias("members"))


def section_strip(entries: DataFrame) -> DataFrame:
    """(paper_key, section, first_page, last_page and a count by list)."""
    counts = [F.count_if(F.col("list") == x).alias(x) for x in LISTS]
    return entries.groupBy("paper_key", "section").agg(F.min("lo").alias("first_page"), F.max("hi").alias("last_page"), *counts)


def overview(entries: DataFrame) -> DataFrame:
    """(paper_key, a count by list, stated_in: sentences that state any result, each once)."""
    counts = entries.groupBy("paper_key").agg(*(F.count_if(F.col("list") == x).alias(x) for x in LISTS))
    known = results(entries).select("paper_key", F.col("id").alias("result"))
    repeats = repeating(entries).join(known, ["paper_key", "result"], "left_semi").groupBy("paper_key").agg(F.count_distinct("sentence").alias("repeats"))
    return counts.join(repeats, "paper_key", "left").select("paper_key", *LISTS, (F.col("main_results") + F.coalesce("repeats", F.lit(0))).alias("stated_in"))


def unsettled(entries: DataFrame) -> DataFrame:
    """Entries whose reason says that the drafter was unsure."""
    unsure = F.coalesce(F.col("reason").rlike(r"(?i)\bunsure\b") | F.col("selection_reason").rlike(r"(?i)\bunsure\b"), F.col("reason").rlike(r"(?i)\bunsure\b"), F.col("selection_reason").rlike(r"(?i)\bunsure\b"))
    return entries.where("list <> 'main_results'").where(unsure).select("paper_key", "rank", "pos", "id", "label")


def collisions(papers: DataFrame, column: str = "paper_id") -> DataFrame:
    """Ids that differ only in case, with how many records use each."""
    return papers.groupBy(F.lower(column).alias("folded")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("paper_key")).alias("records")).where("n > 1")


def candidates(entries: DataFrame) -> DataFrame:
    """(paper_key, id, pos, bucket, weighed): each excluded candidate with the results it is weighed against
    and its bucket: repeat, breakdown, part, standing or other, whichever comes first."""
    known = results(entries).groupBy("paper_key").agg(F.collect_set("id").alias("known"))
    rows = entries.where("list = 'excluded'").join(known, "paper_key", "left")
    none = F.array().cast("array<string>")
    repeats, breaks = F.coalesce("duplicate_of", none), F.coalesce("breaks_down", none)
    standing = F.array_intersect(left_standing(F.coalesce("reason", F.lit(""))), F.coalesce("known", none))
    bucket = (
        F.when(F.size(repeats) > 0, "repeat").when(F.size(breaks) > 0, "breakdown").when(F.col("split_from").isNotNull(), "part")
        .when(F.size(F.array_except(F.array_except(standing, repeats), breaks)) > 0, "standing").otherwise("other")
    )
    return rows.select("paper_key", "id", "pos", bucket.alias("bucket"), F.array_sort(F.array_union(F.array_union(repeats, breaks), standing)).alias("weighed"))


def considered(entries: DataFrame) -> DataFrame:
    """(paper_key, result, candidates): the excluded candidates weighed against each result, in order."""
    each = candidates(entries).select("paper_key", "id", "pos", F.explode("weighed").alias("result"))
    known = results(entries).select("paper_key", F.col("id").alias("result"))
    return each.join(known, ["paper_key", "result"], "left_semi").groupBy("paper_key", "result").agg(F.array_sort(F.collect_list(F.struct("pos", "id")))["id"].alias("candidates"))


def matching(entries: DataFrame, term: str = "", with_note: bool = False, on_table: bool = False) -> DataFrame:
    """Entries whose text holds the term, whatever its case, and that have a note or stand at a table or
    figure where these are asked for."""
    text = F.lower(F.concat_ws(" ", "id", "quote", "states", "section", "reason", "selection_reason", "note"))
    rows = entries.where(F.contains(text, F.lit(term.lower())))
    if with_note:
        rows = rows.where(F.coalesce(F.col("note"), F.lit("")) != "")
    return rows.where(F.col("section").rlike(r"(?i)\b(?:table|fig\.?|figure)\s*[\dIVXLC]+")) if on_table else rows


def related(entries: DataFrame, entry: str) -> DataFrame:
    """(paper_key, id) of the results a claim serves, or the claims that serve a result, in each record."""
    s = served(entries)
    return s.where(F.col("claim") == entry).select("paper_key", F.col("result").alias("id")).unionByName(s.where(F.col("result") == entry).select("paper_key", F.col("claim").alias("id")))
