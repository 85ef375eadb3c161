"""Ordered operators over lines of text: each keeps a paper's lines together and uses built-in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_lines(docs: DataFrame, key: str, text: str, ends: str = "\n") -> DataFrame:
    """(key, line_no from 0, line) of every text; null texts have no lines."""
    return docs.select(key, F.posexplode(F.split(text, ends, -1)).alias("line_no", "line"))


def carry_forward(df: DataFrame, value: Column, name: str, part: list[str], order: list[str]) -> DataFrame:
    """The last non-null value at or before each row, such as the page marker above a line."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, holds: Column, part: list[str], order: list[str]) -> DataFrame:
    """Maximal runs of neighbouring rows for which holds is true: part, first, last, length."""
    w = Window.partitionBy(*part).orderBy(*order)
    number = df.withColumn("_n", F.row_number().over(w)).where(holds)
    grouped = number.withColumn("_island", F.col("_n") - F.row_number().over(w))
    return grouped.groupBy(*part, "_island").agg(F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("length")).drop("_island")


def forward_frame(df: DataFrame, value: Column, n: int, name: str, part: list[str], order: list[str]) -> DataFrame:
    """The values of the next n rows, in order."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(1, n)
    return df.withColumn(name, F.collect_list(value).over(w))


def edge_rows(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """First and last row of each part with an `edge` column: top or bottom. A single row is both."""
    up = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(*part).orderBy(*(F.desc(c) for c in order)))
    edged = df.withColumn("_up", up).withColumn("_down", down).where("_up = 1 or _down = 1")
    ends = F.filter(F.array(F.when(F.col("_up") == 1, F.lit("top")), F.when(F.col("_down") == 1, F.lit("bottom"))), lambda x: x.isNotNull())
    return edged.withColumn("edge", F.explode(ends)).drop("_up", "_down")


def repeated(df: DataFrame, value: str, over: str, least: int) -> DataFrame:
    """Values that stand in at least `least` different parts, with their number."""
    return df.groupBy(value).agg(F.count_distinct(over).alias("n")).where(F.col("n") >= least)


def position_share(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """rank (from 1) and total of each row in its part; rank over total is how far it stands."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).withColumn("total", F.count("*").over(Window.partitionBy(*part)))


def as_of(points: DataFrame, marks: DataFrame, part: str, at: str, value: str) -> DataFrame:
    """Each point with the last mark of its part at or before it (null if none): a union and one window
    instead of a range join, so a part's points and marks are sorted once and never paired."""
    both = points.withColumn("_mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(marks.select(part, at, F.col(value).alias("_mark")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(part).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_mark", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_mark")


def next_number(df: DataFrame, keys: list[str], number: str, id_column: str) -> DataFrame:
    """Rows whose number plus one also stands under the same keys: (keys, number)."""
    later = df.select(*keys, (F.col(number) - 1).alias(number)).distinct()
    return df.join(later, [*keys, number], "left_semi")


def digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """sha256, number of lines and of white-space separated words of each text."""
    t = F.col(text)
    return docs.select(key, F.sha2(t.cast("binary"), 256).alias("sha256"), F.size(F.split(t, "\n", -1)).cast("long").alias("lines"), F.size(F.filter(F.split(t, r"[ \n]+"), lambda w: w != "")).cast("long").alias("words"))
