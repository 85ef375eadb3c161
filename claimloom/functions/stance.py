"""What a reason says of the results it names, clause by clause. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words by which a clause asks, conditions, affirms or denies, and those that a list of ids may hold.
ASKS = r"(?i)\b(?:whether|unclear|uncertain|depends|debatable|arguable)\b"
ONLY_IF = r"(?i)\bstands?\s+only\b"
STANDS = r"(?i)\b(?:would|does|still)\b([^.]{0,40}?)\bstands?\b"
DENIES = r"(?i)\b(?:not|never|no|none|nothing|neither|nor|cannot|hardly|barely|n't)\b"
RESULT = r"\bR\d+\b"
CARRIES = ["", "so", "and", "or", "both", "also", "then", "thus", "together", "along", "with", "plus", "as", "well"]


def clauses(reason: Column) -> Column:
    """Clauses in order. A piece that is only a list of results belongs to the clause after it."""
    parts = F.filter(F.split(reason, r"[,;.:]| and | but ", -1), lambda p: p.rlike(r"(?U)\S"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("carried"))

    def step(s: Column, part: Column) -> Column:
        tokens = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
        bare = F.transform(tokens(F.regexp_replace(part, RESULT, " ")), lambda w: F.lower(F.regexp_replace(w, "^[.,;:()]+|[.,;:()]+$", "")))
        only_ids = part.rlike(RESULT) & ~part.rlike(STANDS) & (F.size(tokens(part)) <= 4) & F.forall(bare, lambda w: w.isin(CARRIES))
        return F.when(only_ids, F.struct(s["out"].alias("out"), F.concat(s["carried"], part, F.lit(" and ")).alias("carried"))).otherwise(F.struct(F.array_append(s["out"], F.concat(s["carried"], part)).alias("out"), F.lit("").alias("carried")))

    return F.aggregate(parts, start, step, lambda s: F.when(s["carried"] != "", F.array_append(s["out"], s["carried"])).otherwise(s["out"]))


def affirms(clause: Column) -> Column:
    """The clause says that a result stands: no denial, question or condition in it."""
    return clause.rlike(STANDS) & ~clause.rlike(DENIES) & ~clause.rlike(ASKS) & ~clause.rlike(ONLY_IF)


def still_stands(reason: Column) -> Column:
    return F.exists(clauses(reason), affirms)


def left_standing(reason: Column) -> Column:
    """Results named in affirming clauses."""
    return F.array_distinct(F.flatten(F.transform(F.filter(clauses(reason), affirms), lambda c: F.regexp_extract_all(c, F.lit(RESULT), F.lit(0)))))
