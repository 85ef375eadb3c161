"""String expressions. Everything here is a built-in column expression unless it says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that mean the same in a quote and on a page. None: dropped.
FOLD = {
    "∆": "Δ", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "`": "'", "´": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"',
    "­": None, "​": None, "‌": None, "‍": None, "﻿": None,
}
_TABLE = str.maketrans(FOLD)

#: A word: letters and digits, with decimals kept on a number.
WORD = r"(?U)[^\W_]+(?:[.,][0-9]+)*"
#: Line ends as text tools see them, not LF alone.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Characters that no reader sees as they are: bidirectional marks, zero-width and control characters.
UNSHOWABLE = r"[‪-‮⁦-⁩​-‏؜⁠﻿]|[\p{Cc}&&[^\t\n\r]]"


def fold_text(text: str) -> str:
    """Compatibility form with quotes, dashes and invisible characters folded (plain Python)."""
    return unicodedata.normalize("NFKC", text).translate(_TABLE)


def unmarked(text: str) -> str:
    """The compatibility form without combining marks (plain Python)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """fold_text over a column; Spark has no compatibility normalisation. Null stays null."""
    return texts.map(lambda t: None if t is None else fold_text(t))


def ascii_fold(c: Column) -> Column:
    """The same without the compatibility form: enough for text that has none."""
    one = {k: v for k, v in FOLD.items() if v}
    return F.translate(c, "".join(one) + "".join(k for k, v in FOLD.items() if v is None), "".join(one.values()))


def words(c: Column) -> Column:
    """Ordered words in lower case; a hyphen parts words."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, "-", " "), F.lit(WORD), F.lit(0)), F.lower)


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def in_order(part: Column, whole: Column) -> Column:
    """Whether part is a subsequence of whole: each element is sought after the last one's place."""
    start = F.lit(0)

    def step(at: Column, w: Column) -> Column:
        rest = F.slice(whole, F.greatest(at, F.lit(0)) + 1, F.greatest(F.size(whole) - F.greatest(at, F.lit(0)), F.lit(0)))
        found = F.array_position(rest, w).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return F.aggregate(part, start, step) >= 0


def one_line(c: Column) -> Column:
    """A passage on one line: words broken at a line end are joined, but not beside a digit."""
    joined = F.regexp_replace(c, r"(?U)(?<=\p{L})-\s*\n\s*(?=\p{L})", "")
    kept = F.regexp_replace(joined, r"-\s*\n\s*", "-")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def snippet(c: Column, n: int) -> Column:
    """The first n characters, cut back to a word end where that cuts a word."""
    head = F.regexp_replace(F.substring(c, 1, n + 1), r"(?U)\s+\S*\z", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(head, 1, n), F.lit("…")))


def natural_number(c: Column) -> Column:
    """Number after an id's letter, for R2 before R10; null if it isn't such an id."""
    return F.regexp_extract(c, "^[A-Za-z]+([0-9]{1,9})$", 1).try_cast("int")


def shouts(c: Column) -> Column:
    """At least seven tenths of a line's letters are capitals."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters > 0) & (10 * F.regexp_count(c, F.lit(r"\p{Lu}")) >= 7 * letters)


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
