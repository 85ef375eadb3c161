"""Finding a quoted sentence on a page whose text was extracted from a PDF.

A quote is compiled into one regular expression over the folded page. Where the quote has a blank between
two word characters the page must have white space; elsewhere white space is free. The page may
break a word with a hyphen, may set small capitals with a blank after their first letter, and may print a footnote
number that the quote leaves out. A quote's [...] stands for lines that the page prints in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fold_text

#: How many characters, white space aside, one [...] may skip.
MAX_GAP = 4000
# The gap marker, and the number of a footnote after a word or a mark.
GAP = regex.compile(r"\s*\[(?:\.\.\.|…)\]\s*")
FOOTNOTE = regex.compile(r"(?:(?<=[^\W\d_])\d{2}|(?<=[a-z])\d|(?<=[.,;:!?)\]\"'])\d{1,2})(?=[\s.,;:!?)\]]|$)")

ON, OFF = "\ue000", "\ue001"  # stand around a footnote number that may be left out
NOTE = rf"(?:{ON}\d+{OFF})?"
SMALL_CAPS = r"(?:(?<=(?<![^\W_])\p{Lu})\s+(?=\p{Lu})|(?<=\p{Lu})\s+(?=\p{Lu}(?![^\W_])))"
INSIDE_WORD = rf"(?:\s*-\s*|{SMALL_CAPS})?"
# A digit that ends a name, a version or a label is no footnote.
PART_OF_A_NAME = regex.compile(r"(?:[^\W_]*[-.](?:\s*\n\s*)?[^\W_.-]*|[\[(@/][A-Za-z]{1,2}|[\[(][A-Za-z]{1,2}\d+(?:[,;] ?[A-Za-z]{1,2}\d+)*[,;] ?[A-Za-z]{1,2})$")


def match_key(text: str) -> str:
    """What two spellings of one sentence have in common; gap markers count as blanks."""
    s = fold_text(GAP.sub(" ", text) if "[" in text else text)
    if "-" in s:
        s = regex.sub(r"(?<=[^\W\d_])\s*-\s*(?=[^\W\d_])", "", s)
    s = regex.sub(r"(?<=[^\W_])\s+(?=[^\W_])", "‖", s)
    return regex.sub(r"\s+", "", s).casefold()


def letters(text: str) -> str:
    """The letters alone, case folded. Of a stretch of quote without gaps they stand in one run in those of
    every text that the matcher finds it in: blanks, hyphens, marks and footnote numbers are all it tolerates."""
    return regex.sub(r"\P{L}+", "", fold_text(text).casefold()).replace("ı", "i")


GRAM, WINDOW = 8, 8
#: Letters that surely hold an anchor.
ANCHORED = GRAM + WINDOW - 1


def anchors(key: str) -> np.ndarray:
    """The least hash in every window of a key's grams. Those of a key are among those of all keys that contain it."""
    codes = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)).view(np.int64)


BASE, MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


def _grams(data: bytes, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of all grams of so many bytes), for widths 1, 2, 4 and so on up to most."""
    h, width = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    while width <= min(most, len(data)):
        yield width, h
        h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
        width *= 2


BYTES, SPAN_OF = 16, 64


def byte_anchors(data: bytes) -> np.ndarray:
    """anchors of a text's bytes as they are, by longer grams in wider windows, sorted: those of a text are among
    those of all texts that it stands in. Minima are doubled up like grams, so the windows' width costs little."""
    if len(data) < BYTES + SPAN_OF - 1:
        return np.empty(0, np.int64)
    *_, (_, h) = _grams(data, BYTES)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    width = 1
    while width < SPAN_OF:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.unique(h).view(np.int64)


class Finder:
    """Which of many short needles stand in a text. A needle is known by the grams at its start and end, as wide as
    a power of two can be; a text's grams are looked up in a table of bits first, and what is found is compared."""

    BITS = np.uint64(44)  # a table of 2**20

    def __init__(self, needles: list[bytes]) -> None:
        self.needles = needles
        ends: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, needle in enumerate(needles):
            *_, (width, h) = _grams(needle, len(needle))
            ends.setdefault(width, []).append((len(needle), int(h[0]), int(h[len(needle) - width]), i))
        self.widest = max(ends, default=0)
        self.tables = {}
        for width, rows in ends.items():
            starts = np.unique(np.array([r[1] for r in rows], np.uint64))
            bits = np.zeros(1 << 20, bool)
            bits[(starts * MIX) >> self.BITS] = True
            lengths: dict[int, dict[int, list[int]]] = {}
            for length, a, b, i in rows:
                lengths.setdefault(length, {}).setdefault((a * BASE + b) % (1 << 64), []).append(i)
            self.tables[width] = bits, starts, [(length, np.sort(np.array(list(codes), np.uint64)), codes) for length, codes in lengths.items()]

    def __call__(self, data: bytes) -> list[int]:
        out: list[int] = []
        among = lambda h, known: known[np.minimum(known.searchsorted(h), len(known) - 1)] == h
        for width, h in _grams(data, self.widest):
            if width not in self.tables:
                continue
            bits, starts, lengths = self.tables[width]
            at = np.flatnonzero(bits[(h * MIX) >> self.BITS])
            at = at[among(h[at], starts)]
            for length, known, codes in lengths if len(at) else ():
                a = at[at + length <= len(data)]
                c = h[a] * np.uint64(BASE) + h[a + (length - width)]
                out += [i for code in np.unique(c[among(c, known)]).tolist() for i in codes[code] if self.needles[i] in data]
        return out


@lru_cache(maxsize=64)
def marked_page(text: str) -> str:
    """The folded page with ON and OFF around each footnote number that a quote may leave out."""
    page = fold_text(text)

    def mark(m: regex.Match) -> str:
        before = page[max(0, m.start() - 160) : m.start()]
        decimal = regex.match(r"\.\d", page[m.end() :]) or regex.search(r"\d[.,]$", before)
        token = regex.search(r"\S*(?:-\s*\n\s*\S*)?$", before)[0]
        named = "-" in token and not regex.search(r"[.,;:!?)\]\"']$", token) or PART_OF_A_NAME.search(before.rsplit(" ", 3)[-1]) and not regex.search(r"[.,;:!?)\]\"']$", before)
        return m[0] if decimal or named else ON + m[0] + OFF

    return FOOTNOTE.sub(mark, page)


@lru_cache(maxsize=64)
def plain_page(text: str) -> str:
    """The folded page with single blanks, and one at either end."""
    return f" {regex.sub(r'\s+', ' ', fold_text(text)).strip(' ')} "


def skeleton(text: str) -> str:
    """letters with the digits among them. Where a page has no footnote number that may be left out, those of a
    stretch of quote stand in one run in the page's."""
    return regex.sub(r"[^\p{L}\p{Nd}]+", "", fold_text(text).casefold()).replace("ı", "i")


@lru_cache(maxsize=64)
def page_key(text: str) -> tuple[bool, str]:
    """Whether digits count, and the page's skeleton if so, else its letters."""
    page = marked_page(text)
    return (False, letters(text)) if ON in page or OFF in page else (True, skeleton(text))


@lru_cache(maxsize=4096)
def _keys(quote: str) -> tuple[list[str], list[str]]:
    """letters and skeleton of every stretch of a quote without gaps."""
    pieces = GAP.split(quote.strip())
    return [letters(p) for p in pieces], [skeleton(p) for p in pieces]


def may_stand(quote: str, page_text: str) -> bool:
    """False only where find_quote finds nothing: the keys of its stretches do not follow each other in the page's."""
    digits, page = page_key(page_text)
    at = 0
    for key in _keys(quote)[digits]:
        if (at := page.find(key, at)) < 0:
            return False
        at += len(key)
    return True


def _literally(quote: str, page_text: str) -> tuple[list[str], int]:
    """A quote's words, and where they stand on the plain page as written, between blanks; -1 if they don't."""
    words = fold_text(quote).split()
    return words, -1 if not words or GAP.search(quote) else plain_page(page_text).find(f" {' '.join(words)} ")


def stands_literally(quote: str, page_text: str) -> bool:
    """Whether a quote without gaps stands on the page as it is written, between blanks. Then find_quote finds it
    as well, here or earlier, and its expression, dear to compile, can be spared."""
    return _literally(quote, page_text)[1] >= 0


def only_place(quote: str, page_text: str) -> tuple[int, int] | None:
    """(start, end) in the folded page of a quote that stands there literally, if its expression can match nowhere
    before: the quote's skeleton stands in the page's here first, and no footnote number up to here may be left out."""
    words, at = _literally(quote, page_text)
    if at < 0 or not regex.match(r"[\p{L}\p{Nd}]", words[0]):
        return None
    page, before = fold_text(page_text), plain_page(page_text).count(" ", 0, at)
    places = list(islice(regex.finditer(r"\S+", page), before, before + len(words)))
    start, end = places[0].start(), places[-1].end()
    marked = marked_page(page_text)[: end + 1]
    if ON in marked or OFF in marked or skeleton(page[:end]).find(skeleton(quote)) != len(skeleton(page[:start])):
        return None
    return start, end


def _piece(text: str) -> str:
    """Pattern of a stretch of quote without gaps."""
    s = fold_text(text).strip()
    s = regex.sub(r"(?<=[^\W\d_])\s*-\s*(?=[^\W\d_])", "", s)
    out: list[str] = []
    before, blank = "", False
    for c in s:
        if c.isspace():
            blank = True
            continue
        if before:
            if before.isalnum() and c.isalnum():
                out.append(rf"{NOTE}\s+" if blank else INSIDE_WORD if before.isalpha() and c.isalpha() else f"{SMALL_CAPS}?")
            else:
                out.append(rf"\s*{NOTE}\s*")
        out.append(rf"{ON}?{c}{OFF}?" if c.isdigit() else regex.escape(c))
        before, blank = c, False
    return "".join(out)


@lru_cache(maxsize=4096)
def _pattern(quote: str) -> regex.Pattern | None:
    text = quote.strip()
    marks = list(GAP.finditer(text))
    pieces, at = [], 0
    for m in marks:
        pieces.append(text[at : m.start()])
        at = m.end()
    pieces.append(text[at:])
    parts = [_piece(p.rstrip().removesuffix("-") if i + 1 < len(pieces) else p) for i, p in enumerate(pieces)]
    if not all(parts):
        return None
    line_gap = rf"{NOTE}-?[^\S\n]*\n(?P<gap>(?:[^\n]*\n)*?)[^\S\n]*"
    printed = r"\s*\[\s*(?:\.\s*\.\s*\.|…)\s*\]\s*"
    body = f"(?:{line_gap}|{printed})".join(parts)
    # The whole quote starts and ends where words and numbers of the page do.
    start = r"(?<![^\W_])(?<!\d[.,](?=\d))" if fold_text(text)[:1].isalnum() else ""
    end = rf"(?:(?={ON})|(?![^\W_])(?![.,]\d)(?!-\s*[^\W_]))" if fold_text(text)[-1:].isalnum() else ""
    if fold_text(text)[-1:] in ".,":
        end = r"(?<!\d[.,](?=\d))"
    return regex.compile(start + body + end, regex.IGNORECASE | regex.FULLCASE)


def find_quote(quote: str, page_text: str, max_gap: int = MAX_GAP) -> tuple[int, int, list[tuple[int, int]]] | None:
    """(start, end, [(gap start, gap end), ...]) in the folded page of the first place, or None. An expression is
    compiled only where keys and the literal text leave the place open."""
    page_text = page_text or ""
    if not quote or not quote.strip() or not may_stand(quote, page_text):
        return None
    return (*place, []) if (place := only_place(quote, page_text)) else search(quote, page_text, max_gap)


def search(quote: str, page_text: str, max_gap: int = MAX_GAP) -> tuple[int, int, list[tuple[int, int]]] | None:
    """find_quote by the quote's expression alone."""
    if (pattern := _pattern(quote)) is None:
        return None
    page = marked_page(page_text)
    for m in pattern.finditer(page, overlapped=True):
        gaps = m.spans("gap") if "gap" in pattern.groupindex else []
        if all(sum(not c.isspace() for c in page[a:b]) <= max_gap for a, b in gaps):
            plain = lambda k: k - page.count(ON, 0, k) - page.count(OFF, 0, k)
            return plain(m.start()), plain(m.end()), [(plain(a), plain(b)) for a, b in gaps]
    return None


_RANGE = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
SPAN = T.StructType([*_RANGE, T.StructField("gaps", T.ArrayType(T.StructType(_RANGE)))])


@F.pandas_udf(T.StringType())
def quote_key(texts: pd.Series) -> pd.Series:
    """match_key over a column; null stays null."""
    return texts.map(lambda t: None if t is None else match_key(t))


@F.pandas_udf(T.StringType())
def letters_key(texts: pd.Series) -> pd.Series:
    """letters over a column; null stays null."""
    return texts.map(lambda t: None if t is None else letters(t))


@F.pandas_udf(T.StringType())
def piece_key(quotes: pd.Series) -> pd.Series:
    """letters of the longest stretch of a quote without gaps."""
    return quotes.map(lambda q: None if q is None else max(map(letters, GAP.split(q.strip())), key=len))


@F.pandas_udf(T.ArrayType(T.LongType()))
def key_anchors(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else anchors(k))


#: Texts that a worker holds as Python objects at once, however many an Arrow batch brings.
SLICE = 128


def _sliced(docs: DataFrame, key: str, text: str, column: str, kind: str, make: Callable[[str], Sequence]) -> DataFrame:
    """(key, column) with a row for each of what make gives for a text; null texts give none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                made = [() if t is None else make(t) for t in part.column(1).to_pylist()]
                of = np.repeat(np.arange(len(made)), [len(m) for m in made])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array([x for m in made for x in m], pa.int64() if kind == "long" else pa.string())], [key, column])

    return docs.select(key, text).mapInArrow(rows, f"{key} {docs.schema[key].dataType.simpleString()}, {column} {kind}")


def anchor_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram) of the anchors of each text's letters."""
    return _sliced(docs, key, text, "gram", "long", lambda t: anchors(letters(t)).tolist())


def byte_anchor_rows(docs: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """(key, gram) of the byte anchors of each text, or of so many of them at most."""
    return _sliced(docs.withColumn(text, F.col(text).cast("binary")), key, text, "gram", "long", lambda t: byte_anchors(t)[:most].tolist())


def found_rows(docs: DataFrame, key: str, text: str, column: str, needles: list[tuple[int, bytes]]) -> DataFrame:
    """(key, column) with the ids of the needles that stand in each text. The needles are sent to all tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(([i for i, _ in needles], Finder([t for _, t in needles])))

    def make(t: bytes) -> list[int]:
        ids, find = sent.value
        return [ids[i] for i in find(t)]

    return _sliced(docs.withColumn(text, F.col(text).cast("binary")), key, text, column, "long", make)


def letter_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, letters) of each text."""
    return _sliced(docs, key, text, "letters", "string", lambda t: [letters(t)])


@F.pandas_udf(SPAN)
def quote_span(quotes: pd.Series, pages: pd.Series) -> pd.DataFrame:
    """find_quote over pairs of columns; null fields where it isn't there."""
    rows = [find_quote(q, p) if q is not None and p is not None else None for q, p in zip(quotes, pages, strict=True)]
    return pd.DataFrame({"start": pd.array([r and r[0] for r in rows], "Int32"), "end": pd.array([r and r[1] for r in rows], "Int32"), "gaps": [r and [{"start": a, "end": b} for a, b in r[2]] for r in rows]})


@F.pandas_udf(T.BooleanType())
def quote_on(quotes: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([q is not None and p is not None and (stands_literally(q, p) or find_quote(q, p) is not None) for q, p in zip(quotes, pages, strict=True)], dtype="bool")


@F.pandas_udf(T.BooleanType())
def quote_on_any_gap(quotes: pd.Series, pages: pd.Series) -> pd.Series:
    """quote_on with gaps of any length."""
    return pd.Series([q is not None and p is not None and find_quote(q, p, 1 << 40) is not None for q, p in zip(quotes, pages, strict=True)], dtype="bool")


@F.pandas_udf(T.StructType([T.StructField("digits", T.BooleanType()), T.StructField("key", T.StringType())]))
def page_keys(pages: pd.Series) -> pd.DataFrame:
    """page_key over a column; null fields for null."""
    rows = [(None, None) if p is None else page_key(p) for p in pages]
    return pd.DataFrame({"digits": pd.array([r[0] for r in rows], "boolean"), "key": pd.array([r[1] for r in rows], "object")})


_PIECES = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("letters", _PIECES), T.StructField("skeletons", _PIECES)]))
def piece_keys(quotes: pd.Series) -> pd.DataFrame:
    """letters and skeleton of every stretch of a quote without gaps; null fields for null."""
    rows = [(None, None) if q is None else _keys(q) for q in quotes]
    return pd.DataFrame({"letters": [r[0] for r in rows], "skeletons": [r[1] for r in rows]}, dtype="object")


def may_stand_on(pieces: Column, page: Column) -> Column:
    """False only where may_stand is, by piece_keys of the quote and page_keys of the page. Built-in."""
    return F.forall(F.when(page["digits"], pieces["skeletons"]).otherwise(pieces["letters"]), lambda k: F.contains(page["key"], k))


def as_written(quote: Column, page: Column) -> Column:
    """True only where stands_literally is: a quote of ASCII words, without brackets, that the page has between blanks
    or line ends. Built-in, never null."""
    words = quote.rlike(r"^[!-Z\\^-~]+(?: [!-Z\\^-~]+)*\z")
    return F.coalesce(words & F.contains(F.concat(F.lit(" "), F.translate(page, "\n", " "), F.lit(" ")), F.concat(F.lit(" "), quote, F.lit(" "))), F.lit(False))


def quote_stands(quote: Column, page: Column) -> Column:
    """quote_on, where only quotes that do not stand as written go to Python, with their pages."""
    there = as_written(quote, page)
    return there | quote_on(F.when(~there, quote), F.when(~there, page))
