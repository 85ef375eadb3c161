"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3 with frozen counts. A byte's probability in a
context is its share there; bytes new to a context share the escape probability (distinct bytes over
all bytes plus distinct) by the next shorter context's distribution over the bytes not seen, so each
context's distribution sums to one; below order 0 all bytes are alike. A text's code length is exact
under those counts and the shortest code wins. Trees are sparse: only strings that training saw have a
place, in hash tables that whole batches look up at once, and every one of them is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts

ORDER = 3
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")


class Table:
    """Numbers by 32-bit code, in open addressing with at most a quarter of the places taken."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(codes)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.codes, self.values = np.zeros(1 << bits, np.uint32), np.full(1 << bits, np.nan, np.float32)  # NaN: free
        at, rest = self._home(codes), np.arange(len(codes))
        while len(rest):
            free = rest[np.isnan(self.values[at[rest]])]
            self.codes[at[free]] = codes[free]  # of several in one place the last stays
            here = free[self.codes[at[free]] == codes[free]]
            self.values[at[here]] = values[here]
            rest = rest[(self.codes[at[rest]] != codes[rest]) | np.isnan(self.values[at[rest]])]
            at[rest] = (at[rest] + 1) & (len(self.codes) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The codes' numbers; NaN where a code has none."""
        at = self._home(codes)
        out = self.values[at]
        rest = np.flatnonzero((self.codes[at] != codes) & ~np.isnan(out))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.codes) - 1)
            found = self.values[at[rest]]
            out[rest] = found
            rest = rest[(self.codes[at[rest]] != codes[rest]) & ~np.isnan(found)]
        return out


class Tree:
    """One language. seen[m]: bits of the last byte of a string of length m after the others, for strings
    of the training texts; escape[m]: what a byte costs that is new to a context of length m, before its
    cost in the next shorter one."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        """How often (n) each byte string of length 1 to ORDER + 1 occurs; code: its length and its bytes as
        a 32-bit number below."""
        order, text = code >> 32, code & 0xFFFFFFFF
        self.seen: dict[int, Table] = {}
        self.escape: dict[int, Table] = {}
        lower_text, lower_p = np.zeros(0, np.int64), np.zeros(0)
        for m in range(1, ORDER + 2):
            pick = np.flatnonzero(order == m)
            pick = pick[np.argsort(text[pick])]
            s, times = text[pick], n[pick].astype(np.float64)
            context, group = np.unique(s >> 8 if m > 1 else s * 0, return_inverse=True)
            distinct, total = np.bincount(group), np.bincount(group, times)
            # A string's end stands in the next shorter context as well: its share there.
            lower = lower_p[np.searchsorted(lower_text, s & ((1 << 8 * (m - 1)) - 1))] if m > 1 else np.full(len(s), 1 / 256)
            left = np.maximum(1 - np.bincount(group, lower), 1e-12)  # of the shorter context, for bytes that are new here
            p = times / np.where(distinct < 256, total + distinct, total)[group]
            self.seen[m] = Table(s.astype(np.uint32), -np.log2(p))
            self.escape[m - 1] = Table(context.astype(np.uint32), np.log2(left) - np.log2(distinct / (total + distinct)))
            lower_text, lower_p = s, p

    def costs(self, grams: dict[int, np.ndarray], place: np.ndarray) -> np.ndarray:
        """Bits of every byte. grams[m]: the m bytes up to each as a number; place: its place in its text."""
        out = np.zeros(len(place), np.float32)
        todo = np.flatnonzero(place >= ORDER)
        for m in range(ORDER + 1, 0, -1):
            bits = self.seen[m].find(grams[m][todo])
            new = np.isnan(bits)
            out[todo] += np.where(new, 0, bits)
            todo = todo[new]
            context = grams[m][todo] >> np.uint32(8) if m > 1 else np.zeros(len(todo), np.uint32)
            out[todo] += np.nan_to_num(self.escape[m - 1].find(context))  # a context that training never saw costs nothing
            if m > 1:
                todo = np.concatenate([todo, np.flatnonzero(place == m - 2)])
        out[todo] += 8
        return out


class ContextTrees:
    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        data = np.frombuffer(b"".join(texts[i] for i in full), np.uint8).astype(np.uint32)
        lengths = np.fromiter((len(texts[i]) for i in full), np.int64, len(full))
        starts = np.cumsum(lengths) - lengths
        place = np.minimum(np.arange(len(data)) - np.repeat(starts, lengths), ORDER).astype(np.int8)
        grams = {1: data}
        for m in range(2, ORDER + 2):  # what reaches over a text's start is not looked at
            longer = data.copy()
            longer[1:] |= grams[m - 1][:-1] << np.uint32(8)
            grams[m] = longer
        for k, tree in enumerate(self.trees):
            out[full, k] = np.add.reduceat(tree.costs(grams, place), starts, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share of the probability all languages give the text); ties to the first
        in order of name. UNKNOWN and 0 for null, letterless texts, or where nothing was learned."""
        use = [i for i, t in enumerate(texts) if t and self.languages and (ASCII_LETTER.search(t) or any(map(str.isalpha, t)))]
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if use:
            bits = self.code_lengths([texts[i].encode() for i in use])
            best = bits.argmin(axis=1)
            with np.errstate(under="ignore"):
                share = 1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1)
            for i, b, s in zip(use, best.tolist(), share.tolist(), strict=True):
                out[i] = (self.languages[b], s)
        return out


def held_out(key: str, folds: int = 5):
    """Whether crc32 of the key as text is a multiple of folds; null keys are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500) -> ContextTrees:
    """Context trees from whole texts of at most per_language rows a language, those with the
    smallest hashes of their key, out of the rows that are not held out.

    The sample's byte strings are counted on the executors; only counts come to the driver. Rows
    with null key, text or language do not train, and of a repeated key one row does, that of the smallest
    text; without any row there are no languages.
    """
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # First by a hash range that holds about four times as many keys of each language, whatever its
    # size; so even the language of most rows brings few to the window that takes the exact number.
    share = rows.groupBy(lang).agg((4.0 * per_language / F.approx_count_distinct(key)).alias("_share"))
    # One row a language, of which the trees below hold far more.
    near = rows.select(lang, key).join(F.broadcast(share), lang).where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key))
    chosen = near.select(lang, key).distinct().withColumn("_rank", rank).where(F.col("_rank") <= per_language).select(lang, key)
    # At most per_language keys a language.
    sample = rows.select(lang, key, text).join(F.broadcast(chosen), [lang, key], "left_semi").groupBy(lang, key).agg(F.min(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(t.encode(), np.uint8).astype(np.uint64)
                code, parts = np.zeros(len(b), np.uint64), []
                for order in range(1, ORDER + 2):
                    code = (code[: len(b) - order + 1] << np.uint64(8)) | b[order - 1 :] if order > 1 else b
                    parts.append(code | (np.uint64(order) << np.uint64(32)))
                    if len(b) <= order:
                        break
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in found:
                    u, inverse = np.unique(np.concatenate([found[name][0], u]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([found[name][1], n])).astype(np.int64)
                found[name] = (u, n)
        for name, (u, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counted = sample.select(lang, text).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = counted.toArrow().combine_chunks()
    names = table.column("lang").combine_chunks().dictionary_encode()
    code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    number = names.indices.to_numpy()
    languages = sorted(names.dictionary.to_pylist())
    at = {x: number == i for i, x in enumerate(names.dictionary.to_pylist())}
    return ContextTrees(languages, [Tree(code[at[x]], n[at[x]]) for x in languages])


def predict(docs: DataFrame, trees: ContextTrees, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, lang_pred and score of every row. See ContextTrees.predict for odd texts.

    The trees are broadcast; they hold under 32 bytes for each distinct string of up to four bytes in the
    per_language texts that trained them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        return shared.value.predict

    return map_texts(docs, keys, text, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> DataFrame:
    """Learn from docs' rows that are not held out, and predict every row of docs."""
    trees = fit(docs, key, text, lang, **bounds)
    return predict(docs.select(key, text, held_out(key).alias("held_out")), trees, [key, "held_out"], text)
