"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Statistics are counted once per whole text. Trees are fitted by histogram boosting on logistic loss,
with splits refused that would break a feature's required direction, and are flattened into numpy node
arrays that score a batch level by level. Only a bounded sample of labelled rows trains; every row is
scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "word_variety", "words_a_line", "pipe_share", "short_word_share"]
#: Direction in which quality may move as a feature grows.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1}
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
MARKS = np.frombuffer(b"!?,.;:-_'\"()[]{}/\\+=@^~`#*$%&|<>", np.uint8)


def repeated_words(ids: np.ndarray) -> int:
    """How many words stand in a window of three words that occurs twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if int(ids.max()) < 1 << 21:
        key = (ids[:n] << 42) | (ids[1 : n + 1] << 21) | ids[2 : n + 2]
    else:  # number the pairs first
        pairs = np.unique((ids[:n] << 31) | ids[1 : n + 1], return_inverse=True)[1]
        key = (pairs << 31) | ids[2 : n + 2]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = times[inverse] > 1
    covered = np.zeros(len(ids), np.bool_)
    for k in range(3):
        covered[k : n + k] |= hit
    return int(covered.sum())


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts (BASE) and features (FEATURES) of whole texts; null texts have no words."""
    base, features = np.zeros((len(texts), len(BASE)), np.int64), np.zeros((len(texts), len(FEATURES)))
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    for i, text in enumerate(texts):
        data = (text or "").encode()
        words = data.split()  # at ASCII white space
        if not words:
            continue
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        lines = [x for x in data.split(b"\n") if x.strip()]
        chars = len(text) - int(by_byte[SPACES].sum())
        n = len(words)
        base[i] = n, chars, by_byte[SYMBOLS].sum(), len(lines) - len(set(lines)), repeated_words(ids)
        features[i] = (
            np.log(n), chars / n, base[i, 2] / chars, base[i, 3] / len(lines), base[i, 4] / n, by_byte[65:91].sum() / chars, by_byte[48:58].sum() / chars, by_byte[MARKS].sum() / chars,
            len(np.unique(ids)) / n, n / len(lines), by_byte[124] / n, sum(len(w) <= 2 for w in words) / n,
        )
    return base, features


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Trees:
    """Node arrays of all trees: rows go left where the feature is at most the cut. A leaf points at
    itself. floor: rows whose score is below it are refused; bad_caught and good_kept: shares of the held-out
    rows of each label that are refused and pass."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    floor: float = 0.0
    bad_caught: float = 0.0
    good_kept: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality."""
        if not len(self.roots):
            return np.ones(len(x))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


NO_TREES = Trees(*(np.zeros(0, np.int64) for _ in range(6)), depth=0, start=0.0)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0) -> Trees:
    """Histogram boosting; splits whose sides would stand against MONOTONE are not made, and the
    bound between them holds below."""
    if len(y) == 0 or y.min() == y.max():
        return NO_TREES
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    direction = [MONOTONE.get(f, 0) for f in FEATURES]
    start = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        weight = float(np.clip(-total_g / (total_h + 1), low, high))
        nodes.append([0, np.inf, me, me, weight * rate])
        best = (1e-6, None)
        for j in range(x.shape[1] if level < depth else 0):
            if not len(edges[j]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edges[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edges[j]) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            wl, wr = np.clip(-gl / (hl + 1), low, high), np.clip(-gr / (hr + 1), low, high)
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total_g**2 / (total_h + 1)
            gain[(hl < least) | (hr < least) | (direction[j] * (wr - wl) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k, wl[k], wr[k]))
        if best[1]:
            j, k, wl, wr = best[1]
            middle = (wl + wr) / 2
            under = binned[rows, j] <= k
            bounds = [(low, high), (low, high)]
            if direction[j]:
                bounds = [(low, middle), (middle, high)] if direction[j] > 0 else [(middle, high), (low, middle)]
            left = grow(rows[under], g, h, level + 1, *bounds[0])
            right = grow(rows[~under], g, h, level + 1, *bounds[1])
            nodes[me] = [j, edges[j][k], left, right, 0.0]
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = flat(nodes[first:], [0], depth, 0.0, first)
        score += tree.value[descend(tree, x)]
    return flat(nodes, roots, depth, start)


def with_floor(trees: Trees, x: np.ndarray, y: np.ndarray, keep: float = 0.998) -> Trees:
    """trees with the floor (at most a half) that lets this share of good rows pass, of rows that trained none
    of them, and what it does with both kinds of those rows."""
    good, bad = (np.sort(trees.score(x[y == label])) for label in (1, 0))
    if len(trees.roots) and len(good):
        floor = float(min(0.5, good[int((1 - keep) * len(good))]))
        return replace(trees, floor=floor, good_kept=float((good >= floor).mean()), bad_caught=float((bad < floor).mean()) if len(bad) else 0.0)
    return trees


def flat(nodes: list[list[float]], roots: list[int], depth: int, start: float, offset: int = 0) -> Trees:
    a = np.array(nodes, np.float64)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64) - offset, a[:, 3].astype(np.int64) - offset, a[:, 4], np.array(roots), depth, start)


def descend(tree: Trees, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        at = np.where(x[np.arange(len(x)), tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
    return at


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 8000, held_out: int = 5) -> Trees:
    """Trees from the labelled rows with the smallest hashes of their key, at most max_rows of them; every
    held_out-th of these trains no tree but sets the floor.

    Only their features come to the driver. Labels other than 0 and 1, null keys and unlabelled or
    missing documents do not train; of a repeated key one row does, that of the smallest text and label.
    Without both classes there are no trees and every score is 1.
    """
    rated = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("double")).alias("_y"))
    chosen = rated.orderBy(F.xxhash64(key), key).limit(max_rows)
    rows = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "_y").agg(F.min(text).alias(text))

    def make():
        def work(texts):
            base, x = statistics(texts)
            return [(v.tolist(), bool(bad)) for v, bad in zip(x, base_failed(base), strict=True)]

        return work

    sample = map_texts(rows.withColumn("_held", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(held_out)) == 0), ["_y", "_held"], text, make, [T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("bad", T.BooleanType())]).where(~F.col("bad")).toArrow()
    if not sample.num_rows:
        return NO_TREES
    x, y, held = np.array(sample.column("x").to_pylist()), np.array(sample.column("_y").to_pylist()), np.array(sample.column("_held").to_pylist())
    order = np.lexsort((*x.T, y))  # the same trees whatever order rows come in
    x, y, held = x[order], y[order], held[order]
    return with_floor(boost(x[~held], y[~held]), x[held], y[held])


def judge(docs: DataFrame, trees: Trees, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, the base counts, base_failed, score and kept of every row. Null and empty
    texts count 0 words and fail the base rules. The trees, a few hundred nodes, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = shared.value

        def work(texts):
            base, x = statistics(texts)
            bad, score = base_failed(base), model.score(x)
            return list(zip(*base.T.tolist(), bad.tolist(), score.tolist(), (~bad & (score >= model.floor)).tolist(), strict=True))

        return work

    fields = [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_texts(docs, keys, text, make, fields)


def rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the labelled rows of docs and judge every row."""
    return judge(docs, fit(docs, labels, key, text), [key], text)
