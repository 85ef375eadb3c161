"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Steps, each spread over all tasks and written down before the next, so that every plan is short:
1. Every text gives a 128-bit digest of its word sequence, its number of distinct shingles and a
   signature. Equal sequences form a class at once, so groups of copies cost one row from here on.
2. Signatures are cut into bands. Each band value's smallest class is its leader; a class is a
   candidate with the leaders of its bands, so a band of n classes gives n candidates and not n^2.
3. Candidates are verified on full shingle sets; the links give components.
4. Bands that still hold several components are searched once more in blocks: first by sketches of the
   signatures, then with the texts of those classes alone that have a partner which the sketches
   don't rule out. Pairs are verified on full sets as well, in the task that finds them.
5. Components of all links are brought back to the documents.

A band value, a leader's classes and a band's pairs are all dealt out in blocks of bounded size, and keys
that hold many rows are broadcast, of which there can only be a bounded number.
At similarity 0.75 a pair shares no band with probability (1 - 0.75^4)^32 = 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import Scratch, cut, hot_join, id_type, map_texts

SLOTS, BAND, BANDS = 256, 4, 32  # bands use the first 128 slots, estimates all
#: Pairs whose signatures agree in fewer slots are under 0.75 but for 5 standard deviations.
LEAST_AGREEING = int(SLOTS * (0.75 - 5 * (0.75 * 0.25 / SLOTS) ** 0.5))
BLOCK = 256  # classes in a block of verification
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Added to an element's hash for its j-th step.
STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * MULTIPLIER


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def digest_of(words: list[bytes]) -> bytes:
    """128-bit digest of a word sequence: no two of 10^11 texts share one but with a chance of 10^-17."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words, one of them all."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    if n < 1:
        n, width = 1, len(h)
    code = np.full(n, width, np.uint64)
    for k in range(width):
        code = mix((code + h[k : n + k]) * MULTIPLIER)
    return np.unique(code)


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures: 16 bits of each slot's minimum.

    Every element walks through its own random permutation of the slots, and its j-th step offers its
    slot the value j plus a random fraction. All sets take step j together; a set stops as soon as
    all its slots hold values under j + 1, which later steps cannot lower.
    """
    least = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []
    permutation = None
    flat = least.ravel()
    for j in range(SLOTS):
        if not len(element):
            break
        z = mix(element + STEPS[j])
        k = j + ((z & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j) >> np.uint64(32)).astype(np.int64)
        if permutation is None:
            slot = k
            for i in range(j - 1, -1, -1):  # where the element at k stood before each earlier swap
                slot = np.where(slot == swaps[i], i, slot)
            swaps.append(k)
        else:
            rows = np.arange(len(element))
            slot = permutation[rows, k].astype(np.int64)
            permutation[rows, k] = permutation[:, j]
            permutation[:, j] = slot
        np.minimum.at(flat, owner * SLOTS + slot, np.uint64(j << 32) | (z >> np.uint64(32)))
        open_set = least.max(axis=1) >= np.uint64((j + 1) << 32)
        stays = open_set[owner]
        if not stays.all():
            owner, element = owner[stays], element[stays]
            swaps = [s[stays] for s in swaps]
            permutation = permutation[stays] if permutation is not None else None
        if permutation is None and j == 11:
            permutation = np.tile(np.arange(SLOTS, dtype=np.int16), (len(element), 1))
            rows = np.arange(len(element))
            for i, s in enumerate(swaps):
                held = permutation[rows, s].copy()
                permutation[rows, s] = permutation[:, i]
                permutation[:, i] = held
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame, keys: list[str], text: str, width: int) -> DataFrame:
    """Keys, digest, n_shingles and signature (64 numbers of four slots) of every row. Texts without words
    have no digest; texts that are one shingle of fewer words equal only their own class and have no
    signature."""

    def make():
        def work(texts):
            out, sets, at = [], [], []
            known: dict[bytes, int] = {}
            for i, t in enumerate(texts):
                words = words_of(t)
                if not words:
                    out.append([None, 0, None])
                    continue
                digest = digest_of(words)
                if digest in known:
                    out.append(out[known[digest]])
                    continue
                known[digest] = i
                s = shingles(words, width)
                out.append([digest, len(s), None])
                if len(words) >= width:
                    sets.append(s)
                    at.append(i)
            for i, sig in zip(at, super_minhash(sets).view(np.int64), strict=True):
                out[i][2] = sig
            return [tuple(x) for x in out]

        return work

    return map_texts(docs, keys, text, make, [T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()), T.StructField("signature", T.ArrayType(T.LongType()))], batch_chars=500_000)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of each key of a stream sorted by key; only one key's rows and a batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Those (a, b) of pairs (block, a, b) whose full shingle sets are similar enough.

    Each block's classes are sent to it once; pairs that the block has already joined through
    others are skipped, as they add nothing to the components.
    """
    pairs = pairs.select("block", "a", "b")
    ends = pairs.select("block", F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = ends.join(texts, "class").select("block", F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = needed.unionByName(pairs.withColumn("text", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        found: list[tuple[int, int]] = []
        for group in groups_of(batches, "block"):
            sets: dict[int, np.ndarray] = {}
            todo = []
            for a, b, t in zip(*(group.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if b is not None:
                    todo.append((a, b))
                elif a not in sets:
                    sets[a] = shingles(words_of(t), width)
            root = {c: c for c in sets}

            def top(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for a, b in todo:
                if (x := top(a)) != (y := top(b)) and similar(sets[a], sets[b], percent):
                    root[max(x, y)] = min(x, y)
                    found.append((a, b))
            if len(found) >= 50_000:
                yield out(found)
                found = []
        yield out(found)

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def sketch_of(signature: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The low byte of every slot: enough to rule pairs out, as equal slots stay equal."""
    flat = signature.flatten().to_numpy(zero_copy_only=False)
    return [x.tobytes() for x in (flat.view(np.uint16) & 0xFF).astype(np.uint8).reshape(-1, SLOTS)]


def with_sketch(classes: DataFrame) -> DataFrame:
    """class, n_shingles and sketch of the classes that have a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sketch_of(batch.column(2)), pa.binary())], names=["class", "n_shingles", "sketch"])

    return classes.where(F.col("signature").isNotNull()).select("class", "n_shingles", "signature").mapInArrow(run, "class long, n_shingles long, sketch binary")


def cross_links(members: DataFrame, texts: DataFrame, percent: int, width: int, keep: Scratch) -> DataFrame:
    """(a, b) of similar classes in different components that share a band, where nothing else ties
    their components together yet. Candidate pairs are never rows: they are found by sizes and sketches, and
    verified on full sets, inside one task that holds their texts.

    Members of large bands are dealt to blocks; a block pair is searched in one place, so a band of
    n members sends each n / (2 * BLOCK) times, without its text, and never to one task all of them.
    Equal four-byte parts of two sketches stand for equal bands where a pair's first shared band is
    sought, which errs with a chance of 10^-8.
    """
    blocks = F.ceil(F.col("n_members") / (2 * BLOCK))
    dealt = members.withColumn("_blocks", blocks).withColumn("_mine", F.pmod(F.xxhash64("class"), F.col("_blocks")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.select(F.xxhash64("spot", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("block"), "spot", "band", "leader", "class", "component", "n_shingles", "sketch", "_mine", "_other")

    def candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Rows i of one band value and the rows that may be similar to each."""
        cls, comp, n, leader, mine, other, band = (t.column(c).to_numpy() for c in ("class", "component", "n_shingles", "leader", "_mine", "_other", "band"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(cls), SLOTS)
        bands = np.ascontiguousarray(sketch[:, : BAND * BANDS]).view(np.uint32)
        same, low = bool((mine == other).all()), int(min(mine.min(), other.min()))
        for i in np.flatnonzero((mine == low) & (cls != leader)).tolist():  # pairs with leaders are verified
            j = np.flatnonzero((comp != comp[i]) & (cls != leader) & (cls > cls[i] if same else mine != low) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            j = j[(bands[j] == bands[i]).argmax(axis=1) == band[i]]  # in the first band they share
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= LEAST_AGREEING]
            if len(j):
                yield i, j

    def each_spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for group in groups_of(batches, "block"):
            spot = group.column("spot").to_numpy()  # two block pairs could hash alike: only rows of one band value meet
            for v in np.unique(spot).tolist():
                yield group.filter(pa.array(spot == v))

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_spot(batches):
            wanted = np.zeros(t.num_rows, np.bool_)
            for i, j in candidates(t):
                wanted[i] = wanted[j] = True
            if wanted.any():
                yield from t.filter(pa.array(wanted)).to_batches()

    def search(t: pa.Table) -> list[tuple[int, int]]:
        cls, comp, texts, sets, found = t.column("class").to_pylist(), t.column("component").to_pylist(), t.column("text"), {}, []
        root = {c: c for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(words_of(texts[i].as_py()), width)
            return sets[i]

        for i, js in candidates(t):
            for k in js.tolist():
                if (x := top(comp[i])) != (y := top(comp[k])) and similar(full(i), full(k), percent):
                    root[max(x, y)] = min(x, y)
                    found.append((cls[i], cls[k]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_spot(batches):
            if found := search(t):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    some = keep(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(hopeful, dealt.schema))
    return keep(some.join(texts, "class").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Key, n_shingles, component_id (the smallest key reachable over links) and kept (key is its
    component_id) of every row.

    Null and wordless texts have an empty set and link with nothing. Rows with a null key link with
    nothing and are kept. Repeated keys are one document with all its texts' links. Other columns
    are not read. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as keep:
        return cut(_near_duplicates(docs, key, text, width, percent, keep))


def _near_duplicates(docs: DataFrame, key: str, text: str, width: int, percent: int, keep: Scratch) -> DataFrame:
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows = keep(signatures(plain, ["_key", "_hash"], "text", width))
    made = rows.where(F.col("digest").isNotNull() & F.col("_key").isNotNull())
    # A class is numbered as it is written, so its number holds from here on.
    grouped = made.groupBy("digest").agg(F.min("_key").alias("first"), F.min_by("_hash", "_key").alias("_hash"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"), F.count("*").alias("copies"))
    classes = keep(grouped.withColumn("class", F.monotonically_increasing_id()))
    n_rows, n_classes = rows.count(), classes.count()
    repeated = keep(made.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1"))
    once = repeated.isEmpty()

    spots = F.posexplode(F.slice("signature", 1, BANDS)).alias("band", "value")
    bands = classes.where(F.col("signature").isNotNull()).select("class", spots).select("class", F.col("band").cast("byte").alias("band"), F.xxhash64("band", "value").alias("spot"))
    leaders = bands.groupBy("spot").agg(F.min("class").alias("leader"), F.count("*").alias("n_members")).where("n_members > 1")
    member = keep(hot_join(bands, leaders, "spot", "n_members", BANDS * n_classes, salt="class"))

    # Candidates with leaders, in blocks of one leader each.
    stars = keep(member.where("class <> leader").groupBy("leader", "class").agg(F.max("n_members").alias("n")))
    candidates = stars.select(F.explode(F.array("class", "leader")).alias("c")).distinct()
    wanted = classes.join(candidates, F.col("class") == F.col("c"), "left_semi").select(F.col("first").alias("_key"), "_hash", "class")
    texts = wanted.join(plain, ["_key", "_hash"]).select("class", "text")
    texts = keep(texts if once else texts.dropDuplicates(["class"]))  # rows that repeat a key may repeat a text
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK))
    first = keep(verify(stars.select(F.xxhash64("leader", part).alias("block"), F.col("leader").alias("a"), F.col("class").alias("b")), texts, percent, width))
    joined = components(first, "a", "b", keep)

    # Bands that still hold several components, searched in blocks.
    placed = member.where("n_members > 2").join(joined, F.col("class") == F.col("vertex"), "left").select("spot", "band", "leader", "class", F.coalesce("component", "class").alias("component"))
    several = placed.groupBy("spot").agg(F.min("component").alias("_l"), F.max("component").alias("_h"), F.count("*").alias("n_members")).where("_l <> _h").select("spot", "n_members")
    open_bands = keep(hot_join(placed, several, "spot", "n_members", BANDS * n_classes, salt="class").join(with_sketch(classes), "class"))
    more = cross_links(open_bands, texts, percent, width, keep)
    if not once:  # different texts under one key are one document
        same = made.join(repeated, "_key").join(classes.select("digest", "class"), "digest").select("_key", "class").distinct()
        more = more.unionByName(same.join(same.groupBy("_key").agg(F.min("class").alias("b")), "_key").select(F.col("class").alias("a"), "b"))

    # Links between components, and each component's smallest key.
    label = lambda e, c: e.join(joined, F.col(c) == F.col("vertex"), "left").withColumn(c, F.coalesce("component", c)).drop("vertex", "component")
    merged = components(label(label(more, "a"), "b"), "a", "b", keep)
    sizes = joined.groupBy("component").agg(F.count("*").alias("n")).withColumnRenamed("component", "vertex")
    merged = merged.join(sizes, "vertex", "left").select(F.col("vertex").alias("class"), "component", F.coalesce("n", F.lit(1)).alias("n"))
    named = hot_join(label(classes.select("digest", "first", "copies", "class"), "class"), merged, "class", "n", n_classes, "left", salt="digest").select("digest", "first", "copies", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"), F.count("*").alias("n"))
    by_class = hot_join(named, smallest, "component", "n", n_classes, salt="digest").select("digest", "copies", "smallest")
    out = hot_join(rows.select("_key", "n_shingles", "digest"), keep(by_class), "digest", "copies", n_rows, "left", salt="_key")
    component = F.when(F.col("_key").isNull(), F.lit(None)).otherwise(F.coalesce("smallest", "_key"))
    return out.select(F.col("_key").alias(key), "n_shingles", component.cast(id_type(docs, key)).alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


#: The same by brute force: all pairs that share a shingle, and all that is reachable over the links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS shingle FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
