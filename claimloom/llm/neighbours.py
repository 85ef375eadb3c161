"""Approximate nearest neighbours by multiprobe p-stable hashing, largest cosine first.

Vectors are scaled to length one, so nearness by cosine is nearness by distance. In each of a few tables
a vector's bucket is floor((a.v + b) / width) for a handful of Gaussian directions a; there are as many
directions as give buckets of some hundred rows. A query visits its own bucket and then perturbed ones,
in order of the estimated chance that a near vector fell there (the sum of squared distances to the bucket
walls that are crossed). A bucket's rows meet all queries that visit it in matrix products; the best of
each are scored again by exact cosine in double precision, and the tables' candidates are merged.

Equal vectors are one class with its smallest ids, so a group of copies costs one row. A bucket's rows are
dealt to chunks of bounded size and a query is sent once to each chunk of the buckets it visits. How many
buckets a query visits is fitted on a bounded sample; every row is indexed. Where even the most probes
miss the recall there, or a query finds too few candidates, all rows are searched, in the same chunks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near_dedup import groups_of
from .shared import cut

#: Rows of a bucket that one task ranks at a time, and queries that meet them at once.
CHUNK, ASKED = 8192, 256
#: Rows that a bucket should hold, about.
BUCKET = 256


@dataclass(frozen=True)
class Hashing:
    """directions: tables x dimensions x components."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    probes: int

    @classmethod
    def make(cls, dimensions: int, rows: int, tables: int = 2, width: float = 2.0, seed: int = 7) -> Hashing:
        r = np.random.default_rng(seed)
        components = min(10, max(2, round(math.log(max(1, rows / BUCKET), 3.5))))  # a component of this width parts rows by about 3.5
        return cls(r.normal(size=(tables, dimensions, components)), r.uniform(0, width, size=(tables, components)), width, 1)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """tables x rows x components: where a vector lies, in bucket widths."""
        return (np.einsum("nd,tdc->tnc", unit, self.directions) + self.offsets[:, None]) / self.width

    @staticmethod
    def codes(buckets: np.ndarray) -> np.ndarray:
        """One number for each bucket; components are small numbers, six bits each."""
        out = np.zeros(buckets.shape[:-1], np.int64)
        for c in range(buckets.shape[-1]):
            out = (out << 6) | (np.clip(buckets[..., c], -31, 31) + 32).astype(np.int64)
        return out

    def visits(self, place: np.ndarray) -> np.ndarray:
        """Codes of the buckets that a query at this place visits, likeliest first."""
        home = np.floor(place)
        inside = (place - home).tolist()
        # A wall is (cost of crossing it, component, what crossing adds to the code).
        walls = sorted([(x * x, i, -1) for i, x in enumerate(inside)] + [((1 - x) * (1 - x), i, 1) for i, x in enumerate(inside)])
        cost, component = [w[0] for w in walls], [1 << w[1] for w in walls]
        added = [d << 6 * (len(inside) - 1 - i) for _, i, d in walls]
        start = int(self.codes(home))
        # On the heap: cost, code, components crossed (-1: one of them twice), last wall, cost and code without it.
        out, heap = [start], [(cost[0], start + added[0], component[0], 0, 0.0, start, 0)]
        while heap and len(out) < self.probes:
            total, code, crossed, last, rest, rest_code, rest_crossed = heapq.heappop(heap)
            if crossed >= 0:  # a component moves one way only
                out.append(code)
            if (n := last + 1) < len(walls):
                c = component[n]
                heapq.heappush(heap, (rest + cost[n], rest_code + added[n], -1 if rest_crossed < 0 or rest_crossed & c else rest_crossed | c, n, rest, rest_code, rest_crossed))
                heapq.heappush(heap, (total + cost[n], code + added[n], -1 if crossed < 0 or crossed & c else crossed | c, n, total, code, crossed))
        return np.array(out, np.int64)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def fit(hashing: Hashing, unit: np.ndarray, k: int, recall: float, queries: int = 100, most: int = 2000) -> Hashing | None:
    """The fewest probes up to `most` that find this share of a sample's neighbours; None if none do.

    A sample's neighbours are farther apart than the whole table's, so its recall errs on the low side.
    """
    if len(unit) < 2:
        return hashing
    at = np.linspace(0, len(unit) - 1, min(queries, len(unit))).astype(int)
    cosine = unit[at] @ unit.T
    cosine[np.arange(len(at)), at] = -2
    near = np.argsort(-cosine, axis=1)[:, : min(k, len(unit) - 1)]
    places = hashing.places(unit)
    codes = hashing.codes(np.floor(places))
    widest = replace(hashing, probes=most)
    first = np.full(near.shape, most)  # at which probe a neighbour is found
    for i, q in enumerate(at):
        for t in range(len(codes)):
            visits = widest.visits(places[t, q])
            order = np.argsort(visits, kind="stable")
            found = np.minimum(np.searchsorted(visits[order], codes[t, near[i]]), len(order) - 1)
            hit = visits[order[found]] == codes[t, near[i]]
            first[i] = np.minimum(first[i], np.where(hit, order[found], most))
    needed = int(np.sort(first.ravel())[min(first.size - 1, math.ceil(recall * first.size) - 1)])
    return replace(hashing, probes=needed + 1) if needed < most else None


def _rows(batch: pa.RecordBatch | pa.Table, column: str = "vector") -> np.ndarray:
    values = batch.column(column)
    flat = values.combine_chunks().flatten() if isinstance(values, pa.ChunkedArray) else values.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _best(rows: pa.Table, queries: pa.Table, k: int) -> pa.RecordBatch:
    """Best k ids of every query among a chunk's rows."""
    vectors, ids = _rows(rows), rows.column("ids").to_pylist()
    lengths = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
    u = vectors / lengths[:, None]
    out_q, out_id, out_score = [], [], []
    for a in range(0, queries.num_rows, ASKED):
        part = queries.slice(a, ASKED)
        asked, names = _rows(part), part.column("class").to_pylist()
        sizes = np.sqrt(np.einsum("nd,nd->n", asked, asked))
        rough = (asked / sizes[:, None]) @ u.T
        if len(ids) > k:  # room for what rounding might order otherwise
            hits = rough >= np.partition(rough, -k, axis=1)[:, -k, None] - 1e-9
        else:
            hits = np.ones(rough.shape, np.bool_)
        for q, name in enumerate(names):
            v, found = asked[q], []
            for i in np.flatnonzero(hits[q]).tolist():
                score = float(np.dot(v, vectors[i])) / (float(sizes[q]) * float(lengths[i]))
                found += [(-score, j) for j in ids[i]]
            for score, j in heapq.nsmallest(k, found):
                out_q.append(name)
                out_id.append(j)
                out_score.append(-score)
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.binary()), pa.array(out_id, pa.int64()), pa.array(out_score, pa.float64())], names=["class", "vec_id", "score"])


def _search(stream: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best k entries of every query of every chunk. A chunk's rows come before its queries."""
    for group in groups_of(stream, "cell"):
        kind = group.column("kind").to_numpy()
        rows, queries = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
        if rows.num_rows and queries.num_rows:
            yield _best(rows, queries, k)


def _cell(table: int | Column, code: Column, chunk: Column) -> Column:
    return F.xxhash64(F.lit(table) if isinstance(table, int) else table, code, chunk)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = 0.93, sample: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found to each row for which the
    condition `queries` holds, out of all other rows; score is the cosine. Ties go to the smaller id.

    Rows whose vector is null, zero, or has null or non-finite components, and rows with a null id, take
    no part; nor do vectors of another length than most have (of lengths as frequent, the smallest). Repeated
    ids are one row (with the smallest of their vectors). Fewer rows than k: all of them. Empty table: no rows.
    """
    spark = vectors.sparkSession
    v = F.col("_v")
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    usable = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v"), queries.alias("_asks")).where("_id is not null and size(_v) > 0").where(sound)
    first = usable.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, element = first.n, usable.schema["_v"].dataType.elementType.simpleString()
    zero = F.lit(0).cast(element)
    usable = usable.where(F.size("_v") == dims).withColumn("_v", F.transform("_v", lambda x: F.when(x == 0, zero).otherwise(x))).withColumn("class", F.unhex(F.sha2(F.array_join(F.transform("_v", lambda x: x.cast("string")), ","), 256)))
    single = usable.groupBy("_id").agg(F.min(F.struct("_v", "class", "_asks")).alias("_s")).select("_id", "_s.*")

    # Of equal vectors the k + 1 smallest ids are enough for any query, itself left out.
    low = F.row_number().over(Window.partitionBy("class").orderBy("_id"))
    classes = cut(single.select("class", "_id", "_v").withColumn("_r", low).where(F.col("_r") <= k + 1).groupBy("class").agg(F.sort_array(F.collect_list("_id")).alias("ids"), F.min("_v").alias("vector")))
    asks = cut(single.where(F.coalesce("_asks", F.lit(False))).select("class", F.col("_id").alias("query_id")))
    asked = asks.select("class").distinct().join(classes.select("class", "vector"), "class")

    n = classes.count()
    taken = classes.orderBy(F.xxhash64("class")).limit(sample).select("vector").toArrow()
    hashing = fit(Hashing.make(dims, n), units(_rows(taken)), k, recall)
    best = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "vec_id"))

    def ranked(rows: DataFrame, calls: DataFrame) -> DataFrame:
        both = rows.withColumn("kind", F.lit(0)).unionByName(calls.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("cell").sortWithinPartitions("cell", "kind")
        found = both.mapInArrow(lambda stream: _search(stream, k + 1), "class binary, vec_id long, score double")
        return found.groupBy("class", "vec_id").agg(F.max("score").alias("score")).withColumn("_r", best).where(F.col("_r") <= k + 1).drop("_r")

    def everywhere(asked: DataFrame) -> DataFrame:
        total = max(1, -(-n // CHUNK))
        rows = classes.select(_cell(-1, F.lit(0), F.pmod(F.xxhash64("class"), F.lit(total))).alias("cell"), "class", "ids", "vector")
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")))
        return ranked(rows, asked.withColumn("part", part).select(_cell(-1, F.lit(0), F.col("part")).alias("cell"), "class", "vector"))

    if hashing is None:
        found = cut(everywhere(asked))
    else:
        found = cut(ranked(*_probed(classes, asked, hashing, element)))
        enough = found.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > k)
        short = cut(asked.join(enough, "class", "left_anti"))
        if not short.isEmpty():
            found = found.join(short.select("class"), "class", "left_anti").unionByName(everywhere(short))

    pairs = asks.join(found, "class").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _probed(classes: DataFrame, asked: DataFrame, hashing: Hashing, element: str) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with the cell that each stands in or asks."""
    shared = classes.sparkSession.sparkContext.broadcast(hashing)

    def index(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                codes = shared.value.codes(np.floor(shared.value.places(units(_rows(batch)))))
                for t, c in enumerate(codes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, np.int32)), pa.array(c), batch.column("class"), batch.column("ids"), batch.column("vector")], names=["table", "code", "class", "ids", "vector"])

    def probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for batch in stream:
            for i, place in enumerate(np.moveaxis(h.places(units(_rows(batch))), 1, 0) if batch.num_rows else []):
                visits = [h.visits(x) for x in place]
                row = np.full(sum(map(len, visits)), i)
                tables = np.repeat(np.arange(len(visits)), [len(x) for x in visits]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(tables), pa.array(np.concatenate(visits)), batch.column("class").take(pa.array(row))], names=["table", "code", "class"])

    indexed = cut(classes.mapInArrow(index, f"table int, code long, class binary, ids array<long>, vector array<{element}>"))
    chunks = indexed.groupBy("table", "code").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = indexed.join(chunks, ["table", "code"]).select(_cell(F.col("table"), F.col("code"), F.pmod(F.xxhash64("class"), F.col("chunks"))).alias("cell"), "class", "ids", "vector")
    # Visits are numbers until the empty buckets are gone; then each gets its query's vector.
    visits = asked.mapInArrow(probe, "table int, code long, class binary").join(chunks, ["table", "code"])
    calls = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("class", _cell(F.col("table"), F.col("code"), F.col("part")).alias("cell"))
    return rows, calls.join(asked, "class").select("cell", "class", "vector")
