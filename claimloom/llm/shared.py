"""Helpers that several of these operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset
    a local session (tests, one machine) gets a temporary one; a cluster must name its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and go on from the files."""
    folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back (smaller than a checkpoint, and its
    plan is a plain scan)."""
    path = path or f"{folder(df.sparkSession)}/claimloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one run of an operator writes to the shared folder; they go when the run ends.

    with Scratch(spark) as keep: once = keep(df)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{folder(spark)}/claimloom-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return store(df, f"{self.path}/{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that may be sent to all tasks at once.
MOST_HOT = 100_000


def hot_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "inner", salt: str | None = None) -> DataFrame:
    """big with the columns of small's row for its key; how: inner or left. `count` of small says how many rows
    of big have the key, and `total` how many rows big has.

    At most MOST_HOT keys can hold over 1/MOST_HOT of the rows. Those are broadcast, and their rows, dealt by
    the column `salt`, never meet in one task; what is left is joined by key.
    """
    over = F.col(count) > max(256, total // MOST_HOT)
    rest = [c for c in small.columns if c != key]
    hot = small.where(over).select(F.col(key).alias("_hot"), F.struct(*rest).alias("_found"))
    cold = small.where(~over).select(F.col(key).alias("_cold"), F.lit(0).alias("_zero"), F.struct(*rest).alias("_met"))
    one = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(salt or key), F.lit(1 << 20))))
    both = one.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_deal") == F.col("_zero")), "left").withColumn("_one", F.coalesce("_found", "_met"))
    both = both.where(F.col("_one").isNotNull()) if how == "inner" else both
    return both.select(*big.columns, *(F.col("_one")[c].alias(c) for c in rest))


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def choose(docs: DataFrame, text: str, decide: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """Rows of docs that decide() keeps, with all their columns as they were.

    decide(docs, keys, text) gets the columns under names that clash with nothing and returns those
    keys with columns of its own, already filtered.
    """
    names = docs.columns
    plain = [f"_column{i}" for i in range(len(names))]
    kept = decide(docs.toDF(*plain), plain, plain[names.index(text)])
    return kept.select(*plain).toDF(*names)


def map_texts(df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[[list[str]], list[dict]]], fields: list[T.StructField], batch_chars: int = 500_000) -> DataFrame:
    """One output row per input row: its key columns, then `fields` computed from its text.

    make() is called once per task and returns a function from a list of texts (null: None) to
    one tuple of values per text. Texts reach it in groups of about batch_chars characters, so memory
    follows that number and the longest single text, not the partition.
    """
    schema = T.StructType([T.StructField(k, id_type(df, k)) for k in keys] + fields)
    names, types = schema.fieldNames(), [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= batch_chars):
                    chars += len(texts[end] or "")
                    end += 1
                columns = list(zip(*work(texts[at:end]), strict=True))
                out = [c.slice(at, end - at) for c in rest] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(out, names=names)
                at = end

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)
