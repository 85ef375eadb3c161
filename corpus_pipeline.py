"""A corpus from documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of documents: rows without a recognised language go, then rows that fail
the quality rules, then all but one document of each near-duplicate group; personal data is
replaced; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import language_id, near_dedup, packing, pii, quality
from claimloom.llm.shared import choose, store, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and likelier than all others together."""
    trees = language_id.fit(docs)
    return choose(docs, "text", lambda d, keys, text: language_id.predict(d, trees, keys, text).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= 0.5)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on the labels of those that are left."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return choose(docs, "text", lambda d, keys, text: quality.judge(d, trees, keys, text).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows with a null id are in no group and stay."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every entity replaced by its surrogate; all other columns as they were."""
    return pii.pseudonymise(docs, key="surrogates", count=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0, memo=120_000, batch_chars=500_000)  # workers that ran the other stages have less room


STAGES = [("language_id", keep_languages), ("quality_rules", keep_quality), ("minhash_near_dedup", drop_near_duplicates), ("pii", replace_personal_data), ("best_fit_packing", pack)]

#: Tokenizers, trees fitted in numpy and ciphers have no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs)  # every later stage reads its input more than once
    return docs
