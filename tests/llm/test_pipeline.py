"""Every stage of the corpus pipeline on odd rows and on none, and the whole of it over written tables."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from claimloom.llm import language_id, pii, quality

from odd_rows import make_docs, words
from test_operators import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_entities string, kept boolean, class long, _key string, component_id long"


@pytest.fixture(scope="module")
def rows():
    """The operators' odd rows under column names that the stages use themselves, with entities in some."""
    out = [(*r[:5], "mine", r[6], r[7], "k", 9) for r in make_docs()]
    r = random.Random(2)
    out += [(60 + i, words(r, 80, "the of and to in erith onda thal wher mion".split()) + f"\nmail u{i}@host{i}.example.org", "en", None, None, None, None, None, None, None) for i in range(12)]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage_of_nothing(spark, sf_dir, documents, name):
    out = dict(C.STAGES)[name](spark, documents.limit(0), sf_dir)
    assert out.count() == 0 and (name == C.STAGES[-1][0] or out.schema == documents.schema)


def test_filtering_stages_keep_whole_rows(spark, sf_dir, documents, rows):
    known = language_id.predict(documents, language_id.fit(documents), ["doc_id", "text"]).collect()
    want = {(r.doc_id, r.text) for r in known if r.lang_pred != "und" and r.score >= 0.5}
    assert plain(C.keep_languages(spark, documents, sf_dir)) == sorted((r for r in rows if (r[0], r[1]) in want), key=repr)
    judged = quality.judge(documents, quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id", "text"]).collect()
    want = {(r.doc_id, r.text) for r in judged if r.kept}
    assert plain(C.keep_quality(spark, documents, sf_dir)) == sorted((r for r in rows if (r[0], r[1]) in want), key=repr)
    kept = {(i, t) for (i, t), x in zip(sorted(((r[0], r[1]) for r in rows), key=repr), sorted(brute_components([(r[0], r[1]) for r in rows]), key=repr), strict=True) if x[3]}
    gone = {i for i, _, _, stays in brute_components([(r[0], r[1]) for r in rows]) if not stays}
    assert plain(C.drop_near_duplicates(spark, documents, sf_dir)) == sorted((r for r in rows if r[0] not in gone), key=repr) and kept


def test_personal_data_goes_and_columns_stay(spark, sf_dir, documents, rows):
    out = C.replace_personal_data(spark, documents, sf_dir)
    assert out.schema == documents.schema
    old, new = ({r[0]: r for r in x if r[0] is not None and r[0] >= 60} for x in (rows, plain(out)))
    assert all(new[i][2:] == old[i][2:] and new[i][1] != old[i][1] and f"u{i - 60}@" not in new[i][1] for i in old)
    assert plain(out.where("doc_id < 60")) == sorted((r for r in rows if r[0] is not None and r[0] < 60), key=repr)


def test_run(spark, sf_dir, documents):
    """run() gives what its stages give one by one, whole: every kept document's ids, in gapless sequences."""
    docs = documents
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = C.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want) and len(got) > 20
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1]) and sum(n for _, n in p) <= 2048
    assert os.path.isdir(sf_dir) and pii.KINDS
