"""Rules that look at the files beside a record."""

import hashlib
import json

from claimloom.plans.advise import advise
from claimloom.plans.validate import validate
from claimloom.sources import records as R
from test_records import RECORD, TEXT


def test_files_beside_records(spark, tmp_path):
    pdf = b"the paper"
    text = TEXT.replace("a" * 64, hashlib.sha256(pdf).hexdigest())
    beside = {"same": {"caching.pdf": pdf}, "changed": {"caching.pdf": b"another"}, "stray": {"Caching.PDF": pdf, "old.PDF": b"x", "notes.txt": b"y"}, "none": {}, "no text": {}, "no record": {"caching.pdf": b"z"}}
    for key, files in beside.items():
        folder = tmp_path / key
        folder.mkdir()
        for name, body in files.items():
            (folder / name).write_bytes(body)
    records = spark.createDataFrame([(k, json.dumps(RECORD)) for k in beside if k != "no record"], "paper_key string, raw string")
    texts = spark.createDataFrame([(k, text) for k in beside if k != "no text"], "paper_key string, text string")
    files = R.read_pdfs_beside(spark, [str(tmp_path / k) for k in beside])
    assert {(r.paper_key, r.name) for r in files.collect()} == {("same", "caching.pdf"), ("changed", "caching.pdf"), ("stray", "Caching.PDF"), ("stray", "old.PDF"), ("no record", "caching.pdf")}
    found = sorted((r.paper_key, r.rule) for r in validate(records, texts, files).collect())
    assert found == [("changed", "V-11"), ("no record", "V-03"), ("no text", "V-02")]
    named = [(r.paper_key, r.message) for r in advise(records, texts, files).where("rule = 'A-05'").collect()]
    assert named == [("stray", "names caching.pdf, and beside it stands old.PDF")]
