import hashlib
import json
import os
import time

from claimloom.__main__ import main
from claimloom.sources import pdf
from test_records import RECORD, TEXT


def put(folder, record, text=TEXT):
    folder.mkdir()
    (folder / "claims.json").write_text(json.dumps(record))
    (folder / "text.txt").write_text(text)
    return str(folder)


def test_commands(spark, tmp_path, capsys):
    good = put(tmp_path / "good", RECORD)
    assert main(["render", good]) == 0 and (tmp_path / "good" / "claims.md").read_text().startswith("# Claims: Remote Build Caching")
    bad = put(tmp_path / "bad", {**RECORD, "claims": []})
    assert main(["validate", good, bad]) == 1
    out = capsys.readouterr().out
    assert "PROBLEM bad V-82" in out and "PROBLEM good" not in out
    unsure = json.loads(json.dumps(RECORD))
    unsure["excluded"][0]["reason"] = "Unsure; describes the data."
    assert main(["render", put(tmp_path / "unsure", unsure)]) == 1
    capsys.readouterr()
    assert main(["validate", good, str(tmp_path / "none")]) == 2 and "PROBLEM none V-01" in capsys.readouterr().out
    page = (tmp_path / "good" / "claims.html").read_text()
    assert page.count("<article") == 5 and '<article id="C2">' in page and "stated in 2 sentences" in page and not (tmp_path / "unsure" / "claims.html").exists()
    odd = json.loads(json.dumps(RECORD).replace("Remote Build Caching", "A <b> & 'c'"))
    odd["paper"]["id"] = "odd"
    odd["$schema"] = "x"
    body, site = b"%PDF", tmp_path / "site"
    (tmp_path / "good" / "caching.pdf").write_bytes(body)
    (tmp_path / "good" / "text.txt").write_text(TEXT.replace("a" * 64, hashlib.sha256(body).hexdigest()))
    (tmp_path / "d.md").write_text("# Terms\nA *claim*.\n")
    for name in ("gone", "odd", ".staged-old", ".staged-live"):
        (site / name).mkdir(parents=True)
    (site / "gone" / "claims.html").write_text("of another build")
    (site / "odd" / "caching.pdf").write_bytes(b"that this build does not have")
    os.utime(site / ".staged-old", (time.time() - 7200,) * 2)
    assert main(["site", good, put(tmp_path / "odd", odd), "--out", str(site), "--definitions", str(tmp_path / "d.md")]) == 0
    assert "A &lt;b&gt; &amp; &#x27;c&#x27;" in (site / "odd" / "claims.html").read_text()
    assert (site / "index.html").read_text().count("/claims.html") == 2 and "$schema" not in json.loads((site / "odd" / "claims.json").read_text())
    assert (site / "caching" / "caching.pdf").read_bytes() == body and '<a href="caching.pdf">' in (site / "caching" / "claims.html").read_text()
    assert not (site / "odd" / "caching.pdf").exists() and '<a href="caching.pdf">' not in (site / "odd" / "claims.html").read_text()
    assert '<h1 id="terms">' in (site / "definitions" / "index.html").read_text() and "definitions/" in (site / "index.html").read_text()
    assert f"WARNING {site / 'gone'} is still published" in capsys.readouterr().out
    there = [".staged-live", "caching", "definitions", "gone", "index.html", "odd"]
    assert sorted(p.name for p in site.iterdir()) == there
    odd["paper"]["id"] = "CACHING"
    twin = put(tmp_path / "twin", odd)
    assert main(["site", good, twin, "--out", str(site)]) == 1 and f"WARNING {site / 'caching' / 'claims.html'} is still" in capsys.readouterr().out
    assert sorted(p.name for p in site.iterdir()) == there
    assert main(["schema", "--out", str(tmp_path / "s.json")]) == 0 and json.loads((tmp_path / "s.json").read_text())["type"] == "object"


def test_pages_of_a_text(spark):
    rows = pdf.page_lines(spark.createDataFrame([("p", "a\nb\f\fc\n\f"), ("q", None)], "paper_key string, text string")).collect()
    assert [(r.page, r.line_no, r.line) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (2, 0, ""), (3, 0, "c"), (3, 1, "")]
