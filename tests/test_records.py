"""A worked record, and records broken in one place each: the rule that must fire, and that no other does."""

import copy
import json

import pytest

from claimloom.plans.validate import validate

S1 = "Across the 48 projects, median build time fell from 9.2 to 4.1 minutes, and the failure rate stayed at 3%."
RECORD = {
    "paper": {"id": "caching", "title": "Remote Build Caching", "pdf": "caching.pdf", "pages": 3},
    "main_results": [{"id": "R1", "quote": "Remote caching halves median build time without increasing build failures.", "page": 1, "section": "Abstract", "source": "abstract"}],
    "claims": [
        {"id": "C1", "quote": S1, "states": "Across the 48 projects, median build time fell from 9.2 to 4.1 minutes.", "page": 2, "section": "5.1", "serves": ["R1"], "split_from": "S1", "selection_reason": "R1 says caching halves build time."},
        {"id": "C2", "quote": S1, "states": "Across the 48 projects, the failure rate stayed at 3%.", "page": 2, "section": "5.1", "serves": ["R1"], "split_from": "S1", "selection_reason": "R1 says failures did not increase."},
    ],
    "excluded": [
        {"id": "E1", "quote": "We collected 1,203 builds from 48 projects.", "page": 2, "section": "4.2", "reason": "Describes the data."},
        {"id": "E2", "quote": "As shown, caching cut median build time.", "page": "2-3", "section": "6", "duplicate_of": ["R1", "C1"], "reason": "Repeats the result of R1."},
    ],
}
TEXT = f"""=== paper caching.pdf sha256:{"a" * 64} ===
=== page 1 ===
Abstract. Remote caching halves median build time with-
out increasing build failures.4 More follows with gpt-4 here.
=== page 2 ===
We collected 1,203 builds
from 48 projects. Across the 48 projects, median build time fell from 9.2 to 4.1
minutes, and the failure rate stayed at 3%.
As shown, caching cut
=== page 3 ===
median build time. The end of it all.
"""


def put(path, value):
    def edit(r):
        *walk, last = path
        for p in walk:
            r = r[p]
        if value is None:
            del r[last]
        else:
            r[last] = value

    return edit


FIRST = RECORD["main_results"][0]["quote"]


def second(r):
    """Another main result, on page 3."""
    r["main_results"].append({"id": "R2", "quote": "The end of it all.", "page": 3, "section": "6", "source": "conclusion"})


CASES = {
    "": lambda r: None,
    "V-13": put(["extra"], 1),
    "V-14": put(["excluded"], None),
    "V-15": put(["main_results", 0, "section"], None),
    "V-16": put(["excluded", 0, "extra"], "x"),
    "V-17": put(["paper", "title"], " "),
    "V-18": put(["paper", "pdf"], "a/caching.pdf"),
    "V-10": put(["paper", "pdf"], "other.pdf"),
    "V-22": put(["paper", "title"], "a‮b"),
    "V-23": put(["paper", "doi"], "https://doi.org/10.1145/1.2"),
    "V-24": put(["paper", "doi"], "11.1145"),
    "V-28": put(["paper", "id"], "a b"),
    "V-29": put(["paper", "pages"], True),
    "V-30": put(["paper", "pages"], 4),
    "V-31": put(["paper"], [1]),
    "V-32": put(["excluded"], {"a": 1}),
    "V-33": lambda r: r["excluded"].append("x"),
    "V-34": put(["excluded", 0, "id"], ""),
    "V-35": put(["excluded", 0, "id"], "E2"),
    "V-36": put(["excluded", 0, "id"], "X1"),
    "V-38": put(["excluded", 0, "reason"], "odd ‮ one"),
    "V-39": put(["excluded", 0, "reason"], " "),
    "V-40": put(["excluded", 0, "note"], ""),
    "V-41": put(["excluded", 0, "page"], True),
    "V-42": put(["excluded", 1, "page"], "1-3"),
    "V-43": put(["excluded", 0, "page"], 9),
    "V-47": put(["excluded", 0, "page"], "2-3"),
    "V-48": put(["excluded", 0, "page"], 3),
    "V-51": put(["excluded", 0, "quote"], "We collected 1,204 builds from 48 projects."),
    "V-52": put(["main_results", 0, "states"], "Remote caching doubles time."),
    "V-53": put(["main_results", 0, "states"], "build caching Remote"),
    "V-54": put(["main_results", 0, "source"], "title"),
    "V-55": put(["main_results", 0, "source"], "other"),
    "V-57": lambda r: [put(["claims", i, "split_from"], "T1")(r) for i in (0, 1)],
    "V-59": put(["claims", 1, "states"], "Across the 49 projects, the failure rate stayed at 3%."),
    "V-60": put(["claims", 1, "states"], "the failure rate stayed at 3% Across the 48 projects."),
    "V-61": put(["claims", 0, "serves"], []),
    "V-62": put(["claims", 0, "serves"], ["R1", 2]),
    "V-63": put(["claims", 0, "serves"], ["R1", "R1"]),
    "V-64": put(["claims", 0, "serves"], ["R1", "R2"]),
    "V-67": put(["excluded", 1, "duplicate_of"], []),
    "V-68": put(["excluded", 1, "duplicate_of"], ["R1", "R1"]),
    "V-69": put(["excluded", 1, "duplicate_of"], ["E2"]),
    "V-70": put(["excluded", 1, "duplicate_of"], ["C9"]),
    "V-73": put(["excluded", 0, "breaks_down"], ["C1"]),
    "V-74": put(["excluded", 1, "breaks_down"], ["R1"]),
    "V-76": put(["excluded", 0, "states"], "We collected"),
    "V-82": lambda r: [put(["claims"], [])(r)],
    "V-84": lambda r: r["claims"].pop(),
    "V-86": put(["claims", 1, "states"], RECORD["claims"][0]["states"]),
    "V-87": put(["claims", 1, "states"], S1),
    "V-09": lambda r: None,
    "V-19": put(["paper", "pdf"], ".."),
    "V-20": put(["paper", "pdf"], "caching\x01.pdf"),
    "V-25": put(["paper", "pdf"], "a/ "),
    "V-26": put(["paper", "pdf"], "Claims.json"),
    "V-27": put(["paper", "id"], "a" * 201),
    "V-49": lambda r: r["excluded"][0].update(quote="Nine tall trees [...] stood by the lake.", page=1),
    "V-50": lambda r: r["excluded"][0].update(quote="It used auto-ml here.", page=1),
    "V-56": put(["claims", 0, "split_from"], 3),
    "V-58": put(["claims", 0, "split_from"], "E1"),
    "V-65": lambda r: [second(r), r["claims"][0].update(quote=FIRST, states=FIRST, page=1, split_from=None, serves=["R2"])],
    "V-66": put(["claims", 0, "split_from"], None),
    "V-71": put(["excluded", 1, "breaks_down"], []),
    "V-72": put(["excluded", 0, "breaks_down"], ["R1", "R1"]),
    "V-75": put(["excluded", 0, "split_from"], "S1"),
    "V-77": lambda r: r["excluded"][0].update(quote=FIRST, page=1),
    "V-78": lambda r: r["main_results"].append({**r["main_results"][0], "id": "R2", "note": "As R1."}),
    "V-79": lambda r: r["excluded"][0].update(quote=r["excluded"][1]["quote"], page="2-3"),
    "V-80": put(["excluded", 0, "quote"], S1),
    "V-81": put(["claims", 1, "split_from"], "S2"),
    "V-83": lambda r: [second(r), [c.update(quote=FIRST, page=1, serves=["R2"]) for c in r["claims"]]],
    "V-85": put(["claims", 1, "quote"], "As shown, caching cut median build time."),
}
#: Texts of records whose rule needs another one than TEXT.
TEXTS = {
    "V-09": TEXT.split("\n", 1)[0] + "\nno page starts here\n",
    "V-49": TEXT.replace("=== page 2", "Nine tall trees\n" + "x y z\n" * 2000 + "stood by the lake.\n=== page 2"),
    "V-50": TEXT.replace("=== page 2", "It used auto-ml2 here.\n=== page 2"),
}


@pytest.fixture(scope="module")
def problems(spark):
    rows = []
    for rule, edit in CASES.items():
        r = copy.deepcopy(RECORD)
        edit(r)
        rows.append((rule or "valid", json.dumps(r)))
    rows += [("V-05", "{not json"), ("V-08", "[1]"), ("V-06", json.dumps(RECORD).replace('"Describes', "[" * 2000 + '"Describes'))]
    odd = json.dumps({**RECORD, "doi\\": 1})
    rows += [("V-21", odd.replace("Remote Build", "\\ud800\\ud83d\\ude00")), ("V-37", odd.replace("Abstract", "\\\\\\udc00")), ("no half", odd.replace("Abstract", "\\\\ud800 \\ud83d\\ude00"))]
    texts = [(k, TEXTS.get(k, TEXT)) for k, _ in rows] + [("V-12", TEXT + "=== page 2 ===\nagain\n")]
    rows.append(("V-12", json.dumps(RECORD)))
    out = validate(spark.createDataFrame(rows, "paper_key string, raw string"), spark.createDataFrame(texts, "paper_key string, text string")).collect()
    by = {k: {} for k, _ in rows}
    for p in out:
        by[p.paper_key].setdefault(p.rule, []).append((p.label, p.message))
    return by


def test_valid(problems):
    assert problems["valid"] == {}


@pytest.mark.parametrize("rule", [*[c for c in CASES if c], "V-05", "V-06", "V-08", "V-12", "V-21", "V-37"])
def test_rule(problems, rule):
    assert rule in problems[rule], problems[rule]


def test_unpaired_surrogates_are_named(problems):
    assert [x for x, _ in problems["V-21"]["V-21"]] == ["paper.title"] and "V-37" not in problems["V-21"]
    assert [x for x, _ in problems["V-37"]["V-37"]] == ["main_results[0] (R1).section"] and "V-21" not in problems["V-37"]
    assert not {"V-21", "V-37"} & set(problems["no half"]) and "V-05" not in problems["V-06"]


ADVISORIES = {
    "A-01": put(["paper", "title"], "Another Paper Entirely"),
    "A-06": put(["excluded", 0, "reason"], "Describes the data and would not change R7."),
    "A-12": put(["claims", 0, "selection_reason"], "It says that caching halves the build time."),
    "A-13": put(["claims", 0, "selection_reason"], "R1 needs it."),
    "A-14": put(["excluded", 0, "reason"], "There is no main result that depends on it."),
    "A-15": put(["excluded", 0, "reason"], "Important result."),
    "A-16": put(["excluded", 1, "duplicate_of"], ["C1"]),
    "A-20": put(["main_results", 0, "section"], "5 Summary RQ1"),
    "A-21": put(["excluded", 0, "note"], "Table 2 prints the parts of the sentence's 1,203: 700 and 502."),
    "A-22": put(["excluded", 0, "section"], "s" * 101),
    "A-23": put(["excluded", 1, "quote"], "We collected 1,203 builds from 48 projects. Across the 48 projects, median build time fell"),
    "A-27": lambda r: [put(["claims", i, "quote"], S1.replace("fell", "fell by more than half"))(r) for i in (0, 1)],
    "A-29": lambda r: [put(["claims", i, "quote"], S1.replace("stayed", "did not move"))(r) for i in (0, 1)],
    "A-30": lambda r: [put(["main_results", 0, "quote"], "Caching is faster without failures.")(r), put(["main_results", 0, "states"], "Caching is without failures.")(r)],
    "A-31": lambda r: [put(["main_results", 0, "quote"], "From 9 to 4 it fell.")(r), put(["main_results", 0, "states"], "4 from 9 it fell.")(r)],
    "A-32": lambda r: [put(["main_results", 0, "quote"], "It did not reduce time.")(r), put(["main_results", 0, "states"], "It did reduce time.")(r)],
    "A-08": lambda r: [put(["excluded", 0, "quote"], "out increasing build failures.")(r), put(["excluded", 0, "page"], 1)(r)],
    "A-11": put(["excluded", 0, "quote"], "We collected 1,203 builds"),
    "A-09": put(["excluded", 0, "quote"], "1,203 builds from 48 projects."),
    "A-17": lambda r: [r["main_results"].append({**r["main_results"][0], "id": "R2"}), r["claims"][0]["serves"].append("R2")],
    "A-18": lambda r: [r["main_results"].append({**r["main_results"][0], "id": "R2"}), [c["serves"].append("R2") for c in r["claims"]]],
    "A-24": put(["excluded", 1, "quote"], "We collected 1,203 builds from 48 projects."),
    "A-02": put(["excluded", 0, "section"], "9 Data"),
    "A-03": put(["excluded", 0, "section"], "5.1 Build Times"),
    "A-07": lambda r: r["claims"][0].update(quote="alpha 12 13 14", states="alpha 12 13 14", page=1),
    "A-10": lambda r: r["excluded"][0].update(quote="It ran the build", page=1),
    "A-19": lambda r: [r["main_results"].append({**r["main_results"][0], "id": "R2"}), r["claims"].extend({**r["claims"][0], "id": f"C{i}", "serves": s} for i, s in ((3, ["R2"]), (4, ["R1", "R2"]))), r["claims"][0]["serves"].append("R2")],
    "A-25": put(["claims", 0, "states"], "Median build time fell to 4.1 from 9.2 minutes across 48 projects."),
    "A-26": lambda r: [put(["claims", i, "quote"], S1.replace("minutes", "minutes, respectively"))(r) for i in (0, 1)],
    "A-28": lambda r: [put(["claims", i, "quote"], S1.replace("stayed", "never moved"))(r) for i in (0, 1)],
}


#: What stands between "The rate of it" and "stayed the same.", by the rule that refuses it (none: fine).
GAPS = {
    ("V-44", "title"): "5.2 Other Things",
    ("V-44", "far from its number at the margin"): "6.1               Other Things",
    ("V-44", "capitals"): "9     C ONCLUSION",
    ("V-44", "indented near its number"): "   5.2  Other Things",
    ("", "axis tick"): "   1.0          Data",
    ("V-46", "more than nine words: a sentence"): "5.2 A Long Row of Words That Goes On For Ten",
    ("V-44", "nine words"): "5.2 A Long Row of Words That Goes On Nine",
    ("V-46", "a verb: a sentence"): "5.2 Our Data Are Here",
    ("", "cells in capitals"): "1     TOTAL     COUNT     SHARE",
    ("", "beside a caption"): "5.2 Other Things\nTable 2. Counts",
    ("V-46", "prose"): "was seen by all of them to grow here\nand also in the other places we saw",
    ("V-46", "one line alone"): "was seen by all of them to grow here",
    ("", "prose between cells"): "a   b   c\nwas seen by all of them to grow here\na   b   c\nand also in the other places we saw\na   b   c\nx y",
    ("", "caption and footnote"): "Fig. 3. A caption that runs on for\nanother line here.\n4 See https://example.org/a",
    ("V-46", "prose after a caption's end"): "Fig. 3. A caption.\nwas seen by all of them to grow here\nand also in the other places we saw",
    ("V-46", "prose after a blank line"): "Fig. 3. A caption that runs on\n\nwas seen by all of them to grow here\nand also in the other places we saw",
    ("", "capitals run on"): "TABLE II. THE COUNTS OF ALL\nTHE THINGS WE SAW HERE. T WO\nMORE LINES OF IT COME",
    ("V-46", "the case changes"): "TABLE II. THE COUNTS OF ALL\nwas seen by all of them to grow here\nand also in the other places we saw",
    ("", "five lines more"): "Fig. 3. A caption\n" + "\n".join(["that runs on and on it goes"] * 5),
    ("V-46", "seven lines more"): "Fig. 3. A caption\n" + "\n".join(["that runs on and on it goes"] * 7),
    ("V-46", "prose after a footnote's address"): "1 example.org/slang/slop\nwas seen by all of them to grow here\nand also in the other places we saw",
    ("", "numbers"): "P (fix)   18.4 20.9 20.0 22.3",
    ("", "panel"): "(a) Upward Trend with Slope Change",
}


def test_gaps(spark):
    rows, texts = [], []
    for (rule, why), body in {**{k: f"The rate of it\n{v}\nstayed the same." for k, v in GAPS.items()}, ("V-45", "rows"): "alpha   12   13   the rate\nmore of a row\nbeta   14   15   stayed the same."}.items():
        r = copy.deepcopy(RECORD)
        r["excluded"][0] |= {"quote": "the rate [...] beta 14 15 stayed the same." if rule == "V-45" else "The rate of it [...] stayed the same.", "page": 1}
        rows.append((f"{rule}: {why}", json.dumps(r)))
        texts.append((rows[-1][0], TEXT.replace("=== page 2", body + "\n=== page 2")))
    out = validate(spark.createDataFrame(rows, "paper_key string, raw string"), spark.createDataFrame(texts, "paper_key string, text string")).collect()
    got = {k: [] for k, _ in rows}
    for p in out:
        got[p.paper_key].append(p.rule)
    assert {k: v for k, v in got.items() if v != [x for x in [k.split(":")[0]] if x]} == {}


@pytest.fixture(scope="module")
def advice(spark):
    from claimloom.plans.advise import advise

    rows = []
    for rule, edit in {"valid": lambda r: None, **ADVISORIES}.items():
        r = copy.deepcopy(RECORD)
        edit(r)
        rows.append((rule, json.dumps(r)))
    headed = {"We collected": "4.2 Data Collection\nWe collected", "from 48 projects. ": "from 48 projects.\n5.1 Build Times\n", "Abstract.": "alpha  12  13  14\nAbstract."}
    text = {k: TEXT.replace("Abstract.", "Remote Build Caching\nAbstract.") for k, _ in rows}
    for k in ("A-02", "A-03", "A-07"):
        for a, b in headed.items():
            text[k] = text[k].replace(a, b)
    text["A-10"] = text["A-10"].replace("Abstract.", "It ran the build_time here.\nAbstract.")
    texts = list(text.items()) + [("A-04", TEXT.split("\n", 1)[1])]
    rows.append(("A-04", json.dumps(RECORD)))
    by = {k: {} for k, _ in rows}
    for p in advise(spark.createDataFrame(rows, "paper_key string, raw string"), spark.createDataFrame(texts, "paper_key string, text string")).collect():
        by[p.paper_key].setdefault(p.rule, []).append((p.label, p.message))
    return by


def test_no_advice(advice):
    assert advice["valid"] == {}


@pytest.mark.parametrize("rule", [*ADVISORIES, "A-04"])
def test_advice(advice, rule):
    assert rule in advice[rule], advice[rule]


def test_only_the_sentence_of_a_whole_hedges_it(spark):
    from claimloom.plans.advise import _sum_differs
    from pyspark.sql import functions as F

    said = {
        "the parts of 1,203: 700 and 503": False,
        "the parts of 1,203: 700 and 502": True,
        "the parts of 1,203, not all of them: 700 and 502": False,
        "Only some are here: parts of 1,203: 700 and 502. Then on": False,
        "Only some are here. The parts of 1,203: 700 and 502. Then on": True,
        "The parts of 10: 4 and 6. The parts of 1,203, only some: 700 and 2. Not all.": False,
        "The parts of 10, only some: 4 and 5. The parts of 1,203: 700 and 502.": True,
        "The parts of 10 are one: 4": False,
        "": False,
    }
    out = spark.createDataFrame([(k,) for k in said], "note string").select("note", _sum_differs(F.col("note")).alias("x")).collect()
    assert {r.note: r.x for r in out} == said


def test_record_model(spark):
    from claimloom.operators import record_model as G
    from claimloom.sources import records as R

    r = copy.deepcopy(RECORD)
    r["main_results"].append({**r["main_results"][0], "id": "R2", "source": "conclusion"})
    r["claims"][0]["serves"] = ["R1", "R2"]
    r["excluded"].append({**r["excluded"][1], "id": "E3", "duplicate_of": ["R2", "R1"]})
    e = R.entries(R.parse(spark.createDataFrame([("p", json.dumps(r))], "paper_key string, raw string")))
    assert {(x.group, x.result) for x in G.one_result(e).collect()} == {("R1", "R1"), ("R2", "R2")}
    assert {x.group: (x.stated_in, x.shared) for x in G.weights(e).collect()} == {"R1": (3, 1), "R2": (2, 1)}
    assert [x.id for x in G.by_weight(e).orderBy("place").collect()] == ["R1", "R2"]
    assert {x.claim: (x.group, x.others) for x in G.homes(e).collect()} == {"C1": ("R1", 1), "C2": ("R1", 0)}
    assert G.overview(e).first().stated_in == 4 and G.unsettled(e).count() == 0
    assert {(x.target, x.rel): list(x.sources) for x in G.reverse_edges(e).collect()}[("R1", "serves")] == ["C1", "C2"]
    assert R.schema()["properties"]["claims"]["items"]["required"] == sorted(R.FIELDS["claims"][0])


def test_markdown(spark):
    from claimloom.plans.render import markdown

    r = copy.deepcopy(RECORD)
    r["claims"][1]["note"] = "Table 4 gives 4.1%."
    r["paper"]["doi"] = "10.1145/1083142"
    df = spark.createDataFrame([("p", json.dumps(r)), ("q", json.dumps({**r, "main_results": [], "claims": [], "excluded": []}))], "paper_key string, raw string")
    out = {x.paper_key: x.markdown for x in markdown(df).collect()}
    lines = out["p"].split("\n")
    assert lines[0] == "# Claims: Remote Build Caching" and lines[2].endswith("1 main results, 2 claims, 2 excluded claim candidates.")
    assert "Paper `caching` (3 pages, `caching.pdf`, DOI [`10.1145/1083142`](https://doi.org/10.1145/1083142)): " in lines[2]
    assert [x for x in lines if x.startswith("#")] == [
        "# Claims: Remote Build Caching", "## Main results", "### R1: abstract, page 1", "## Claims",
        "### R1 (abstract, stated in 2 places): " + r["main_results"][0]["quote"], "### Every claim", "#### C1: page 2, 5.1", "#### C2: page 2, 5.1",
        "## Excluded claim candidates", "### E1: page 2, 4.2", "### E2: page 2-3, 6",
    ]
    assert "- C1, page 2, 1 of 2 for this result" in lines and "- Split from S1, with C2" in lines and "- Repeats: R1, C1" in lines and "- Note: Table 4 gives 4.1%." in lines
    assert "None recorded." in out["q"] and "None selected." in out["q"] and "### Every claim" not in out["q"]


def test_stance(spark):
    from claimloom.functions import stance as S
    from pyspark.sql import functions as F

    said = {
        "R2 would still stand, because it rests on the other data.": ["R2"],
        "R3, R5, and R7 would both still stand without it.": ["R3", "R5", "R7"],
        "R3 and R5 would still stand: this changed nothing.": ["R3", "R5"],
        "No main result would still stand.": [],
        "It is unclear whether R1 would still stand.": [],
        "R1 does not need this sentence and would still stand": [],
        "R1 stands only under that reading.": [],
        "Repeats R4, and R2 would still stand.": ["R2"],
    }
    df = spark.createDataFrame([(k,) for k in said], "reason string")
    out = {r.reason: list(r.x) for r in df.select("reason", S.left_standing(F.col("reason")).alias("x")).collect()}
    assert out == said
    assert df.where(S.still_stands(F.col("reason"))).count() == 5


def test_candidates(spark):
    from claimloom.operators import record_model as G
    from claimloom.sources import records as R

    r = copy.deepcopy(RECORD)
    r["excluded"][0]["reason"] = "R1 would still stand."
    e = R.entries(R.parse(spark.createDataFrame([("p", json.dumps(r))], "paper_key string, raw string")))
    assert {x.id: (x.bucket, list(x.weighed)) for x in G.candidates(e).collect()} == {"E1": ("standing", ["R1"]), "E2": ("repeat", ["C1", "R1"])}
    assert {x.result: list(x.candidates) for x in G.considered(e).collect()} == {"R1": ["E1", "E2"]}
    assert G.matching(e, "BUILD TIME").count() == 4 and G.matching(e, with_note=True).count() == 0
    assert {x.id for x in G.related(e, "R1").collect()} == {"C1", "C2"}
