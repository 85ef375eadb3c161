"""The definitions page, block by block."""

import pytest

from claimloom.plans.definitions import definitions, distinct_anchors, page_body

BLOCKS = {
    "": "",
    "a <b>\nc": "<p>a &lt;b&gt; c</p>",
    "a\n\nb": "<p>a</p>\n<p>b</p>",
    "a <!-- x\ny --> b": "<p>a  b</p>",
    "## A & *b*": '<h2 id="a-b">A &amp; <em>b</em></h2>',
    "####### no": "<p>####### no</p>",
    "#tag": "<p>#tag</p>",
    "`a*b*` **c** 2*3*4": "<p><code>a*b*</code> <strong>c</strong> 2*3*4</p>",
    "[a](https://x/?a&b) [b](javascript:x) ![c](d)": '<p><a href="https://x/?a&amp;b">a</a> <a href="#">b</a> ![c](d)</p>',
    "> a\n> b": "<blockquote>a b</blockquote>",
    "```\n# a < b\n\n```\nc": "<pre><code># a &lt; b\n</code></pre>\n<p>c</p>",
    "```\nopen": "<pre><code>open</code></pre>",
    "- a\n  - b\n  - c\n- d": "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>",
    "3. a\n4. b": '<ol start="3"><li>a</li><li>b</li></ol>',
    "| a | b\\|c |\n|---|:-:|\n| 1 | 2 |": "<table><thead><tr><th>a</th><th>b|c</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>",
    "| stray": "<p>| stray</p>",
}


@pytest.mark.parametrize("markdown", BLOCKS)
def test_blocks(markdown):
    assert page_body(markdown) == BLOCKS[markdown]


def test_anchors():
    made = list(distinct_anchors(["The Chain", "the chain!", "Äpfel ﬁn", "The Chain 2", "«»", "x", "x 2", "x"]))
    assert made[:4] == ["the-chain", "the-chain-2", "apfel-fin", "the-chain-2-2"] and made[4].startswith("h-") and len(made[4]) == 10 and made[5:] == ["x", "x-2", "x-3"]


def test_over_a_column(spark):
    rows = spark.createDataFrame([("# a",), (None,), ("",)], "m string").select(definitions("m").alias("h")).collect()
    assert sorted(str(r.h) for r in rows) == ["", '<h1 id="a">a</h1>', "None"]
