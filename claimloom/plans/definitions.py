"""The definitions document: Markdown to a page of the site.

Headings, paragraphs, lists, tables, fences, block quotes, and code, strong, emphasis and links within
lines; comments go, and anything else is printed as it is written.
"""

from __future__ import annotations

import hashlib
import html
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import unmarked

FENCE = re.compile(r"^```[^\n]*\n(.*?)(?:^```[^\n]*$|\Z)", re.M | re.S)
SPAN = re.compile(r"`(?P<code>[^`]+)`|\*\*(?P<strong>[^*]+)\*\*|(?<![*\w])\*(?P<em>[^*]+)\*(?![*\w])|(?<!!)\[(?P<text>[^\]]+)\]\((?P<to>[^)]+)\)")
#: Kinds of lines, by the first pattern that fits; what fits none is prose.
LINES = {"blank": r"\s*$", "heading": r"#{1,6} ", "row": r"\|", "item": r"\s*(?:[-*]|\d+\.) ", "quote": r"> "}
REACHABLE = re.compile(r"(?i)(?:https?:|mailto:|[./#?]|[^:]*$)")


def anchor(title: str) -> str:
    """A heading's name in links: unmarked lower-case letters and digits, or where there are none, a digest."""
    return re.sub(r"[^a-z0-9]+", "-", unmarked(title).lower()).strip("-") or "h-" + hashlib.sha256(title.encode("utf-8", "replace")).hexdigest()[:8]


def distinct_anchors(titles: list[str]) -> list[str]:
    """Anchors in order; one that is taken gets the first number from 2 that makes it free."""
    taken: set[str] = set()
    for name in map(anchor, titles):
        n, free = 2, name
        while free in taken:
            n, free = n + 1, f"{name}-{n}"
        taken.add(free)
        yield free


@F.pandas_udf(T.ArrayType(T.StringType()))
def anchors(titles: pd.Series) -> pd.Series:
    """distinct_anchors of each array of headings; null stays null."""
    return titles.map(lambda t: None if t is None else list(distinct_anchors(t)))


def inline(text: str) -> str:
    def made(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "to":
            to = m["to"].strip()
            return f'<a href="{html.escape(to) if REACHABLE.match(to) else "#"}">{inline(m["text"])}</a>'
        return f"<{kind}>{html.escape(m[kind]) if kind == 'code' else inline(m[kind])}</{kind}>"

    out, at = [], 0
    for m in SPAN.finditer(text):
        out += [html.escape(text[at : m.start()]), made(m)]
        at = m.end()
    return "".join(out) + html.escape(text[at:])


def _list(lines: list[str]) -> str:
    """Items in lists, one inside another as they are indented; a list's kind is its first item's."""
    out: list[str] = []
    held: list[tuple[int, str]] = []  # indent and kind of the lists that are open
    for line in lines:
        indent, mark, text = re.match(r"(\s*)([-*]|\d+\.) (.*)", line).groups()
        depth = len(indent)
        while len(held) > 1 and depth < held[-1][0]:
            out.append(f"</li></{held.pop()[1]}>")
        if held and depth <= held[-1][0]:
            out.append("</li>")
        else:
            ordered = mark not in "-*"
            held.append((depth, "ol" if ordered else "ul"))
            out.append(f"<{held[-1][1]}{f' start={chr(34)}{mark[:-1]}{chr(34)}' if ordered and mark != '1.' else ''}>")
        out.append("<li>" + inline(text))
    return "".join(out) + "".join(f"</li></{kind}>" for _, kind in reversed(held))


def _table(lines: list[str]) -> str:
    cells = [[c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))] for x in lines]
    row = lambda tag, r: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in r) + "</tr>"
    return f"<table><thead>{row('th', cells[0])}</thead><tbody>{''.join(row('td', r) for r in cells[2:])}</tbody></table>"


def page_body(markdown: str) -> str:
    parts = FENCE.split(re.sub(r"<!--.*?-->", "", markdown, flags=re.S))  # odd ones stood in fences
    kind = lambda x: next((k for k, pattern in LINES.items() if re.match(pattern, x)), "prose")
    blocks = [("code", [x]) if i % 2 else (k, list(run)) for i, x in enumerate(parts) for k, run in ([("code", [x])] if i % 2 else groupby(x.splitlines(), kind))]
    names = distinct_anchors([x.lstrip("#").strip() for k, run in blocks if k == "heading" for x in run])
    out = []
    for k, run in blocks:
        if k == "code":
            out.append(f"<pre><code>{html.escape(run[0].removesuffix(chr(10)))}</code></pre>")
        elif k == "heading":
            for x in run:
                level, title = len(x) - len(x.lstrip("#")), x.lstrip("#").strip()
                out.append(f'<h{level} id="{next(names)}">{inline(title)}</h{level}>')
        elif k == "row" and len(run) > 1 and all(re.fullmatch(r"\s*:?-+:?\s*", c) for c in run[1].strip().removeprefix("|").removesuffix("|").split("|")):
            out.append(_table(run))
        elif k == "item":
            out.append(_list(run))
        elif k == "quote":
            out.append(f"<blockquote>{inline(' '.join(x[2:] for x in run))}</blockquote>")
        elif k != "blank":
            out.append(f"<p>{inline(' '.join(run))}</p>")
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def definitions(markdown: pd.Series) -> pd.Series:
    """The HTML of Markdown documents; null stays null."""
    return markdown.map(lambda t: None if t is None else page_body(t.removeprefix("﻿")))
