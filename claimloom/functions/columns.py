"""Line numbers and columns of one paper's pages. Both are sequential over a page's character grid, so they
are plain functions; operators.layout runs them paper by paper."""

from __future__ import annotations

import re
from collections import Counter

MARGIN_NUMBER = re.compile(r"^\s*(\d{1,4})(?=\s{2}|\s*$)")
CAPTION = re.compile(r"^(?:Fig\.|Figure|FIGURE|Table|TABLE)\s*(?:[IVXLC]+|\d+)\b")
STEPS, LEAST, REACH, SPAN = (1, 5, 10), 6, 40, 0.4
LEFT, RIGHT, BAND, CROSSING, LENIENT = 0.30, 0.72, 3, 0.03, 0.20


def chain(hits: list[tuple[int, int]], step: int) -> list[int]:
    """Lines of the longest run of (line, number) in which each number is the last one plus step, no
    more than REACH lines on."""
    best: dict[int, list[int]] = {}
    longest: list[int] = []
    for at, n in hits:
        before = best.get(n - step, [])
        mine = [*before, at] if before and 0 < at - before[-1] <= REACH else [at]
        if len(mine) >= len(best.get(n, [])) or at - best[n][-1] > REACH:
            best[n] = mine
        if len(mine) > len(longest):
            longest = mine
    return longest


def without_line_numbers(pages: list[list[str]]) -> list[list[str]]:
    """Pages without numbers that count up along the left margin over much of the paper or of a page."""
    flat = [(p, i, m) for p, page in enumerate(pages) for i, line in enumerate(page) if (m := MARGIN_NUMBER.match(line))]
    offset = [sum(map(len, pages[:p])) for p in range(len(pages))]
    out = [list(page) for page in pages]
    scopes = [(sum(map(len, pages)), flat)] + [(len(page), [x for x in flat if x[0] == p]) for p, page in enumerate(pages)]
    for size, found in scopes:
        hits = [(offset[p] + i, int(m[1])) for p, i, m in found]
        where = {offset[p] + i: (p, i, m) for p, i, m in found}
        run = max((chain(hits, s) for s in STEPS), key=len)
        if len(run) < LEAST or run[-1] - run[0] < SPAN * size:
            continue
        rows = [pages[where[k][0]][where[k][1]] for k in run]
        if sum(len(re.findall(r"\S\s{3,}(?=\S)", r)) > 1 for r in rows) * 2 > len(rows):
            continue  # rows of a table
        for k in run:
            p, i, m = where[k]
            out[p][i] = " " * m.end() + pages[p][i][m.end() :] if pages[p][i][m.end() :].strip() else ""
    return out


def _blank(line: str, a: int, b: int) -> bool:
    return not line[a:b].strip()


def gutter(lines: list[str], crossing: float = CROSSING) -> tuple[int, int] | None:
    """The widest band of blank columns near the middle that no more than a share of the lines cross, with
    text on both sides; None if there is none."""
    rows = [x for x in lines if x.strip()]
    width = max(map(len, rows), default=0)
    if len(rows) < 6 or width < 40:
        return None
    low, high = int(LEFT * width), int(RIGHT * width)
    free = [sum(not _blank(x, c, c + 1) for x in rows) <= crossing * len(rows) for c in range(low, high)]
    best, start = (0, 0), None
    for c, ok in enumerate([*free, False]):
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            best, start = max(best, (c - start, start)), None
    size, at = best
    if size < BAND:
        return None
    a, b = low + at, low + at + size
    left, right = (sum(bool(part.strip()) for part in side) for side in ([x[:a] for x in rows], [x[b:] for x in rows]))
    return (a, b) if min(left, right) >= max(3, 0.3 * len(rows)) else None


def reading_order(pages: list[list[str]]) -> tuple[list[list[str]], list[bool]]:
    """Pages with their columns one after the other, and which pages have two. Lines across the gutter part
    a page into regions that are read one by one; a page without a clear gutter takes the paper's
    most common one (ties to the first) if few of its lines cross it."""
    own = [gutter(page) for page in pages]
    votes = Counter((a + b) // 2 for a, b in filter(None, own))
    common = votes.most_common(1)[0][0] if votes else None
    out, two = [], []
    for page, band in zip(pages, own, strict=True):
        middle = (band[0] + band[1]) // 2 if band else common
        rows = [x for x in page if x.strip()]
        crosses = lambda x, c: not _blank(x, c - 1, c + 2)
        if middle is None or (band is None and sum(crosses(x, middle) for x in rows) > LENIENT * len(rows)) or not any(x[middle:].strip() for x in rows):
            out.append(list(page))
            two.append(False)
            continue
        made: list[str] = []
        left: list[str] = []
        right: list[str] = []

        def flush(made=made, left=left, right=right) -> None:
            indent = min((len(x) - len(x.lstrip()) for x in right if x.strip()), default=0)
            made += [x.rstrip() for x in left]
            made += [x[indent:].rstrip() for x in right] if any(x.strip() for x in right) else []
            left.clear()
            right.clear()

        for line in page:
            if line.strip() and crosses(line, middle):
                flush()
                made.append(line)
            else:
                left.append(line[:middle])
                right.append(line[middle:])
        flush()
        out.append(made)
        two.append(True)
    return out, two
