"""Rows that operators must stand: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, class long"


def words(r, n, stock="the of and to in erith onda thal wher mion sant bel".split()):
    return " ".join(r.choice(stock) + r.choice(["", "", "s", "er"]) for _ in range(n))


def make_docs():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing columns."""
    r = random.Random(5)
    base = words(r, 120)
    edited = base.split()
    edited[60] = "changed"
    fr = "le la des é è que une pour dans avec sur pas".split()
    rows = [(i, words(r, r.randint(60, 200), None or fr if i % 3 == 0 else "the of and to in erith onda thal wher mion".split()) + ".\n" + words(r, 30), "fr" if i % 3 == 0 else "en", "src0", 1, 0.5, True, 7) for i in range(40)]
    rows += [(40, base, "en", "src0", 1, None, None, None), (41, base, "en", None, None, 1.0, False, 1), (42, " ".join(edited), "en", "src1", 1, 0.0, True, 2), (43, base.upper(), None, "src1", 1, 0.0, True, 2)]
    rows += [(44, None, "en", "src0", 0, 0.1, True, 3), (45, "", "en", "src0", 0, 0.1, True, 3), (46, " \n\t ", None, None, None, None, None, None), (47, "12 34 !!", "en", "src0", 0, 0.1, True, 3)]
    rows += [(48, words(r, 30_000), "en", "src0", 0, 0.1, True, 3), (None, "a text without an id " * 20, "en", "src0", 1, 0.1, True, 3), (49, "one two", "en", "s", 1, 0.2, True, 1), (50, "one  TWO", "en", "s", 1, 0.2, True, 1)]
    rows += [(51, "same row " * 30, "en", "s", 1, 0.2, True, 1)] * 3
    rows += [(52, "Licensed under CC BY-NC 4.0. All rights reserved.\nGNU General Public License, version 3. <|endoftext|> é日本 " * 3, "en", "s", 1, 0.2, True, 1)]
    return rows
