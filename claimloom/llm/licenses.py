"""License scans with a positional index of rare licence words.

Templates are licence notices with a label and phrases that must stand in the text for the label to be
given. Word rarity (IDF) over the licence vocabulary is counted over all documents; every word of every
template is indexed with its positions. In a file the licence words it has are looked up, those of highest
IDF first, until each template that its words allow has been asked for by enough of them. Each occurrence
votes for a template at a relative position; where two or more words agree within a small slack, the
template's key phrases are verified around that place. Places of the base phrases are counted beside that and
label on their own.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_texts

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, phrases that must stand there (bars part alternatives).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license see the license file", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0|apache license 2 0|apache 2 0 license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3|gnu general public license v3|gnu gpl version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2|gnu general public license v2|gnu gpl version 2"]),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license|gnu library general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd-3-clause", "redistributions in binary form must reproduce the above copyright notice neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["redistributions in binary form must reproduce", "endorse or promote products"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd license", ["bsd license|3 clause bsd|2 clause bsd"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0|mozilla public license version 2 0|mozilla public license 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0|eclipse public license v2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented", ["permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["free of charge to any person or organization", "accompanying documentation covered by this license"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document", ["do what the fuck you want to public license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["agreed to in writing software distributed under the license is distributed on an as is basis"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["this permission notice shall be included in all copies or substantial portions of the software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0|creative commons zero"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0|creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0|creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0|creative commons attribution noncommercial 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0|creative commons attribution noderivatives 4 0"]),
]
#: Words by which a file asks for a template; how far votes may differ; words around a place to verify in.
ASKING, SLACK, AROUND = 8, 3, 4
PARTING = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters in lower case, digits, and all characters beyond ASCII."""
    return (text or "").encode().lower().translate(PARTING).split()


VOCABULARY = {w.encode() for _, notice, _ in TEMPLATES for w in notice.split()}


@dataclass(frozen=True)
class Template:
    label: str
    words: list[bytes]
    phrases: list[list[list[bytes]]]


@dataclass
class Index:
    templates: list[Template]
    idf: dict[bytes, float]
    postings: dict[bytes, dict[int, list[int]]]  # word: positions by template
    starts: dict[bytes, list[tuple[list[bytes], str]]]  # base phrases by first word

    @classmethod
    def build(cls, frequency: dict[bytes, int], documents: int) -> Index:
        """frequency: in how many documents each licence word occurs."""
        templates, postings = [], defaultdict(lambda: defaultdict(list))
        for n, (label, notice, phrases) in enumerate(TEMPLATES):
            words = [w.encode() for w in notice.split()]
            templates.append(Template(label, words, [[[w.encode() for w in a.split()] for a in p.split("|")] for p in phrases]))
            for i, w in enumerate(words):
                postings[w][n].append(i)
        starts = defaultdict(list)
        for phrase, label in BASE.items():
            p = [w.encode() for w in phrase.split()]
            starts[p[0]].append((p, label))
        return cls(templates, {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for w in postings}, {w: dict(x) for w, x in postings.items()}, dict(starts))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
        words = words_of(text)
        held = set(words)
        # Templates whose key phrases' words the file has at all.
        open_ = {n for n, t in enumerate(self.templates) if all(any(held.issuperset(p) for p in options) for options in t.phrases)}
        looked = self.starts.keys() & held
        asked: dict[bytes, list[int]] = {}
        if open_:
            count = dict.fromkeys(open_, 0)
            for w in sorted(self.postings.keys() & held, key=lambda w: (-self.idf[w], w)):
                if asks := [n for n in self.postings[w] if count.get(n, ASKING) < ASKING]:
                    asked[w] = asks
                    for n in asks:
                        count[n] += 1
        if not looked and not asked:
            return len(words), 0, None, None, "", "", 0.0
        starts, base = [], set()
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in looked:
                for phrase, label in self.starts[w]:
                    if words[i : i + len(phrase)] == phrase:
                        starts.append(i)
                        base.add(label)
            if w in asked:
                for n in asked[w]:
                    votes[n] += [(i - at, w) for at in self.postings[w][n]]
        labels, score = set(base), 1.0 if base else 0.0
        for n, cast in votes.items():
            t = self.templates[n]
            if t.label in labels and score == 1.0:
                continue
            if (found := self._place(t, cast, words)) is not None:
                labels.add(t.label)
                score = max(score, found)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    @staticmethod
    def _place(t: Template, cast: list[tuple[int, bytes]], words: list[bytes]) -> float | None:
        """Best share of the template's words that stand at a place where its phrases do, else None."""
        cast.sort()
        best, low, done = None, 0, -(1 << 60)
        for high, (shift, _) in enumerate(cast):
            while cast[low][0] < shift - SLACK:
                low += 1
            if cast[low][0] <= done or len({w for _, w in cast[low : high + 1]}) < 2:
                continue
            a = max(0, cast[low][0] - AROUND)
            window = words[a : max(0, shift) + len(t.words) + AROUND]
            line = b" " + b" ".join(window) + b" "
            if all(any(b" " + b" ".join(p) + b" " in line for p in options) for options in t.phrases):
                best = max(best or 0.0, len(set(t.words).intersection(window)) / len(set(t.words)))
                done = cast[low][0]
        return best


def fit(docs: DataFrame, text: str = "text") -> Index:
    """Count over all documents in how many each licence word occurs; only those counts, one for each
    of the templates' words, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n[b""] += 1
                for w in VOCABULARY.intersection(words_of(t)):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    frequency = dict(zip(counted.column("word").to_pylist(), counted.column("n").to_pylist(), strict=True))
    return Index.build(frequency, frequency.pop(b"", 0))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Labels are distinct, sorted and comma-joined; score is 1 if a base phrase stands, else the largest
    share of a verified template's words that stand at its place. Null and empty texts have no words and
    no labels. Rows with null or repeated keys each keep their row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index or fit(docs, text))

    def make():
        look = shared.value.scan
        return lambda texts: [look(t) for t in texts]

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, [key], text, make, fields)
