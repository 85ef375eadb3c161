"""Token counts of whole texts by compiled finite-state tokenizers.

Two deterministic machines in sequence. The pre-token automaton reads characters; chunks of text are
maps from entry to exit state, composed by a parallel prefix scan (pretoken.py), so one long text is
cut into pre-tokens as fast as many short ones. The merge transducer reads each pre-token's bytes; its
arcs carry the number of tokens they emit (bpe_fst.py). A text's count is a difference of prefix
sums over the pre-tokens' counts. Nothing is shuffled: one row in, one row out, memory bounded by the
group of texts in hand and the fixed memo sizes.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_fst import Merges, PieceMemo, Transducer
from .pretoken import Pretokenizer
from .shared import map_texts

COUNT_FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


class TokenCounter:
    """Counts as the tokenizers library gives them for a byte-level BPE file: strings of the file's
    added tokens count one token each wherever they stand and cut the text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or file["normalizer"] or file["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE files are compiled")
        self.special = [t["content"] for t in file["added_tokens"]]
        self.pretokenizer = Pretokenizer(space_prefix=True, digits_alone=False)
        machine = Transducer(Merges.from_json(path))
        self.memo = PieceMemo(machine.count)

    def counts(self, texts: list[str]) -> np.ndarray:
        segments, owner, extra = texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
        if any(s in t for s in self.special for t in texts):
            segments, owners = [], []
            for i, text in enumerate(texts):
                parts = [text]
                for s in self.special:
                    cut = [p.split(s) for p in parts]
                    parts = [p for c in cut for p in c]
                    extra[i] += sum(len(c) - 1 for c in cut)
                segments += parts
                owners += [i] * len(parts)
            owner = np.array(owners)
        pieces, n = self.pretokenizer.split(segments)
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces)))])
        ends = np.cumsum(n)
        return extra + np.bincount(owner, weights=sums[ends] - sums[ends - n], minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens. Rows with null or repeated keys each keep their
    row. Other columns of docs are not read. An empty table gives an empty result.
    """

    def make():
        count = counter(tokenizer)

        def work(texts):
            texts = [t or "" for t in texts]
            n = count.counts(texts).tolist()
            return [(len(t.encode()), k, k > limit) for t, k in zip(texts, n, strict=True)]

        return work

    return map_texts(docs, [key], text, make, COUNT_FIELDS)
