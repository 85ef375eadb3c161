"""Token ids of whole texts by a lower-casing word-level BPE file of the tokenizers library.

Such a tokenizer normalises, cuts a text into words and merges within each word alone, so a text's ids
are its words' ids in order. The library encodes each distinct word once (bounded memo); texts
for which this cutting is not certain to agree go to the library whole: those outside common Latin
letters and punctuation, and those that hold a special token's string.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .pretoken import Pretokenizer

#: Characters up to U+024F are composed already and lower-cased one by one; so is this punctuation.
#: The separators from U+001C are white space to str.split alone.
OUTSIDE = re.compile("[^\u0000-\u001b\u0020-\u024f\u2010-\u2027\u20ac]")


def words_of_32_bits(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Memo:
    """Answers by string in two generations of at most `limit`: a full one grows old, an old answer
    that is used again comes back, the rest goes. make(strings) answers several new ones."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int):
        self.make, self.limit = make, limit
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all(self, strings: list[str]) -> list[bytes]:
        found = [*map(self.now.get, strings)]
        if None in found:
            holes = [i for i, x in enumerate(found) if x is None]
            missing = {strings[i] for i in holes}
            if len(self.now) >= self.limit:
                self.old, self.now = self.now, {}
            new = []
            for s in missing:
                if (x := self.old.get(s)) is None:
                    new.append(s)
                else:
                    self.now[s] = x
            self.now.update(zip(new, self.make(new), strict=True))
            for i in holes:
                found[i] = self.now[strings[i]]
        return found


class WordIds:
    def __init__(self, path: str, memo_limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pretokenizer = Pretokenizer(space_prefix=False, digits_alone=True)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, np.bool_)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Memo(self._encode, memo_limit)
        self.chunks = Memo(self._join, memo_limit)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Many words in one call, a blank apart: a word's last token carries the end mark."""
        out: list[bytes] = []
        lists = [words[i : i + 256] for i in range(0, len(words), 256)]
        for mine, made in zip(lists, self.library.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
            if len(ends) != len(mine):
                out += [words_of_32_bits(self.library.encode(w, add_special_tokens=False).ids) for w in mine]
                continue
            data, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(data[at:end])
                at = end
        return out

    def _join(self, chunks: list[str]) -> list[bytes]:
        words, n = self.pretokenizer.split(chunks)
        found, out, at = self.words.all(words), [], 0
        for k in n.tolist():
            out.append(found[at] if k == 1 else b"".join(found[at : at + k]))
            at += k
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit words. White space always parts words, so the
        ids of what stands between white space are kept by that whole chunk."""
        chunks: list[str] = []
        n = []
        for text in texts:
            if OUTSIDE.search(text) or any(s in text for s in self.special):
                n.append(-1)
            else:
                mine = text.lower().split()
                n.append(len(mine))
                chunks += mine
        found, out, at = self.chunks.all(chunks), [], 0
        for text, k in zip(texts, n, strict=True):
            if k < 0:
                out.append(words_of_32_bits(self.library.encode(text, add_special_tokens=False).ids))
            else:
                out.append(b"".join(found[at : at + k]))
                at += k
        return out


@lru_cache(maxsize=2)
def word_ids(path: str, memo_limit: int) -> WordIds:
    return WordIds(path, memo_limit)
