"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding: pre-tokens by the automaton of pretoken.py, each through the transducer of bpe_fst.py.
Decoding: token bytes pass through an incremental UTF-8 state machine, so text can be handed on in
pieces whose ends fall inside a character. Nothing is shuffled; memory is bounded by the group of texts
in hand and fixed memo sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_fst import Merges, PieceMemo, Transducer
from .pretoken import Pretokenizer
from .shared import map_texts


class Utf8Machine:
    """Incremental UTF-8 decoding. feed() returns the text complete so far, with U+FFFD for
    malformed parts; the machine keeps the bytes of an unfinished character. finish() ends the stream.

    States count the continuation bytes still due, split by what the next byte may be.
    """

    START, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BAD = range(9)

    def __init__(self):
        self.kept = b""

    @staticmethod
    @lru_cache(maxsize=1)
    def table() -> list[list[int]]:
        m = Utf8Machine
        rows = [[m.BAD] * 256 for _ in range(9)]

        def put(state: int, low: int, high: int, to: int) -> None:
            rows[state][low : high + 1] = [to] * (high + 1 - low)

        put(m.START, 0x00, 0x7F, m.START)
        put(m.START, 0xC2, 0xDF, m.ONE)
        put(m.START, 0xE0, 0xEF, m.TWO)
        put(m.START, 0xF0, 0xF4, m.THREE)
        for lead, to in ((0xE0, m.AFTER_E0), (0xED, m.AFTER_ED), (0xF0, m.AFTER_F0), (0xF4, m.AFTER_F4)):
            rows[m.START][lead] = to
        for state, low, high, to in ((m.ONE, 0x80, 0xBF, m.START), (m.TWO, 0x80, 0xBF, m.ONE), (m.THREE, 0x80, 0xBF, m.TWO), (m.AFTER_E0, 0xA0, 0xBF, m.ONE), (m.AFTER_ED, 0x80, 0x9F, m.ONE), (m.AFTER_F0, 0x90, 0xBF, m.TWO), (m.AFTER_F4, 0x80, 0x8F, m.TWO)):
            put(state, low, high, to)
        return rows

    def feed(self, data: bytes) -> str:
        data = self.kept + data
        # Only the last lead byte within three bytes of the end can be unfinished.
        rows, end = self.table(), len(data)
        for back in range(1, min(4, end + 1)):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                state = self.START
                for b in data[len(data) - back :]:
                    state = rows[state][b]
                    if state == self.BAD:
                        break
                if state not in (self.START, self.BAD):
                    end -= back
                break
        self.kept = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.kept = self.kept.decode("utf-8", "replace"), b""
        return out


class ByteBpe:
    """encode(texts): the ids of each. token_bytes(ids), decode(ids), decode_stream(chunks): back."""

    def __init__(self, ranks: str):
        merges = Merges.from_ranks(ranks)
        self.pretokenizer = Pretokenizer(space_prefix=True, digits_alone=False)
        self.machine = Transducer(merges)
        self.vocabulary = [b""] * (max(merges.ids.values()) + 1)
        for token, i in merges.ids.items():
            self.vocabulary[i] = token
        self.decimal = [str(i) for i in range(len(self.vocabulary))]
        self.memo = PieceMemo(self.machine.run)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        pieces, n = self.pretokenizer.split(texts)
        at, memo = 0, self.memo
        for k in n.tolist():
            ids: list[int] = []
            for found in map(memo.__getitem__, pieces[at : at + k]):
                ids += found
            at += k
            yield ids

    def token_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        machine = Utf8Machine()
        for chunk in chunks:
            yield machine.feed(self.token_bytes(chunk))
        yield machine.finish()

    def decode(self, ids: list[int], chunk: int = 65_536) -> str:
        return "".join(self.decode_stream(ids[i : i + chunk] for i in range(0, len(ids), chunk)))


@lru_cache(maxsize=2)
def byte_bpe(ranks: str) -> ByteBpe:
    return ByteBpe(ranks)


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ids (array of int) of every row; null and empty texts give an empty array. Every row
    is kept, also with null or repeated keys; other columns are not read."""

    def make():
        bpe = byte_bpe(ranks)
        return lambda texts: [(ids,) for ids in bpe.encode([t or "" for t in texts])]

    return map_texts(docs, [key], text, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and text of every row of ids; null ids decode to null, unknown ids raise."""

    def make():
        bpe = byte_bpe(ranks)
        return lambda rows: [(None if r is None else bpe.decode(r),) for r in rows]

    return map_texts(encoded, [key], ids, make, [T.StructField("text", T.StringType())])


def round_trip(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids again, and return key, n_tokens, ids_sha256 (of the
    decimal ids joined by one blank) and decoded_sha256 (of the decoded UTF-8 bytes), lowercase hex.

    Ids stay inside the task that made them: only digests leave it. Nulls count as empty texts.
    """

    def make():
        bpe = byte_bpe(ranks)
        sha = lambda data: hashlib.sha256(data).hexdigest()

        def work(texts):
            out = []
            for ids in bpe.encode([t or "" for t in texts]):
                written = " ".join(map(bpe.decimal.__getitem__, ids))
                out.append((len(ids), sha(written.encode()), sha(bpe.decode(ids).encode())))
            return out

        return work

    return map_texts(docs, [key], text, make, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
