"""Best-two-fit packing of documents into sequences of a fixed length.

Only documents longer than a sequence are cut. A sequence is filled greedily with the longest piece
that still fits; then its smallest piece is put back as long as two other unpacked pieces fill the
gap that it leaves more tightly. Pieces are dealt at random to groups of bounded size that pack
alone, so no task sees more than a group and at most the last sequences of each group stay loose.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, id_type
from .word_ids import word_ids

#: Pieces in a packing group, about.
GROUP = 8192


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions in lengths; every length is from 1 to size."""
    unpacked: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        unpacked.setdefault(lengths[i], []).append(i)
    present = sum(1 << n for n in unpacked)  # bit n: a piece of length n is unpacked

    def longest(most: int) -> int:
        """Length of the longest unpacked piece of at most this length; 0 if none."""
        return max(0, (present & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def take(n: int) -> tuple[int, int]:
        nonlocal present
        i = unpacked[n].pop()
        if not unpacked[n]:
            present &= ~(1 << n)
        return n, i

    def two_for(room: int, above: int) -> tuple[int, int] | None:
        """The two unpacked lengths with the largest sum over `above` and up to `room`."""
        best, pair = above, None
        a = longest(room - 1)
        while a and 2 * a > best:  # the longer of the two
            b = longest(min(a, room - a))
            if b == a and len(unpacked[a]) < 2:
                b = longest(b - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = longest(a - 1)
        return pair

    bins = []
    while present:
        held, gap = [], size
        while n := longest(gap):
            held.append(take(n))
            gap -= n
        while gap and held:
            small, i = held[-1]
            if not (pair := two_for(gap + small, small)):
                break
            held.pop()
            held += [take(n) for n in pair]
            held.sort(reverse=True)
            unpacked.setdefault(small, []).append(i)
            present |= 1 << small
            gap += small - sum(pair)
        bins.append([i for _, i in held])
    return bins


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, key: str = "doc_id", text: str = "text", memo: int = 400_000, batch_chars: int = 2_000_000) -> DataFrame:
    """Key, piece, start, length and ids_crc32 of every document's pieces of up to `size` ids. A
    document's ids are its text's, then end_id; null and empty texts have end_id alone."""
    schema = T.StructType([T.StructField(key, id_type(docs, key)), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, memo)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            owner, number, start, length, crc = [], [], [], [], []
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= batch_chars):
                    chars += len(texts[to] or "")
                    to += 1
                for i, data in enumerate(words.encode([t or "" for t in texts[at:to]]), at):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * size)):
                        part = data[a : a + 4 * size]
                        owner.append(i)
                        number.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                at = to
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.fieldNames())

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", group: int = GROUP, memo: int = 400_000, batch_chars: int = 2_000_000) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there.

    Offsets of a sequence have no gaps and start at 0. Null texts count as empty (end_id alone); null
    and repeated keys keep a row each; other columns are not read; an empty table packs to none.
    The piece table, a few numbers a document, is checkpointed: it is both counted and dealt.
    memo: words and chunks that a worker keeps the ids of, twice (about 200 bytes each); batch_chars: how
    much text it cuts at a time.
    """
    made = cut(pieces(docs, tokenizer, size, end_id, key, text, memo, batch_chars))
    groups = max(1, -(-made.count() // group))
    schema = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(g: tuple, t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, held in enumerate(best_two_fit(lengths, size)):
            at = 0
            for i in held:
                sequence[i], offset[i] = (g[0].as_py() << 32) + k, at
                at += lengths[i]
        return t.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # Row numbers of the checkpoint's own files: the same again after a lost executor, and spread even
    # if one key repeats.
    dealt = made.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, schema)
