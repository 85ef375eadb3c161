"""Pre-token boundaries by a small deterministic automaton whose chunk maps compose by prefix scan.

Both tokenizer families here cut a text by one regular expression before any merge: contractions,
runs of letters, runs of digits (or single digits), runs of other characters, white space. With two
characters of lookahead folded into the input symbol that expression is a deterministic automaton of
eight states. A chunk of text is then a map from entry state to exit state; maps of neighbouring
chunks compose associatively, so the entry states of all chunks follow from one parallel prefix scan
and every chunk is then walked at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, TAKES1, TAKES2, SPACE_IN, SPACE_PREFIX, SPACE_LAST = range(8)
FIRST = 8  # added to the symbol of a text's first character
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_PREFIX, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
CHUNK, HEAD = 128, 12


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, SPACE_IN for white space, else OTHER."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_IN, r"\s+")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def _tables(space_prefix: bool, digits_alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a pre-token) by state and symbol."""
    nxt, new = np.zeros((8, 16), np.uint8), np.zeros((8, 16), np.bool_)
    fresh = {
        LETTER: IN_LETTERS, NUMBER: CLOSED if digits_alone else IN_NUMBERS, OTHER: IN_OTHER, TAKES1: ONE_MORE, TAKES2: TWO_MORE,
        SPACE_IN: IN_SPACE, SPACE_PREFIX: AFTER_PREFIX if space_prefix else IN_SPACE, SPACE_LAST: CLOSED if space_prefix else IN_SPACE,
    }
    goes_on = {(IN_LETTERS, LETTER): IN_LETTERS, (IN_SPACE, SPACE_IN): IN_SPACE}
    goes_on |= {(IN_OTHER, s): IN_OTHER for s in (OTHER, TAKES1, TAKES2)}
    goes_on |= {(ONE_MORE, s): CLOSED for s in range(8)} | {(TWO_MORE, s): ONE_MORE for s in range(8)}
    if not digits_alone:
        goes_on[IN_NUMBERS, NUMBER] = IN_NUMBERS
    if space_prefix:
        goes_on |= {(AFTER_PREFIX, LETTER): IN_LETTERS, (AFTER_PREFIX, NUMBER): IN_NUMBERS}
        goes_on |= {(AFTER_PREFIX, s): IN_OTHER for s in (OTHER, TAKES1, TAKES2)}
    else:
        goes_on |= {(IN_SPACE, SPACE_PREFIX): IN_SPACE, (IN_SPACE, SPACE_LAST): IN_SPACE}
    for state in range(8):
        for symbol in range(8):
            nxt[state, symbol] = goes_on.get((state, symbol), fresh[symbol])
            new[state, symbol] = (state, symbol) not in goes_on
            nxt[state, symbol + FIRST], new[state, symbol + FIRST] = fresh[symbol], True
    return nxt, new


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps (rows), by doubling strides."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


class Pretokenizer:
    """space_prefix: one blank joins the run after it and white space is kept as pre-tokens of its
    own; otherwise white space separates and is dropped. digits_alone: each digit is a pre-token."""

    def __init__(self, space_prefix: bool, digits_alone: bool):
        self.keeps_space = space_prefix
        self.next, self.new = _tables(space_prefix, digits_alone)
        self.classes = char_classes()

    def symbols(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Input symbols of joined texts; starts: where each text begins."""
        kind = self.classes[points]
        n = len(points)
        last = np.zeros(n + 2, np.bool_)
        last[starts[1:] - 1] = True
        last[n - 1 :] = True
        one, two = np.append(points[1:], [0]), np.append(points[2:], [0, 0])[:n]
        out = kind.copy()
        quote = np.flatnonzero((points == 0x27) & ~last[:n])
        a, b = one[quote], two[quote]
        out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = TAKES1
        both = ~last[quote + 1] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        out[quote[both]] = TAKES2
        space = np.flatnonzero((kind == SPACE_IN) & ~last[:n])
        final = space[kind[space + 1] != SPACE_IN]
        out[final] = np.where(points[final] == 0x20, SPACE_PREFIX, SPACE_LAST)
        out[starts[starts < n]] += FIRST
        return out

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """True where a pre-token starts.

        A chunk's map is followed from all states at once only until they have met in one, which
        takes a few symbols; from there on its states are known whatever came before.
        """
        n = len(symbols)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, OTHER, np.uint8)
        padded[:n] = symbols
        grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
        flat_next, flat_new = self.next.ravel(), self.new.ravel()
        out = np.empty((CHUNK, rows), np.bool_)

        def walk(state: np.ndarray, low: int, high: int, rows: np.ndarray | slice) -> np.ndarray:
            for i in range(low, high):
                at = (state << 4) | grid[i, rows]
                out[i, rows] = flat_new.take(at)
                state = flat_next.take(at)
            return state

        maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
        for symbol in grid[:HEAD]:
            maps = flat_next.take((maps << 4) | symbol[:, None])
        met = (maps == maps[:, :1]).all(axis=1)
        maps[:] = walk(maps[:, 0], HEAD, CHUNK, slice(None))[:, None]
        apart = np.flatnonzero(~met)
        if len(apart):
            whole = np.tile(np.arange(8, dtype=np.uint8), (len(apart), 1))
            for symbol in grid[:, apart]:
                whole = flat_next.take((whole << 4) | symbol[:, None])
            maps[apart] = whole
        entry = np.zeros(rows, np.uint8)
        if rows > 1:
            entry[1:] = compose_scan(maps[:-1])[:, CLOSED] if len(apart) else maps[:-1, 0]
        walk(entry, 0, HEAD, slice(None))
        if len(apart):
            walk(entry[apart], 0, CHUNK, apart)
        return out.T.ravel()[:n]

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pre-tokens of the texts in order, and how many each text has."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return [], np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        symbols = self.symbols(points, begins[lengths > 0])
        at = np.flatnonzero(self.boundaries(symbols))
        to = np.append(at[1:], len(points))
        if not self.keeps_space:
            word = self.classes[points[at]] != SPACE_IN
            at, to = at[word], to[word]
        counts = np.searchsorted(at, ends) - np.searchsorted(at, begins)
        return [joined[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)], counts
