"""Byte-pair merges as a lazily determinised finite-state transducer.

A token sequence is what the merges give exactly if every pair of neighbours re-encodes to itself. So
the nondeterministic machine guesses tokens along the vocabulary's trie and admits a token only after
one it is compatible with. Determinising it on demand gives states that hold a few guesses, each with
the tokens it has not yet agreed on with the others; a token is emitted as soon as all guesses agree
on it, which is bounded by the longest vocabulary entry. States and arcs are made when first used;
once there are as many states as memory is set aside for, what leads beyond them follows the guesses
themselves.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

NO_RANK = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 stands
    for itself, the other bytes follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """ids: token bytes to id; rank(a, b): priority of merging two tokens' bytes, NO_RANK if none."""

    def __init__(self, ids: dict[bytes, int], rank: Callable[[bytes, bytes], int]):
        self.ids, self.rank = ids, rank

    @classmethod
    def from_ranks(cls, path: str) -> Merges:
        """A ranks file: any two neighbours whose bytes together are a token may merge."""
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return cls(ids, lambda a, b: ids.get(a + b, NO_RANK))

    @classmethod
    def from_json(cls, path: str) -> Merges:
        """A byte-level tokenizer file: only listed pairs merge, in listed order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_alphabet()
        raw = {s: bytes(map(back.__getitem__, s)) for s in model["vocab"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        return cls({raw[s]: i for s, i in model["vocab"].items()}, lambda a, b: order.get((a, b), NO_RANK))

    def apply(self, data: bytes) -> list[bytes]:
        """Plain repeated merging, for short byte strings and as the machine's definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NO_RANK:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class PieceMemo(dict):
    """Answers by pre-token. The machine restarts at every pre-token, so an answer is the composite
    arc from its start state over the whole pre-token. Two generations of at most `limit` answers: a
    full one grows old, an old answer that is used again comes back, the rest goes."""

    def __init__(self, answer: Callable[[bytes], object], limit: int = 500_000):
        super().__init__()
        self.answer, self.limit, self.old = answer, limit, {}

    def __missing__(self, piece: str):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if (out := self.old.get(piece)) is None:
            out = self.answer(piece.encode())
        if len(piece) <= 64:
            self[piece] = out
        return out


class _State:
    """guesses; arcs by byte: next state, emitted ids, their number; what is left if the piece ends."""

    __slots__ = ("arcs", "guesses", "tail")

    def __init__(self, guesses: tuple, tail: tuple):
        self.guesses, self.arcs, self.tail = guesses, {}, tail


class Transducer:
    """run(data): ids of one pre-token. count(data): their number, from the arcs' emitted counts.

    A guess is (last agreed token and those after it, trie node of the bytes since); a state is a
    tuple of guesses. There are at most max_states states.
    """

    def __init__(self, merges: Merges, max_states: int = 60_000):
        self.merges, self.max_states = merges, max_states
        self.child: dict[int, int] = {}  # trie node << 8 | byte: node
        self.token_at: dict[int, int] = {}  # trie node: token that ends there
        self.bytes_of = {i: t for t, i in merges.ids.items()}
        for token, i in merges.ids.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
            self.token_at[node] = i
        self.spines: dict[int, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.states: dict[tuple, _State] = {}
        self.start = _State((((-1,), 0),), ())

    def _spine(self, token: int) -> tuple:
        """How the token's first and last part grow while it is merged: ((part, rank it is merged
        at), ...) for either end, and whether the merges do give the token."""
        if (known := self.spines.get(token)) is None:
            rank = self.merges.rank
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            left, right = [(parts[0], -1)], [(parts[-1], -1)]
            while len(parts) > 1:
                best, at = min((rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == NO_RANK:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 1:
                    right.append((parts[-1], best))
            known = self.spines[token] = (left, right, len(parts) == 1)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a then b re-encode to themselves: no merge across their boundary ever comes
        before the merges that complete the part on either side of it."""
        if a < 0:
            return self._spine(b)[2]
        key = a << 24 | b
        if (ok := self.fits.get(key)) is not None:
            return ok
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        rank = self.merges.rank
        left, right = self._spine(a)[1], self._spine(b)[0]
        i = j = 0
        ok = self._spine(a)[2] and self._spine(b)[2]
        while ok:
            grows_a = left[i + 1][1] if i + 1 < len(left) else NO_RANK
            grows_b = right[j + 1][1] if j + 1 < len(right) else NO_RANK
            across = rank(left[i][0], right[j][0])
            if across != NO_RANK and across < grows_a and across <= grows_b:
                ok = False
            elif grows_a == grows_b == NO_RANK:
                break
            elif grows_a <= grows_b:
                i += 1
            else:
                j += 1
        self.fits[key] = ok
        return ok

    def _arc(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...], int]:
        """Determinise one step: extend every guess, complete the one token that may end here."""
        out, ended = [], ()
        child, token_at, fits = self.child, self.token_at, self.fits
        for tokens, node in state.guesses:
            grown = child.get(node << 8 | byte)
            if grown is None:
                continue
            out.append((tokens, grown))
            if not ended and (token := token_at.get(grown)) is not None:
                if (ok := fits.get(tokens[-1] << 24 | token)) is None:
                    ok = self._compatible(tokens[-1], token)
                if ok:  # just one guess ends in a token: what merging the bytes so far would give
                    ended = (*tokens, token)
                    out.append((ended, 0))
        first = out[0][0]
        shared = len(first)
        for tokens, _ in out:
            if tokens is not first and tokens[:shared] != first:
                while tokens[:shared] != first[:shared]:
                    shared -= 1
                first = first[:shared]
        if shared > 1:
            emitted = first[1:]
            guesses = tuple([(tokens[shared - 1 :], node) for tokens, node in out])
        else:
            emitted, guesses = (), tuple(out)
        if (to := self.states.get(guesses)) is None:
            to = self.states[guesses] = _State(guesses, ended[shared:])
        state.arcs[byte] = arc = (to, emitted, len(emitted))
        return arc

    def _simulate(self, guesses: tuple, data: bytes) -> tuple[int, ...]:
        """Ids after those already emitted, following the guesses themselves without keeping states."""
        child, token_at, fits = self.child.get, self.token_at.get, self.fits.get
        for byte in data:
            out, ended = [], None
            for tokens, node in guesses:
                grown = child(node << 8 | byte)
                if grown is None:
                    continue
                out.append((tokens, grown))
                if ended is None and (token := token_at(grown)) is not None:
                    last = tokens[-1]
                    ok = fits(last << 24 | token)
                    if self._compatible(last, token) if ok is None else ok:
                        ended = ((*tokens, token), 0)
            if ended is not None:
                out.append(ended)
            guesses = out
        return next((tokens[1:] for tokens, node in guesses if node == 0), ())

    def run(self, data: bytes) -> tuple[int, ...]:
        state, ids = self.start, ()
        for at, byte in enumerate(data):
            if (arc := state.arcs.get(byte)) is None:
                if len(self.states) >= self.max_states:
                    return ids + self._simulate(state.guesses, data[at:])
                arc = self._arc(state, byte)
            state, emitted, _ = arc
            if emitted:
                ids += emitted
        return ids + state.tail

    def count(self, data: bytes) -> int:
        state, n = self.start, 0
        for at, byte in enumerate(data):
            if (arc := state.arcs.get(byte)) is None:
                if len(self.states) >= self.max_states:
                    return n + len(self._simulate(state.guesses, data[at:]))
                arc = self._arc(state, byte)
            state, _, weight = arc
            n += weight
        return n + len(state.tail)
