"""Many globs at once: extended Shift-And masks over several machine words.

A glob of m symbols has states 0 to m, one bit each; all globs' bits lie one after the other in 64-bit words. Reading a character c moves
every live state i to i + 1 where symbol i admits c (mask ``step[c]``), and keeps state i where a run that admits c follows it (mask ``stay[c]``):

    D = ((D << 1) & step[c]) | (D & stay[c])

with carries from word to word. A first state has no symbol that leads to it, so what the glob before shifts into it is masked away. The
alphabet is cut into intervals on which all symbols agree, so any character of Unicode costs one lookup.

Globs: ``*`` is a run without / and ?, ``**`` any run, ``?`` one character other than / and ?, ``[a-z]`` and ``[!a-z]`` one of a class, and
``[?]``, ``[*]``, ``[[]`` the characters themselves. A glob must match a whole text. Upper and lower case differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LAST = 0x10FFFF
#: Words of state that a worker holds at once.
MAX_CELLS = 1 << 20


@dataclass(frozen=True)
class Symbol:
    """One character: in one of the ranges, or in none of them."""

    ranges: tuple[tuple[int, int], ...]
    negated: bool = False

    def admits(self, code: int) -> bool:
        return any(low <= code <= high for low, high in self.ranges) != self.negated


PART = Symbol(((ord("/"), ord("/")), (ord("?"), ord("?"))), negated=True)
ANY = Symbol((), negated=True)


def quoted(text: str) -> str:
    """The glob that matches this text only."""
    return "".join(f"[{c}]" if c in "*?[" else c for c in text)


def _character_class(glob: str, at: int) -> tuple[Symbol, int]:
    """The class that opens at ``at``, and the place behind it."""
    begin = at + 2 if glob[at + 1 : at + 2] == "!" else at + 1
    end = glob.find("]", begin + 1)
    if end < 0:
        raise ValueError(f"class without end in {glob!r}")
    members, ranges, i = glob[begin:end], [], 0
    while i < len(members):
        wide = i + 2 < len(members) and members[i + 1] == "-"
        ranges.append((ord(members[i]), ord(members[i + 2] if wide else members[i])))
        i += 3 if wide else 1
    return Symbol(tuple(ranges), negated=begin == at + 2), end + 1


def parse(glob: str) -> tuple[list[Symbol], list[Symbol | None]]:
    """The symbols of a glob, and for each of its states the run that may stand there."""
    symbols: list[Symbol] = []
    runs: list[Symbol | None] = [None]
    i = 0
    while i < len(glob):
        if glob[i] == "*":
            double = glob[i : i + 2] == "**"
            runs[-1] = ANY if double or runs[-1] is ANY else PART
            i += 2 if double else 1
            continue
        if glob[i] == "[":
            symbol, i = _character_class(glob, i)
        else:
            symbol, i = PART if glob[i] == "?" else Symbol(((ord(glob[i]), ord(glob[i])),)), i + 1
        symbols.append(symbol)
        runs.append(None)
    return symbols, runs


class GlobAutomaton:
    """All globs as one bit-parallel automaton."""

    def __init__(self, globs: Sequence[str]):
        parsed = [parse(glob) for glob in globs]
        used = {PART, ANY} | {s for symbols, runs in parsed for s in (*symbols, *runs) if s is not None}
        cuts = {0} | {c for symbol in used for low, high in symbol.ranges for c in (low, high + 1) if c <= LAST}
        self.cuts = np.array(sorted(cuts), dtype=np.uint32)
        admitted = {symbol: np.array([symbol.admits(int(code)) for code in self.cuts]) for symbol in used}
        sizes = np.array([len(runs) for _, runs in parsed], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        self.final = first + sizes - 1
        words = int(-(-sizes.sum() // 64)) or 1
        step, stay, start = np.zeros((len(self.cuts), words * 64), bool), np.zeros((len(self.cuts), words * 64), bool), np.zeros((1, words * 64), bool)
        for at, (symbols, runs) in zip(first.tolist(), parsed):
            start[0, at] = True
            for i, symbol in enumerate(symbols):
                step[:, at + i + 1] = admitted[symbol]
            for i, run in enumerate(runs):
                if run is not None:
                    stay[:, at + i] = admitted[run]
        self.step, self.stay, self.start = (self._packed(bits) for bits in (step, stay, start))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """Rows of booleans: which globs match each text. Texts run side by side, one character of all of them at a time."""
        out = np.zeros((len(texts), len(self.final)), dtype=bool)
        order = np.argsort([-len(text) for text in texts], kind="stable")
        rows = max(1, MAX_CELLS // self.start.shape[1])
        for at in range(0, len(texts), rows):
            some = order[at : at + rows]
            out[some] = self._run([texts[i] for i in some.tolist()])
        return out

    def _run(self, texts: list[str]) -> np.ndarray:
        """texts from the longest to the shortest: those still being read are the first ones."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = (np.searchsorted(self.cuts, codes, side="right") - 1).astype(np.int32)
        lengths = np.array([len(text) for text in texts])
        starts = np.cumsum(lengths) - lengths
        live = np.repeat(self.start, len(texts), axis=0)
        reading = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(texts) else 0), side="right")
        for place, n in enumerate(reading.tolist()):
            kind, now = kinds[starts[:n] + place], live[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            live[:n] = (moved & self.step[kind]) | (now & self.stay[kind])
        return ((live[:, self.final >> 6] >> (self.final & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
