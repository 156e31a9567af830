"""SentencePiece BPE by suffix-array matching.

The texts of a batch are cut at spaces, where no piece of the model continues, and what differs is concatenated.
A suffix array over that text, sorted to the depth of the longest piece, is searched for every piece of the model: its
occurrences are one range of the array. The occurrences become edges (start, end, piece), are sorted by position and
relaxed from left to right. An edge extends the encoding of the text before it exactly if BPE would leave
its piece and the last piece before it apart; each prefix of a text has one encoding, so one edge survives at each place.

Whether two pieces stay apart follows from their merge trees: while BPE builds both, the last part of the left one and
the first part of the right one stand side by side until either is merged further; if the model has their
concatenation and would merge it before that, the pieces do not stay apart.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np

# As the library does: U+FFFD for every byte that is part of no character.
codecs.register_error("each_byte", lambda error: ("\ufffd" * (error.end - error.start), error.end))

SPACE = "▁"
NEVER = float("inf")
START, UNKNOWN, NONE = -1, -2, -3
BLOCK_CHARS = 1 << 18
MEMORY_UNITS = 300_000
PAIR_SLOTS = 1 << 21
MEMORY_UNIT_CHARS = 64


class PieceModel:
    """Pieces, merge order and normalization of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != formats.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("this operator takes BPE models with the identity normalizer, escaped spaces and a dummy prefix")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        kind = formats.ModelProto.SentencePiece
        self.normal = kind.NORMAL
        if any(k == kind.USER_DEFINED for k in self.kinds):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.ids):
            raise ValueError("a piece continues behind a space")
        scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        levels = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: levels[s] for p, s in scores.items()}
        self.unknown_id = next(i for i, k in enumerate(self.kinds) if k == kind.UNKNOWN)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, k in enumerate(self.kinds) if k == kind.CONTROL}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.left: dict[int, list[tuple[str, float]]] = {}
        for piece, i in self.ids.items():
            spines = self._spines(piece)
            if spines:
                self.right[i], self.left[i] = spines
        self.depth = max(map(len, self.ids))
        self._pairs = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self._answers = np.zeros(PAIR_SLOTS, dtype=bool)

    def merges(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """BPE by its definition, for short texts: the parts that remain and the merges made."""
        parts, made = list(text), []
        while len(parts) > 1:
            found = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if found is None:
                break
            i = found[1]
            made.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, made

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """(part, rank at which it is merged further) for the last and the first parts of a piece, from a character up. None if BPE never makes the piece."""
        parts, made = self.merges(piece)
        if len(parts) > 1:
            return None
        right, left, last, first = [], [], piece[-1], piece[0]
        end, begin = piece[-1], piece[0]
        for a, b in made:  # a merge at an edge of the piece joins the part that stands there
            if b == end and piece.endswith(a + b) and self._at_edge(piece, made, a, b, last=True):
                right.append((end, self.rank[a + b]))
                end = a + b
            if a == begin and piece.startswith(a + b) and self._at_edge(piece, made, a, b, last=False):
                left.append((begin, self.rank[a + b]))
                begin = a + b
        return right + [(end, NEVER)], left + [(begin, NEVER)]

    def _at_edge(self, piece: str, made: list, a: str, b: str, last: bool) -> bool:
        """Replay the merges to see whether this one happened at the piece's edge (equal parts may stand elsewhere too)."""
        parts = list(piece)
        for x, y in made:
            i = next(i for i, (p, q) in enumerate(zip(parts, parts[1:])) if p == x and q == y)
            if x == a and y == b and i == (len(parts) - 2 if last else 0):
                return True
            parts[i : i + 2] = [x + y]
        return False

    def apart_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the pieces of each pair, side by side, as they are. Answers are kept in a table with one slot per hash."""
        keys = left.astype(np.int64) * len(self.pieces) + right
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        answers, missed = self._answers[slots], self._pairs[slots] != keys
        if missed.any():
            new, back = np.unique(keys[missed], return_inverse=True)
            found = np.array([self._stay(self.right[k // len(self.pieces)], self.left[k % len(self.pieces)]) for k in new.tolist()], dtype=bool)
            answers[missed] = found[back]
            self._pairs[slots[missed]] = keys[missed]
            self._answers[slots[missed]] = found[back]
        return answers

    def _stay(self, right: list, left: list) -> bool:
        i = j = 0
        while True:
            x, x_ends = right[i]
            y, y_ends = left[j]
            rank = self.rank.get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:  # of equal merges the left one comes first
                return False
            if x_ends == NEVER and y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    @lru_cache(maxsize=4096)
    def spaces(self, n: int) -> tuple[int, ...]:
        """Ids of n spaces that no word takes: pairs are merged from the left, then pairs of pairs, as far as the model has them."""
        parts, made = self.merges(SPACE * n) if n <= 512 else ([], [])
        if n > 512:
            longest = max((p for p in self.ids if not p.strip(SPACE)), key=len)
            return (self.ids[longest],) * (n // len(longest)) + self.spaces(n % len(longest))
        return tuple(i for p in parts for i in self._fallback(p))

    def _fallback(self, part: str) -> list[int]:
        if part in self.ids:
            return [self.ids[part]]
        if not self.byte_ids:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]


class SuffixIndex:
    """Suffixes of a text in order of their first ``depth`` characters."""

    def __init__(self, text: str, depth: int):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.alphabet, dense = np.unique(codes, return_inverse=True)
        wide = "u1" if len(self.alphabet) < 255 else ">u2" if len(self.alphabet) < 65535 else ">u4"
        padded = np.zeros(len(codes) + depth, dtype=wide)
        padded[: len(codes)] = dense + 1
        self.depth, self.dtype, self.bytes = depth, wide, np.dtype(wide).itemsize * depth
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(codes)])
        keys = windows.view(f"S{self.bytes}").ravel()
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]

    def ranges(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern numbers, from, to): ranges of the array whose suffixes begin with the pattern, found by binary search; patterns that do not occur are left out."""
        lengths = np.array([len(p) for p in patterns])
        codes = np.zeros((len(patterns), self.depth), dtype=np.uint32)
        flat = np.frombuffer("".join(patterns).encode("utf-32-le"), dtype="<u4")
        codes[np.arange(self.depth) < lengths[:, None]] = flat
        at = np.searchsorted(self.alphabet, codes)
        known = (at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes)
        inside = np.arange(self.depth) < lengths[:, None]
        rows = np.flatnonzero((known | ~inside).all(axis=1))
        low = np.where(inside, at + 1, 0)[rows].astype(self.dtype)
        high = np.where(inside, at + 1, np.iinfo(self.dtype).max)[rows].astype(self.dtype)
        begin = np.searchsorted(self.sorted, np.ascontiguousarray(low).view(f"S{self.bytes}").ravel(), "left")
        end = np.searchsorted(self.sorted, np.ascontiguousarray(high).view(f"S{self.bytes}").ravel(), "right")
        there = end > begin
        return rows[there], begin[there], end[there]


class PieceEncoder:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.matched = [p for p, i in self.model.ids.items() if i in self.model.right]
        self.matched_ids = np.array([self.model.ids[p] for p in self.matched])
        self.matched_lengths = np.array([len(p) for p in self.matched])
        self.piece_lengths = np.array([len(p) for p in self.model.pieces])
        self.letters = set("".join(self.matched))
        self.space_id = self.model.ids.get(SPACE)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _relax(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as bytes of 32-bit integers."""
        model = self.model
        text = "\0".join(units) + "\0"
        index = SuffixIndex(text, model.depth)
        rows, begin, end = index.ranges(self.matched)
        counts = end - begin
        which = np.repeat(rows, counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = index.order[np.repeat(begin, counts) + inside]
        ends, ids = starts + self.matched_lengths[which], self.matched_ids[which]
        strange = {c for c in set(text) if c not in self.letters or c not in model.ids}
        if strange:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            spots = np.flatnonzero(np.isin(codes, np.array([ord(c) for c in strange], dtype=np.uint32)))
            starts, ends, ids = np.concatenate([starts, spots]), np.concatenate([ends, spots + 1]), np.concatenate([ids, np.full(len(spots), UNKNOWN)])
        sizes = np.array([len(u) for u in units])
        firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        depth = starts - np.repeat(firsts, sizes + 1)[starts]
        order = np.argsort(depth, kind="stable")
        starts, ends, ids = starts[order], ends[order], ids[order]
        last = np.full(len(text) + 1, NONE, dtype=np.int32)
        last[firsts] = START
        steps = np.searchsorted(depth[order], np.arange(int(sizes.max(initial=0)) + 1))
        for a, b in zip(steps, steps[1:]):  # all edges that begin so far from the start of their unit
            before, piece = last[starts[a:b]], ids[a:b]
            there = before != NONE
            check = there & (before >= 0) & (piece >= 0)
            there[check] = model.apart_many(before[check], piece[check])
            last[ends[a:b][there]] = piece[there]
        return self._backtrack(text, last, firsts, sizes)

    def _backtrack(self, text: str, last: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Ids of each unit, from the last piece at each place."""
        model, at, open_units = self.model, firsts + sizes, np.flatnonzero(sizes > 0)
        owners, found, places = [], [], []
        while len(open_units):
            piece = last[at[open_units]]
            owners.append(open_units)
            found.append(piece)
            at[open_units] -= np.where(piece >= 0, self.piece_lengths[np.maximum(piece, 0)], 1)
            places.append(at[open_units].copy())
            open_units = open_units[at[open_units] > firsts[open_units]]
        if not owners:
            return [b""] * len(sizes)
        owner, ids, place = np.concatenate(owners), np.concatenate(found), np.concatenate(places)
        order = np.argsort(place)  # units and their pieces stand in the order of the text
        owner, ids, place = owner[order], ids[order], place[order]
        if (ids == UNKNOWN).any():
            spelt = [model._fallback(text[p]) if i == UNKNOWN else [i] for i, p in zip(ids.tolist(), place.tolist())]
            owner, ids = np.repeat(owner, [len(x) for x in spelt]), np.array([i for x in spelt for i in x])
        coded = ids.astype("<i4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(sizes))) * 4).tolist()
        return [coded[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        block, size = [], 0
        for unit in units:
            if block and size + len(unit) > BLOCK_CHARS:
                found.update(zip(block, self._relax(block)))
                block, size = [], 0
            block.append(unit)
            size += len(unit) + 1
        if block:
            found.update(zip(block, self._relax(block)))
        return found

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian 32-bit integers. Words seen before come from a bounded memory of two
        generations: when the younger one is full it becomes the older, and what is used again moves on to the next."""
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        if len(self.known) > MEMORY_UNITS:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for word in set().union(*split).difference(known):
            found = older.get(word)
            if found is not None:
                known[word] = found
            elif word:
                new.append(SPACE + word)
        known.update((unit[1:], ids) for unit, ids in self._learn(new).items())
        coded = [b"".join([known[w] for w in words]) if "" not in words else self._with_spaces(words) for words in split]
        for unit in new:
            if len(unit) > MEMORY_UNIT_CHARS:
                del known[unit[1:]]
        return coded

    def _with_spaces(self, words: list[str]) -> bytes:
        """words with empty ones among them: each is a space that stands before the next word's own."""
        parts, free = [], 0
        lone = np.array([self.space_id if self.space_id is not None else -1], dtype="<i4").tobytes()
        run = lambda n: np.array(self.model.spaces(n), dtype="<i4").tobytes() if n else b""
        for word in words:
            if not word:
                free += 1
                continue
            ids = self.known[word]
            if free and ids.startswith(lone):  # the word left its own space alone, so it joins the run
                parts += [run(free + 1), ids[4:]]
            else:
                parts += [run(free), ids]
            free = 0
        return b"".join([*parts, run(free)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD, control pieces nothing, one leading space goes."""
        model = self.model
        if not any(i in model.bytes_of for i in set(ids)):
            text = "".join("" if i in model.silent else model.pieces[i] for i in ids) if model.silent & set(ids) else "".join(map(model.pieces.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in model.bytes_of:
                    held.append(model.bytes_of[i])
                    continue
                if held:
                    parts.append(held.decode("utf-8", "each_byte"))
                    held.clear()
                if i not in model.silent:
                    parts.append(model.pieces[i])
            text = "".join([*parts, held.decode("utf-8", "each_byte")])
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per model and worker."""
    return PieceEncoder(path)
