"""Hash trees without padding: a mountain range of peaks, and the paths from nodes to the top.

Every ``fanout`` consecutive nodes of a level become the hash of their digests, joined as hex text; the last run of a level may be shorter, even
one node. A level of one node ends the tree. Sizes of all levels follow from the number of leaves, so a node knows whether its run is whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import sha256


def digest_of(parts: Iterable[bytes]) -> bytes:
    """The hash of some digests, all as hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def level_sizes(leaves: int, fanout: int) -> list[int]:
    """Nodes on each level, from the leaves to the top."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class MountainRange:
    """The stack of one stretch of a tree of which nodes come in order, of any level, without gaps.

    As in counting to the base of the fanout, a run that fills up is hashed and carried to the next level, and may fill the run there. Runs
    that began before the stretch, and those still open at its end, remain: their nodes are the stretch's peaks.
    """

    def __init__(self, leaves: int, fanout: int):
        self.sizes = level_sizes(leaves, fanout)
        self.fanout = fanout
        self.open: list[list[tuple[int, bytes]]] = [[] for _ in self.sizes]
        self.nodes: list[tuple[int, int, bytes]] = []
        self.peaks: list[tuple[int, int, bytes]] = []

    def push(self, level: int, place: int, digest: bytes) -> None:
        while True:
            run = self.open[level]
            if run and run[-1][0] + 1 != place:
                raise ValueError(f"node {place} of level {level} follows {run[-1][0]}")
            run.append((place, digest))
            if level + 1 == len(self.sizes) or (place + 1) % self.fanout and place + 1 < self.sizes[level]:
                return
            self.open[level] = []
            if run[0][0] % self.fanout:
                self.peaks += [(level, at, d) for at, d in run]
                return
            level, place, digest = level + 1, place // self.fanout, digest_of(d for _, d in run)
            self.nodes.append((level, place, digest))

    def finish(self) -> list[tuple[int, int, bytes]]:
        """All peaks. Of a stretch that is the whole tree, the top alone."""
        self.peaks += [(level, at, d) for level, run in enumerate(self.open) for at, d in run]
        self.open = [[] for _ in self.sizes]
        return self.peaks


def sibling_levels(digests: Sequence[bytes], fanout: int, levels: int) -> tuple[list[tuple[list[bytes], list[bytes]]], list[bytes]]:
    """For each of ``levels`` levels above some nodes, what stands left and right of each node in its run; and the digests on top.

    The first node must begin a run on all these levels.
    """
    found = []
    for _ in range(levels):
        left, right, above = [], [], []
        for at in range(0, len(digests), fanout):
            run = digests[at : at + fanout]
            left += [b"".join(run[:i]) for i in range(len(run))]
            right += [b"".join(run[i + 1 :]) for i in range(len(run))]
            above.append(digest_of(run))
        found.append((left, right))
        digests = above
    return found, list(digests)


def path_through(found: Sequence[tuple[list[bytes], list[bytes]]], place: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """Of what sibling_levels gives, what stands beside one node and the nodes above it."""
    path = []
    for left, right in found:
        path.append((left[place], right[place]))
        place //= fanout
    return path


def fold(digest: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The top that a digest and its siblings, level by level, lead to."""
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest
