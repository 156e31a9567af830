"""Merkle manifests: a hash tree over the rows of each group, a tree over the groups, and proofs of all rows.

Rows become leaves (one digest each) and only digests travel from there. Leaves are dealt by ranges of group and order; a leaf's place is its place
in its partition plus the leaves of the group before it, so every partition knows where in its trees it stands. It runs a mountain-range
stack over its leaves and emits all nodes that it can complete, and as peaks what reaches over its edges. Peaks of one block of
the tree are merged in one task, ``STRIDE`` levels a round, so a task never holds more than BLOCK nodes and rounds grow
with the logarithm of the largest group.

Proofs go down the same blocks: a block's nodes take the path of their common ancestor and the siblings inside the block. A block whose top
differs from the stored node stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.merkle_stack import MountainRange, digest_of, fold, path_through, sibling_levels
from quern.workspace import discard, materialize

#: Nodes of a block at most, unless one run is larger.
BLOCK = 1024
EMIT_ROWS = 1 << 15
NODES = "grp string, size long, level int, pos long, digest binary, peak boolean"
PATHS = "grp string, block long, digest binary, subroot binary, root binary, lefts array<binary>, rights array<binary>"
PROOFS = "leaf binary, subroot binary, root binary, proof binary, folded binary"


def stride(fanout: int) -> int:
    """Levels of a block."""
    if fanout < 2:
        raise ValueError("a fanout of two or more is needed")
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def leaf_digest(*values: Column) -> Column:
    """The hash of some values: each ``-`` if null, else its length in bytes, a colon, and its text (integers in decimal)."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def group_key(group: Column) -> Column:
    """Strings that sort as groups do bytewise, null first and apart from the empty one."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Tree:
    """leaves: grp, size, pos and what was carried along; nodes: all above the leaves; tops: (grp, size, height, digest) of every group."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    fanout: int

    def discard(self) -> None:
        discard(self.leaves, self.nodes, self.tops)


def place_leaves(leaves: DataFrame, order: str) -> DataFrame:
    """leaves (grp, leaf binary, the column ``order``, more) with size and pos in their group, written down.

    Leaves ascend by order, null first, ties by digest; equal ones are dealt by a number, so that very many copies spread over tasks as well.
    """
    slim = materialize(leaves.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    keys = ["grp", order, "leaf", "__salt"]
    dealt = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__salt")
    dealt = materialize(dealt.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at") - F.shiftleft("__part", 33)), "merkle-dealt")
    held = dealt.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(W.partitionBy("grp").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = held.select("grp", "__part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("grp")).alias("size"))
    placed = materialize(dealt.join(starts, ["grp", "__part"]).withColumn("pos", F.col("__at") + F.col("shift")).drop("__part", "__at", "shift").sortWithinPartitions("grp", "pos"), "merkle-placed")
    discard(slim, dealt)
    return placed


def _node_rows(grp: str, size: int, nodes: list, peak: bool) -> list[tuple]:
    return [(grp, size, level, pos, bytes.fromhex(d.decode()), peak) for level, pos, d in nodes]


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    columns = zip(*rows) if rows else ((),) * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["grp", "size", "level", "pos", "digest", "peak"])


def _run_stacks(fanout: int):
    """Stretches of consecutive leaves through their stacks. A leaf that does not follow the one before it begins a new stretch."""

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at, rows = None, (None, -1, 0), []
        for batch in batches:
            for grp, size, pos, leaf in zip(*(column.to_pylist() for column in batch.columns)):
                if stack is None or at[:2] != (grp, pos - 1):
                    if stack is not None:
                        rows += _node_rows(at[0], at[2], stack.nodes, False) + _node_rows(at[0], at[2], stack.finish(), True)
                    stack = MountainRange(size, fanout)
                stack.push(0, pos, leaf.hex().encode())
                at = (grp, pos, size)
                if len(stack.nodes) >= EMIT_ROWS:
                    rows += _node_rows(grp, size, stack.nodes, False)
                    stack.nodes = []
                if len(rows) >= EMIT_ROWS:
                    yield _node_batch(rows)
                    rows = []
        if stack is not None:
            rows += _node_rows(at[0], at[2], stack.nodes, False) + _node_rows(at[0], at[2], stack.finish(), True)
        yield _node_batch(rows)

    return of_part


def _merge_peaks(fanout: int):
    """The peaks of one block, of any levels, to its top."""

    def of_block(table: pa.Table) -> pa.Table:
        grp, size = table["grp"][0].as_py(), table["size"][0].as_py()
        stack = MountainRange(size, fanout)
        rows = zip(*(table[c].to_pylist() for c in ("level", "pos", "digest")))
        for level, pos, digest in sorted(rows, key=lambda r: r[1] * fanout ** r[0]):
            stack.push(level, pos, digest.hex().encode())
        nodes, peaks = stack.nodes, stack.finish()
        if len(peaks) != 1:
            raise ValueError(f"{len(peaks)} peaks of a block of {grp!r} do not meet")
        return pa.Table.from_batches([_node_batch(_node_rows(grp, size, nodes, False) + _node_rows(grp, size, peaks, True))])

    return of_block


def _height(fanout: int) -> Column:
    """The level of a tree's top, from its column size."""
    return F.expr(f"size(filter(sequence(0, 62), k -> pow({fanout}, k) < size))")


def build_tree(leaves: DataFrame, order: str, fanout: int = 2) -> Tree:
    """Trees over leaves (grp string, leaf binary, the column ``order``, more columns, which stay on the leaves)."""
    placed = place_leaves(leaves, order)
    levels = stride(fanout)
    found = [materialize(placed.select("grp", "size", "pos", "leaf").sortWithinPartitions("grp", "pos").mapInArrow(_run_stacks(fanout), NODES), "merkle-nodes")]
    peaks, bound, tops = found[0].where("peak"), levels, []
    while True:
        tops.append(peaks.where(F.col("level") == _height(fanout)))
        rest = peaks.where(F.col("level") < _height(fanout))
        if rest.isEmpty():
            break
        due = rest.where(F.col("level") < bound).withColumn("block", F.expr(f"pos div cast(pow({fanout}, {bound} - level) as bigint)"))
        merged = materialize(due.groupBy("grp", "block").applyInArrow(_merge_peaks(fanout), NODES), "merkle-nodes")
        found.append(merged)
        peaks = merged.where("peak").unionByName(rest.where(F.col("level") >= bound))
        bound += levels
    subroots = materialize(reduce(DataFrame.unionByName, tops).select("grp", "size", F.col("level").alias("height"), "digest"), "merkle-tops")
    nodes = materialize(reduce(DataFrame.unionByName, [f.where("not peak") for f in found]).select("grp", "size", "level", "pos", "digest"), "merkle-tree")
    discard(*found)
    return Tree(placed, nodes, subroots, fanout)


def _binary(values: list[bytes]) -> list[bytes]:
    return [bytes.fromhex(v.decode()) for v in values]


def _hex(values: list[bytes]) -> list[bytes]:
    return [v.hex().encode() for v in values]


def _descend(fanout: int, final: bool, carried: list[str]):
    """A block's nodes and the path of its top -> the paths of the nodes, or for leaves (``final``) their proofs and what they fold to."""

    def of_block(nodes: pa.Table, top: pa.Table) -> pa.Table:
        if nodes.num_rows and top.num_rows != 1:
            raise ValueError(f"{top.num_rows} paths for a block of {nodes['grp'][0].as_py()!r}")
        nodes = nodes.sort_by("pos")
        places, digests = nodes["pos"].to_pylist(), _hex(nodes["digest"].to_pylist())
        climbs = nodes["climb"][0].as_py() if places else 0
        inner, above = sibling_levels(digests, fanout, climbs)
        if places and (_binary(above) != [top["digest"][0].as_py()] or places != list(range(places[0], places[0] + len(places)))):
            raise ValueError(f"a block of {nodes['grp'][0].as_py()!r} does not lead to its node")
        row = {name: top[name][0].as_py() for name in ("subroot", "root", "lefts", "rights")} if places else {"lefts": [], "rights": [], "subroot": None, "root": None}
        outer = list(zip(_hex(row["lefts"]), _hex(row["rights"])))
        subroots, roots = pa.array([row["subroot"]] * len(places), pa.binary()), pa.array([row["root"]] * len(places), pa.binary())
        if not final:
            paths = [path_through(inner, i, fanout) for i in range(len(places))]
            lefts = [_binary([left for left, _ in path]) + row["lefts"] for path in paths]
            rights = [_binary([right for _, right in path]) + row["rights"] for path in paths]
            own = [nodes["grp"].combine_chunks(), nodes["pos"].combine_chunks(), nodes["digest"].combine_chunks()]
            return pa.table([*own, subroots, roots, pa.array(lefts, pa.list_(pa.binary())), pa.array(rights, pa.list_(pa.binary()))], names=[f.split()[0] for f in PATHS.split(", ")])
        tail = b"".join(left + right for left, right in outer)
        proofs, folded = [], []
        for i, (digest, claimed) in enumerate(zip(digests, nodes["claimed"].to_pylist())):
            path = path_through(inner, i, fanout)
            proofs.append(digest_of([*(left + right for left, right in path), tail]))
            folded.append(fold(claimed.hex().encode() if claimed is not None else digest, path + outer))
        out = [nodes[name].combine_chunks() for name in carried]
        return pa.table([*out, nodes["digest"].combine_chunks(), subroots, roots, pa.array(_binary(proofs), pa.binary()), pa.array(_binary(folded), pa.binary())], names=carried + [f.split()[0] for f in PROOFS.split(", ")])

    return of_block


def paths_down(tree: Tree, base: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """From (grp, subroot, root, lefts, rights), what stands beside each group's top on the way to the root, level by level, to the leaves.

    Without ``carry`` the paths of all leaves as PATHS has them, block being the leaf's place. With it (carry, PROOFS), all digests binary: proof is
    the hash of the siblings level by level, left to right; folded the root that the leaf's column ``claimed``, or the leaf itself where
    that is null, leads to with these siblings.
    """
    fanout, levels = tree.fanout, stride(tree.fanout)
    height = tree.tops.agg(F.max("height")).first()[0] or 0
    tops = tree.tops.join(base, "grp").select("grp", "height", F.lit(0).cast("long").alias("block"), "digest", "subroot", "root", "lefts", "rights")
    tops = materialize(tops, "merkle-paths")
    above, old = None, [tops]
    for band in range(max(0, -(-height // levels) - 1), -1, -1):
        low, high = band * levels, (band + 1) * levels
        here = tops.where((F.col("height") <= high) & ((F.col("height") > low) | F.lit(band == 0))).drop("height")
        above = here if above is None else above.unionByName(here)
        final = not band and carry is not None
        if band:
            nodes = tree.nodes.where(F.col("level") == low).select("grp", "size", "pos", "digest")
        else:
            nodes = tree.leaves.withColumn("digest", F.col("leaf")).select("grp", "size", "pos", "digest", *(("claimed", *carry) if final else ()))
        nodes = nodes.withColumn("climb", F.least(F.lit(levels), _height(fanout) - low)).where((F.col("climb") > 0) | F.lit(band == 0))
        fields = [tree.leaves.schema[c] for c in carry] if final else []
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), PROOFS]) if final else PATHS
        nodes = nodes.drop("size").withColumn("block", F.expr(f"pos div {fanout**levels}"))
        found = nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_descend(fanout, final, [f.name for f in fields]), schema)
        above = materialize(found, "merkle-paths")
        old.append(above)
    discard(*old[:-1])
    return above


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, the tree over their tops, and the root (hex; None without rows)."""

    groups: Tree
    top: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """(grp, level, pos, digest hex) of all nodes above the leaves: grp as group_key gives it, null for the tree over the groups."""
        inner = self.groups.nodes.select("grp", "level", "pos", F.lower(F.hex("digest")).alias("digest"))
        return inner.unionByName(self.top.nodes.select(F.lit(None).cast("string").alias("grp"), "level", "pos", F.lower(F.hex("digest")).alias("digest")))

    def subroots(self) -> DataFrame:
        """(grp, size, subroot hex)."""
        return self.groups.tops.select("grp", "size", F.lower(F.hex("digest")).alias("subroot"))


def dataset_manifest(leaves: DataFrame, order: str, fanout: int = 2) -> Manifest:
    """The manifest of leaves (grp from group_key, leaf from leaf_digest, the column ``order``, and more to carry along, among them ``claimed``).

    Null groups are a group of their own, before all others. Rows with equal order, null ones among them, are placed by their digests, and
    equal rows stay as many as they are. A table without rows has no subroots and the root None. Only digests and carried columns
    are shuffled, so the length of texts does not matter.
    """
    groups = build_tree(leaves, order, fanout)
    top = build_tree(groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("claimed")), "member", fanout)
    found = top.tops.first()
    return Manifest(groups, top, found["digest"].hex() if found else None)


def prove(manifest: Manifest, carry: Sequence[str]) -> DataFrame:
    """(carry, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, digests as hex.

    ``claimed`` of a leaf, where it is not null, takes the leaf's place when the root is computed again: verified says whether it is the same root.
    """
    nothing = F.array().cast("array<binary>")
    whole = manifest.top.tops.select("grp", F.col("digest").alias("subroot"), F.col("digest").alias("root"), nothing.alias("lefts"), nothing.alias("rights"))
    members = manifest.top.leaves.select("member", F.col("pos").alias("block"))
    outer = paths_down(manifest.top, whole).join(members, "block").select(F.col("member").alias("grp"), F.col("digest").alias("subroot"), "root", "lefts", "rights")
    found = paths_down(manifest.groups, outer, carry)
    digests = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    shown = found.select(*carry, *[F.lower(F.hex(c)).alias(name) for c, name in digests.items()])
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
