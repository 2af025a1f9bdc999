"""Merkle manifest of a table: a persistent tree in which a tampered leaf makes a new version.

Every row is a leaf, the hash of its columns. The leaves of a part (a source), in the order of their
ids, are hashed by runs of FANOUT until one node is left, the part's root; the parts' roots, in the order
of the parts, likewise give the table's root.

The tree is built in aligned blocks of BLOCK nodes, each by one group of a shuffle; the roots of a
part's blocks are the nodes of its next tier, until one block is left. A block is a ``PersistentTree``: its nodes
never change, and a version with another leaf copies that leaf's ancestors only and shares all other
nodes. Above its block a version goes on along the siblings that the upper tiers hand down, one short list for each
block, so no task holds more than a block and no version more than its own path.

Numbers along the order come from range partitions: the place in a partition plus what the
partitions before it hold of the same part, so a part may hold all rows.

NULL columns have a mark of their own. Empty texts are values. Rows with one id are ordered by
their leaves; equal rows are leaves side by side, each with its own proof. Rows without id come
first in their part and are never tampered with. A NULL part is a part and comes first. An empty table has no
rows and no root. Columns besides those named are not read; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm.tables import crc32_of_id, stored

FANOUT = 16
BLOCK_LEVELS = 2
BLOCK = FANOUT**BLOCK_LEVELS
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = ["part", "pos", "n", "digest", "id", "changed"]
BLOCKS = "part string, block long, n long, root string, digests binary, ids array<long>, changed array<string>"
PATHS = "part string, block long, siblings array<string>, subroot string, root string"
PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while FANOUT**levels < n:
        levels += 1
    return levels


class PersistentTree:
    """Nodes by number; a node is its digest and its children, and is never changed."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.levels = levels
        self.digest, self.children, self.runs = list(leaves), [()] * len(leaves), {}
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self.add(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
        (self.root,) = row

    def add(self, children: tuple[int, ...]) -> int:
        self.digest.append(digest_of("".join([self.digest[c] for c in children])))
        self.children.append(children)
        return len(self.digest) - 1

    def path(self, root: int, at: int) -> list[tuple[int, int]]:
        """(node, slot of its child) from the root down to the parent of leaf ``at``."""
        found, node = [], root
        for level in reversed(range(self.levels)):
            slot = at // FANOUT**level % FANOUT
            found.append((node, slot))
            node = self.children[node][slot]
        return found

    def replaced(self, root: int, at: int, digest: str) -> list[int]:
        """The nodes of a version of ``root`` with another leaf: the leaf and its copied ancestors, the new root last."""
        self.digest.append(digest)
        self.children.append(())
        copied = [len(self.digest) - 1]
        for node, slot in reversed(self.path(root, at)):
            own = self.children[node]
            copied.append(self.add((*own[:slot], copied[-1], *own[slot + 1 :])))
        return copied

    def siblings(self, root: int, at: int) -> list[str]:
        """From the leaf up: the digests left of its path and those right of it, level by level."""
        out = []
        for node, slot in reversed(self.path(root, at)):
            if node not in self.runs:
                self.runs[node] = "".join([self.digest[c] for c in self.children[node]])
            run = self.runs[node]
            out += [run[: HEX * slot], run[HEX * (slot + 1) :]]
        return out


def folded(digest: str, siblings: Sequence[str]) -> list[str]:
    """The digests on the way up from one node, by pairs of texts to its left and right."""
    out = []
    for left, right in zip(siblings[::2], siblings[1::2]):
        digest = digest_of(left + digest + right)
        out.append(digest)
    return out


def tree_of(digests: bytes, n: int) -> PersistentTree:
    """The tree of a block that belongs to a tier of n nodes."""
    text = digests.hex()
    return PersistentTree([text[i : i + HEX] for i in range(0, len(text), HEX)], min(BLOCK_LEVELS, levels_of(n)))


def packed(table: pa.Table) -> pa.Table:
    """One block: its nodes side by side and its root."""
    rows = table.take(pa.array(np.argsort(table["pos"].to_numpy(), kind="stable")))
    digests, n = b"".join(map(bytes.fromhex, rows["digest"].to_pylist())), rows["n"][0].as_py()
    tree = tree_of(digests, n)
    return pa.table({
        "part": rows["part"][:1], "block": pa.array([rows["pos"][0].as_py() // BLOCK], pa.int64()), "n": rows["n"][:1],
        "root": [tree.digest[tree.root]], "digests": pa.array([digests], pa.binary()),
        "ids": pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())), "changed": pa.array([rows["changed"].to_pylist()], pa.list_(pa.string())),
    })


def numbered(rows: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, from 0 within each part by ``order``, and ``n``, the rows of the part."""
    placed = rows.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_task", F.shiftright("_at", 33))
    held = placed.groupBy("_task", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(part)
    before = F.sum("_c").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(held.select("_task", part, "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n")), "starts")
    joined = placed.join(starts, ["_task", part])
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_first", "_before")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of ``nodes`` (NODES), then those of the blocks' roots, until each part is one block."""
    out = []
    while True:
        keyed = nodes.withColumn("_block", F.expr(f"pos div {BLOCK}"))
        blocks = stored(keyed.groupBy("part", "_block").applyInArrow(lambda t: packed(t.select(NODES)), BLOCKS), "blocks")
        out.append(blocks)
        above = blocks.where(F.col("n") > BLOCK)
        if above.isEmpty():
            return out
        nodes = above.select(
            "part", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("changed"),
        )


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of all batches, turned into Python objects one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way up from each node of a block: its own siblings, then those of the block."""
    for row in each(batches):
        tree = tree_of(row["digests"], row["n"])
        count = len(row["digests"]) // (HEX // 2)
        yield pa.RecordBatch.from_pylist([
            {
                "part": row["part"], "block": row["block"] * BLOCK + at, "siblings": tree.siblings(tree.root, at) + row["siblings"],
                "subroot": row["subroot"], "root": row["root"],
            }
            for at in range(count)
        ], schema=pa.schema([("part", pa.string()), ("block", pa.int64()), ("siblings", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]))


def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf of a block its proof and the root it leads to; a changed leaf leads there by a version of its own."""
    for row in each(batches):
        tree, outer = tree_of(row["digests"], row["n"]), row["siblings"]
        above = "".join(outer)
        out: dict[str, list] = {name: [] for name in ("leaf", "proof_sha256", "folded_root", "copied")}
        for at, changed in enumerate(row["changed"]):
            leaf, inner = tree.digest[at], tree.siblings(tree.root, at)
            if changed is None:
                way, copied = folded(leaf, inner + outer), []
            else:
                version = [tree.digest[node] for node in tree.replaced(tree.root, at, changed)[1:]]
                way = copied = version + folded(version[-1] if version else changed, outer)
            out["leaf"].append(leaf)
            out["proof_sha256"].append(digest_of("".join(inner) + above))
            out["folded_root"].append(way[-1] if way else (leaf if changed is None else changed))
            out["copied"].append(copied)
        n = len(row["ids"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()), pa.array(out["leaf"]), pa.array([row["subroot"]] * n), pa.array([row["root"]] * n),
                pa.array(out["proof_sha256"]), pa.array(out["folded_root"]), pa.array(out["copied"], pa.list_(pa.string())),
            ],
            names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "copied"],
        )


def on_blocks(run: Callable, blocks: DataFrame, paths: DataFrame, schema: str) -> DataFrame:
    """``run`` over the blocks of a tier, each with the way up from it."""
    joined = blocks.drop("root").join(paths, ["part", "block"]).select("part", "block", "n", "digests", "ids", "changed", "siblings", "subroot", "root")
    return joined.mapInArrow(run, schema)


def paths_down(tier: list[DataFrame], top: DataFrame) -> DataFrame:
    """PATHS of the lowest tier's blocks, from those of the parts' last blocks (``top``: part, siblings, subroot, root)."""
    paths = None
    for blocks in reversed(tier):
        ends = blocks.where(F.col("n") <= BLOCK).select("part", "block").join(top, "part").select("part", "block", "siblings", "subroot", "root")
        own = ends if paths is None else ends.unionByName(paths)
        if blocks is tier[0]:
            return own
        paths = stored(on_blocks(handed_down, blocks, own, PATHS), "paths")
    raise ValueError("no tier")


def manifest(docs: DataFrame, tampered: Callable[[Column], Column] | None = None, touched: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """For each row of ``docs`` its leaf, its part's root, the table's root and its proof.

    ``fields``: the id, the part, further columns and last the text. Where ``touched`` holds, the leaf is also made
    from ``tampered`` of the text; ``copied`` then holds the digests of the nodes that its version copies, from the leaf's
    parent to the root, and ``folded_root`` is that version's root. Elsewhere ``folded_root`` is
    what the leaf and its siblings lead to. ``proof_sha256`` is the hash of all siblings from the leaf up.
    """
    id, part, *others, text = fields
    columns = [F.col(name) for name in fields]
    changed = F.lit(None).cast("string")
    if tampered is not None and touched is not None:
        # A NULL text stays NULL.
        changed = F.when(touched, leaf_of([*columns[:-1], tampered(F.col(text))]))
    leaves = docs.select(
        # Parts keep their order with NULL before all others.
        F.when(F.col(part).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(part).cast("string"))).alias("part"),
        F.col(id).cast("long").alias("id"), leaf_of(columns).alias("digest"), changed.alias("changed"),
    )
    # Equal rows differ by their place in the stored table, so that many of them do not fall into one range.
    leaves = stored(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    own = tiers(numbered(leaves, "part", ["id", "digest", "_row"]).select(NODES))
    # Whatever tier a part ends in, its last block's root is the part's.
    ends = [blocks.where(F.col("n") <= BLOCK).select(F.lit("").alias("_all"), "part", "root") for blocks in own]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    placed = stored(numbered(subroots, "_all", ["part"]), "subroots")
    upper = tiers(placed.select(
        F.col("_all").alias("part"), "pos", "n", F.col("root").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("changed"),
    ))
    none = F.array().cast("array<string>")
    last = upper[-1].where(F.col("n") <= BLOCK).select("part", none.alias("siblings"), F.lit(None).cast("string").alias("subroot"), "root")
    ways = on_blocks(handed_down, upper[0], paths_down(upper, last), PATHS).select(F.col("block").alias("pos"), "siblings", F.col("root").alias("whole"))
    top = stored(placed.join(ways, "pos").select("part", "siblings", F.col("root").alias("subroot"), F.col("whole").alias("root")), "top")
    return on_blocks(proofs, own[0], paths_down(own, top), PROOFS).withColumnRenamed("id", id)


def lower_cased(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def one_in(n: int, id: str = "doc_id") -> Column:
    """Rows whose id's crc32 is divisible by n; none without id."""
    return F.col(id).isNotNull() & (crc32_of_id(id) % n == 0)
