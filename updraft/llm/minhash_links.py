"""Near duplicates by b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm.

A document's minima under BANDS * ROWS hash functions are taken once. The minima of a band, hashed together,
are a bucket; of each minimum BITS bits are kept and packed. In a bucket the packed signatures are
compared by bit counts: two minima of different shingles agree in their low bits by chance with probability
2**-BITS, so at similarity s a share s + (1 - s) / 2**BITS agrees, which is solved for s. Pairs estimated
SLACK standard deviations or less below the threshold, or above it, are candidates. Candidates hang together in
clusters, and within a cluster links are confirmed on the full sets of shingles.

A link at the threshold of 0.8 misses all 48 bands of 6 rows once in two million times and falls below the
estimate once in fifty million; more similar ones are missed less often still. Nothing else is left out.

Equal sets are one class with one member, so exact copies are never compared. Buckets and
clusters both go through ``linked``: groups of bounded weight share tasks; a larger group is dealt into
blocks, and a few of its members join every block, so what is like them hangs together after
one pass. Members outside the group's largest component then meet all blocks. No task holds more than two blocks
and those few members.

Words are runs other than space and 0x09-0x0D, A-Z lower-cased. With fewer words than
``words`` the whole sequence is one shingle; NULL, empty and blank texts have none and are linked with
nothing. Rows keep their number; rows with one id count as linked. Rows without id
take the component of equal texts that have one, else NULL, and ``kept`` is NULL there. Texts are read whole; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm import bitmaps
from updraft.llm.components import components
from updraft.llm.tables import stored
from updraft.llm.words import mix, scan, shingle_set

WORDS = 2
PERCENT = 80
BANDS, ROWS = 48, 6
BITS = 2
SLACK = 5.5
HASHES = BANDS * ROWS
LANES = HASHES * BITS // 64
LOW = np.uint64(0x5555555555555555)
BUCKET_MEMBERS = 10_000
# Of shingles, and of sixteen bytes of text each.
BLOCK_WEIGHT = 600_000
PIVOTS = 4
U64 = np.uint64
# Fixed odd multipliers of the hash functions, spread from their numbers.
MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
SIGNED = "id long, n long, h1 long, h2 long, size long, bits binary, bands array<long>"
LINKS = "a long, b long"


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By hash function and set: the smallest value. Set i begins at ``starts[i]``; none is empty."""
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k, multiplier in enumerate(MULTIPLIERS):
        out[k] = np.minimum.reduceat(((hashes * multiplier) >> U64(32)).astype(np.uint32), starts)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """By set LANES words of 64 bits: the BITS low bits of all minima."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(U64)
    shifts = (np.arange(64 // BITS, dtype=U64) * U64(BITS))[:, None]
    return np.stack([np.bitwise_or.reduce(low[i * 64 // BITS : (i + 1) * 64 // BITS] << shifts, axis=0) for i in range(LANES)], axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    """By set BANDS hashes, each of the ROWS minima of a band and its number."""
    keys = np.zeros((BANDS, least.shape[1]), U64)
    for row in range(ROWS):
        keys = mix(keys * U64(31) + least[row::ROWS].astype(U64) + U64(1))
    return mix(keys + np.arange(BANDS, dtype=U64)[:, None]).T


def agreeing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the HASHES packed values of ``one`` each of ``others`` shares."""
    differ = one ^ others
    return HASHES - np.bitwise_count((differ | (differ >> U64(1))) & LOW).sum(axis=1, dtype=np.int64)


def estimated(agree: np.ndarray) -> np.ndarray:
    """Similarity from agreeing values, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (agree / HASHES - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate from which on a pair is a candidate."""
    chance = 2.0**-BITS
    share = percent / 100 * (1 - chance) + chance
    return percent / 100 - SLACK * (share * (1 - share) / HASHES) ** 0.5 / (1 - chance)


def sign(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, hashes in scan(batch.column(1)):
                sets = [shingle_set(own, words) for own in np.split(hashes, np.cumsum(counts)[:-1])]
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                h1 = np.array([mix(s + U64(1)).sum(dtype=U64) for s in sets], U64).view(np.int64)
                h2 = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], U64).view(np.int64)
                bits, bands = [None] * len(sets), [None] * len(sets)
                if len(full):
                    least = minima(np.concatenate([sets[i] for i in full]), np.cumsum(size[full]) - size[full])
                    for i, row, keys in zip(full, packed_bits(least), band_keys(least)):
                        bits[i], bands[i] = row.tobytes(), keys.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)), pa.array(size, pa.int64()), pa.array(h1), pa.array(h2),
                        pc.fill_null(pc.binary_length(batch.column(1).slice(first, len(sets))), 0).cast(pa.int64()),
                        pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "h1", "h2", "size", "bits", "bands"],
                )

    return run


class Signatures:
    """Links by estimate alone, from packed bits."""

    def __init__(self, percent: int):
        self.least = least_estimate(percent)

    def read(self, bodies: pa.ChunkedArray) -> None:
        self.bits = np.frombuffer(b"".join(bodies.to_pylist()), U64).reshape(-1, LANES)

    def linked(self, one: int, others: np.ndarray) -> Iterator[int]:
        yield from others[estimated(agreeing(self.bits[one], self.bits[others])) >= self.least].tolist()


class Sets:
    """Links confirmed on the full sets of texts."""

    def __init__(self, percent: int, words: int):
        self.percent, self.words = percent, words

    def read(self, bodies: pa.ChunkedArray) -> None:
        self.sets = []
        for _, counts, hashes in scan(bodies):
            self.sets.extend(shingle_set(own, self.words) for own in np.split(hashes, np.cumsum(counts)[:-1]))
        self.size = np.array([len(s) for s in self.sets])

    def linked(self, one: int, others: np.ndarray) -> Iterator[int]:
        """Lazily: what is joined meanwhile is not asked about any more."""
        small, large = np.minimum(self.size[one], self.size[others]), np.maximum(self.size[one], self.size[others])
        for other in others[100 * small >= self.percent * large].tolist():
            mine, theirs = self.sets[one], self.sets[other]
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            common = int((mine[at] == theirs).sum())
            if 100 * common >= self.percent * (len(mine) + len(theirs) - common):
                yield other


def settle(label: np.ndarray, asks: np.ndarray, rule: Signatures | Sets) -> np.ndarray:
    """Labels of one group after all its links; every pair with one of ``asks`` is looked at, unless joined before."""
    label = label.copy()
    for one in np.flatnonzero(asks):
        apart = label != label[one]
        # A pair of two that ask is looked at once, by the first.
        apart[:one] &= ~asks[:one]
        for other in rule.linked(one, np.flatnonzero(apart)):
            if label[other] != label[one]:
                a, b = label[one], label[other]
                label[label == max(a, b)] = min(a, b)
    return label


def settle_task(rule: Signatures | Sets) -> Callable[[pa.Table], pa.Table]:
    """Gives each row's link to the smallest id with its label, group by group."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["id"].to_numpy(), table["grp"].to_numpy()))
        table = table.take(pa.array(order))
        group, ids, given = (table[c].to_numpy() for c in ("grp", "id", "label"))
        asks = table["asks"].to_numpy(zero_copy_only=False)
        rule.read(table["body"])
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1)) if len(group) else []
        a, b = [], []
        for first, last in zip(edges, edges[1:]):
            part = slice(first, last)
            _, start, same = np.unique(given[part], return_index=True, return_inverse=True)
            label = settle(start[same], asks[part], Shifted(rule, first))
            # Ids ascend, so a label's first row has its smallest id.
            _, start, same = np.unique(label, return_index=True, return_inverse=True)
            a.append(ids[part])
            b.append(ids[part][start[same]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    return run


class Shifted:
    """A rule over the rows from ``first`` on."""

    def __init__(self, rule: Signatures | Sets, first: int):
        self.rule, self.first = rule, first

    def linked(self, one: int, others: np.ndarray) -> Iterator[int]:
        for other in self.rule.linked(one + self.first, others + self.first):
            yield other - self.first


def settled(tasks: DataFrame, bodies: DataFrame, rule: Signatures | Sets) -> DataFrame:
    """Links of ``tasks`` (task, grp, id, label, asks), found task by task."""
    ready = bodies.join(tasks, "id").select("task", "grp", "id", "label", "asks", "body")
    return ready.groupBy("task").applyInArrow(settle_task(rule), LINKS)


def linked(members: DataFrame, bodies: DataFrame, rule: Signatures | Sets, limit: int) -> DataFrame:
    """Links (a, b) that hold the groups of ``members`` (grp, id, weight) together wherever ``rule`` says so.

    ``bodies`` (id, body) is what the rule reads. ``limit``: the weight of a block.
    """
    # Stored, because Spark splits a large join partition only where both sides come straight from a shuffle.
    totals = stored(members.groupBy("grp").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("members")).where("members > 1"), "totals")
    sized = stored(members.join(totals, "grp"), "sized")
    small = sized.where(F.col("total") <= limit)
    bins = max(1, -(-4 * (small.agg(F.sum("weight")).first()[0] or 0) // limit))
    plain = ["task", "grp", "id", "label", "asks"]
    of_bin = F.concat_ws("/", F.lit("bin"), F.pmod(F.xxhash64("grp"), F.lit(bins)))
    tasks = small.select(of_bin.alias("task"), "grp", "id", F.col("id").alias("label"), F.lit(True).alias("asks"))
    found = stored(settled(tasks, bodies, rule), "found")
    large = sized.where(F.col("total") > limit)
    if large.isEmpty():
        return found

    # Blocks of each large group; its first members by id join every block.
    blocks = stored(
        large.withColumn("parts", F.ceil(F.col("total") / limit)).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).select("grp", "id", "weight", "part", "parts"), "blocks"
    )
    slices = blocks.withColumn("_s", F.pmod(F.hash("id"), F.lit(64)))
    near = slices.withColumn("_n", F.row_number().over(Window.partitionBy("grp", "_s").orderBy("id"))).where(F.col("_n") <= PIVOTS)
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).where(F.col("_n") <= PIVOTS)
    everywhere = first.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("to <> part")
    inside = blocks.select("grp", "id", "part").unionByName(everywhere.select("grp", "id", F.col("to").alias("part")))
    task = lambda *columns: F.concat_ws("/", *columns).alias("task")
    own = stored(settled(inside.select(task("grp", "part"), "grp", "id", F.col("id").alias("label"), F.lit(True).alias("asks")), bodies, rule), "inside")

    # Whatever is outside its group's largest component meets all blocks of the group.
    roots = components(own.unionByName(found)).select("id", F.col("component").alias("label"))
    placed = stored(blocks.join(roots, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    counts = placed.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("grp").agg(F.max(F.struct("c", "label")).alias("m")).select("grp", F.col("m.label").alias("main"))
    outside = stored(placed.join(largest, "grp").where("label <> main"), "outside")
    totals = outside.groupBy("grp").agg(F.ceil(F.sum("weight") / limit).alias("out"))
    outside = stored(outside.join(totals, "grp").withColumn("x", F.pmod(F.xxhash64("id", F.lit(1)), "out")).select("grp", "id", "label", "part", "parts", "x"), "dealt")
    # Each set of outsiders with each block; in the block, itself is left out.
    asking = outside.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asking = asking.select(task("grp", "x", "y"), "grp", "id", "label", F.lit(True).alias("asks"))
    sets = outside.select("grp", "x").distinct()
    asked = placed.join(sets, "grp").select(task("grp", "x", F.col("part").alias("y")), "grp", "id", "label", F.lit(False).alias("asks"))
    cross = asked.join(asking.select("task", "id"), ["task", "id"], "left_anti").select(plain).unionByName(asking.select(plain))
    return found.unionByName(own).unionByName(stored(settled(cross, bodies, rule), "cross"))


def link(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    bucket_members: int = BUCKET_MEMBERS, block_weight: int = BLOCK_WEIGHT,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Two documents link when 100 * common >= ``percent`` * all shingles of both. The component
    is the smallest id that links lead to; ``kept`` holds for that document.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    base = stored(rows.mapInArrow(sign(words), SIGNED), "signatures")
    same = ["n", "h1", "h2"]
    # Equal sets have equal bits and bands. A text of few shingles may still be long, so its bytes weigh too.
    weight = (F.col("n") + F.max(F.expr("size div 16"))).alias("weight")
    classes = stored(base.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), weight, F.first("bits").alias("bits"), F.first("bands").alias("bands")), "classes")
    members = classes.where("rep is not null").select(F.col("rep").alias("id"), "weight", "bits", "bands")
    # Buckets with one member are dropped before anything is joined, and of buckets with the same members all but one.
    held = members.select("id", F.explode("bands").alias("grp")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    several = stored(held.where("c > 1").groupBy("c", "x", "y").agg(F.min("grp").alias("grp")).select("grp"), "several")
    dealt = members.select("id", "bands").mapInArrow(bitmaps.exploded(bitmaps.of_longs(several, "grp")), "id long, grp long")
    buckets = stored(dealt.join(several, "grp").select("grp", "id", F.lit(1).cast("long").alias("weight")), "buckets")
    near = linked(buckets, members.select("id", F.col("bits").alias("body")), Signatures(percent), bucket_members)
    clusters = components(near).select("id", F.col("component").alias("grp"))
    sized = members.select("id", "weight").join(clusters, "id").select("grp", "id", "weight")
    sized = stored(sized, "clusters")
    # Texts of no cluster go before the rest is shuffled.
    wanted = bitmaps.filtered(bitmaps.of_longs(sized, "id"), 0)
    texts = rows.where("id is not null and body is not null").mapInArrow(wanted, "id long, body binary")
    confirmed = linked(sized, texts, Sets(percent, words), block_weight)
    parts = components(confirmed)
    joined = stored(
        classes.select(*same, "rep").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component")), "joined"
    )
    placed = base.select("id", *same).join(joined, same, "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return placed.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
