"""N-gram Jaccard join: documents linked by the similarity of their word shingles.

The links come from signature trees (``signature_tree``), one for each cluster of
documents that could hold a link, traversed in pairs. The clusters take the place of the
trees' upper levels, whose nodes would lie on several machines: two documents of different
clusters cannot reach the threshold. That is shown by prefixes. Of n shingles a partner
may miss n - ceil(t * n), so among the p = n - ceil(t * n) + l shingles with the smallest
hashes both have l in common at least. Shingles that no second document has in its prefix
are dropped; of the rest the l - 1 most frequent may be dropped as well, since one of
l common ones stays. Documents that share a remaining shingle are one cluster, unless their
sizes or what is known of their prefixes rule a link out.

Equal sets are one class with one representative, so copies are never paired. A cluster
of more than ``block_shingles`` is dealt into blocks by size and hash. Blocks are joined alone
first, then a few members of each block's largest component with one another, in rounds over
fewer and fewer tasks; what is not in the cluster's largest component after that meets all
blocks of a fitting size. No task holds more than about two blocks or two documents, and no
link is lost: two documents that never meet are in one component already.

Words are runs other than space and 0x09-0x0D, A-Z lower-cased. With fewer words than
``words`` the whole sequence is one shingle; NULL, empty and blank texts have none and
are linked with nothing. Rows keep their number; rows with one id count as linked. Rows without id
take the component of equal texts that have one, else NULL. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm.components import components
from updraft.llm.signature_tree import SignatureTree, least_overlap, like_order
from updraft.llm.tables import stored
from updraft.llm.words import give_back, mix, scan, shingle_set

WORDS = 5
PERCENT = 80
BLOCK_SHINGLES = 1_000_000
BROADCAST_ROWS = 1_000_000
PIVOTS = 8
PAIRED = 8
U64 = np.uint64
SKETCH = "id long, n long, h1 long, h2 long, prefix array<long>"
LINKS = "a long, b long"


def spare(n: np.ndarray | int) -> np.ndarray | int:
    """Common prefix shingles asked for, by the size of the set."""
    return np.maximum(1, n // 20)


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + int(spare(n)))


def sketches(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h1, h2, prefix = [], [], [], []
            for _, counts, hashes in scan(batch.column(1)):
                for own in np.split(hashes, np.cumsum(counts)[:-1]):
                    found = shingle_set(own, words)
                    size.append(len(found))
                    h1.append(mix(found + U64(1)).sum(dtype=U64))
                    h2.append(mix(found ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64))
                    # 48 bits are kept: a chance collision only adds a candidate.
                    prefix.append((found[: prefix_size(len(found), percent)] >> U64(16)).astype(np.int64))
            offsets = np.cumsum([0, *map(len, prefix)])
            values = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size, pa.int64()), *(pa.array(np.array(h, U64).view(np.int64)) for h in (h1, h2)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                ],
                names=["id", "n", "h1", "h2", "prefix"],
            )
        give_back()

    return run


def clusters(base: DataFrame, percent: int) -> DataFrame:
    """(id, cluster): documents that may have a link, with the smallest id of their cluster."""
    rows = base.where("n > 0 and id is not null").select("id", "n", F.explode("prefix").alias("s"))
    frequent = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(frequent, "s")
    # What a partner has at least in common in the prefix, whatever its size.
    need = F.greatest(F.lit(1), F.expr(f"((n * {percent} + 99) div 100) div 20"))
    each = Window.partitionBy("id", "n")
    ranked = shared.withColumns({"at": F.row_number().over(each.orderBy("df", "s")), "all": F.count(F.lit(1)).over(each)})
    chosen = stored(ranked.where(F.col("at") <= F.col("all") - need + 1).select("id", "n", "s"), "chosen")
    return components(edges(chosen, base, percent)).withColumnRenamed("component", "cluster")


def edges(chosen: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that connect all documents with a link; ``chosen`` has id, n and s.

    Documents that share a shingle of at most PAIRED are paired and tested by all that is known of
    their prefixes. Those of a more frequent one are ordered by size; where the next size is too large
    for the one before, no pair across that place has a link, and each run between is tied to one of its first.
    """
    fits = lambda small, large: 100 * small >= percent * large
    each = lambda *order: Window.partitionBy("s").orderBy(*order)
    frequent = hinted(stored(chosen.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PAIRED).select("s"), "frequent"))
    many = stored(chosen.join(frequent, "s"), "many")
    starts = F.coalesce(~fits(F.lag("n").over(each("n")), F.col("n")), F.lit(True))
    sizes = many.groupBy("s", "n").agg(F.min("id").alias("id")).withColumn("starts", starts)
    runs = stored(sizes.select("s", "n", F.last(F.when(F.col("starts"), F.col("id")), True).over(each("n")).alias("b")), "runs")
    ties = many.join(hinted(runs), ["s", "n"]).select(F.col("id").alias("a"), "b", F.lit(False).alias("test"))

    after = F.array(*(F.lead(F.struct("id", "n"), k).over(each("n", "id")) for k in range(1, PAIRED)))
    near = F.filter("after", lambda o: o.isNotNull() & fits(F.col("n"), o["n"]))
    few = chosen.join(frequent, "s", "left_anti").withColumn("after", after).select("id", F.explode(near).alias("o"))
    pairs = few.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"), F.lit(True).alias("test"))
    both = stored(ties.unionByName(pairs).where("a <> b").distinct(), "candidates")

    # Of an id with several rows nothing is known.
    tested = both.where("test").select("a", "b")
    wanted = stored(tested.select(F.col("a").alias("id")).unionByName(tested.select(F.col("b").alias("id"))).distinct(), "wanted")
    known = base.select("id", "n", "prefix").join(hinted(wanted), "id").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("prefix").alias("p"))
    known = stored(known.where("c = 1").drop("c"), "prefixes")
    of = lambda x: known.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("p").alias(f"{x}p"))
    found = tested.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "an", "ap", "b", "bn", "bp").mapInArrow(possible(percent), LINKS)
    return both.where("not test").select("a", "b").unionByName(found)


def most_common(a: np.ndarray, n: int, b: np.ndarray, m: int) -> int:
    """Upper bound of the common shingles of sets of ``n`` and ``m``, of which the smallest are ``a`` and ``b``.

    Below the end of either both are known. Equal 48 bits count as equal shingles.
    """
    ends = [x[-1] for x, size in ((a, n), (b, m)) if len(x) < size]
    if ends:
        a, b = a[: np.searchsorted(a, min(ends))], b[: np.searchsorted(b, min(ends))]
    held = np.concatenate([b, [-1]])
    common = int((held[np.searchsorted(b, a)] == a).sum())
    return common + min(n - len(a), m - len(b))


def possible(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` on (a, its size and prefix, b, its size and prefix): the pairs whose link is not ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            an, ap, bn, bp = (batch.column(i) for i in (1, 2, 4, 5))
            flat, at = [], []
            for lists in (ap, bp):
                flat.append(lists.values.to_numpy())
                at.append(lists.offsets.to_numpy())
            keep = np.ones(batch.num_rows, dtype=bool)
            for i in np.flatnonzero(ap.is_valid().to_numpy(zero_copy_only=False) & bp.is_valid().to_numpy(zero_copy_only=False)):
                n, m = an[i].as_py(), bn[i].as_py()
                a, b = (values[ends[i] : ends[i + 1]] for values, ends in zip(flat, at))
                keep[i] = most_common(a, n, b, m) >= least_overlap(n + m, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(3).filter(pa.array(keep))], names=["a", "b"])
        give_back()

    return run


def join_task(words: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """Signature trees of the clusters of one task; gives each set's link to its component's smallest id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cluster, ids, given = (table[c].to_numpy() for c in ("cluster", "id", "label"))
        sets = []
        for _, counts, hashes in scan(table["text"]):
            sets.extend(shingle_set(own, words) for own in np.split(hashes, np.cumsum(counts)[:-1]))
        a, b = [], []
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            rows = rows[[len(sets[i]) > 0 for i in rows]]
            if len(rows) < 2:
                continue
            rows = rows[like_order([sets[i] for i in rows])]
            _, first, same = np.unique(given[rows], return_index=True, return_inverse=True)
            found = SignatureTree([sets[i] for i in rows]).join(percent, first[same])
            smallest = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(smallest, found, ids[rows])
            a.append(ids[rows])
            b.append(smallest[found])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        sets = []
        give_back()
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    return run


def joined(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of ``rows`` (task, cluster, id, label), found task by task."""
    # Only ids are broadcast, and only while few enough are counted.
    keys = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    ready = texts.join(keys, "id").select("task", "cluster", "id", "label", "text")
    return ready.groupBy("task").applyInArrow(join_task(words, percent), LINKS)


def size_class(n: Column, percent: int) -> Column:
    """Sets of classes that are not neighbours differ too much in size."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("long")


def pivots_of(own: DataFrame, most: int) -> DataFrame:
    """A few members of the largest component of each task: PIVOTS, of ``most`` shingles together, at least one."""
    counts = own.groupBy("task", "root").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("task").agg(F.max(F.struct("c", "root")).alias("m")).select("task", F.col("m.root").alias("root"))
    each = Window.partitionBy("task").orderBy("id")
    held = own.join(main, ["task", "root"]).withColumns({"nth": F.row_number().over(each), "sum": F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, 0))})
    return held.where((F.col("nth") == 1) | (F.col("nth") <= PIVOTS) & (F.col("sum") <= most)).select("task", "cluster", "id", "n", "root")


def pivot_links(own: DataFrame, texts: DataFrame, words: int, percent: int, block_shingles: int) -> DataFrame:
    """Links between the largest components of a cluster's blocks; ``own`` has task, cluster, id, n and root.

    Each round deals the pivots of a cluster's tasks to at most half as many, of half a block
    on average, joins them there and takes the pivots of what came out, until one task is left.
    """
    found = own.sparkSession.createDataFrame([], LINKS)
    while True:
        pivots = stored(pivots_of(own, block_shingles // 8), "pivots")
        weights = pivots.groupBy("cluster").agg(F.count_distinct("task").alias("tasks"), F.sum("n").alias("weight")).where("tasks > 1")
        groups = F.least(F.ceil(F.col("weight") / (block_shingles // 2)), F.ceil(F.col("tasks") / 2))
        dealt = pivots.join(weights.select("cluster", groups.alias("groups")), "cluster")
        task = F.concat_ws("/", F.lit("pivots"), "cluster", F.pmod(F.xxhash64("task"), "groups"))
        dealt = stored(dealt.withColumn("task", task).select("task", "cluster", "id", "n", "root"), "dealt")
        if dealt.isEmpty():
            return found
        links = stored(joined(dealt.select("task", "cluster", "id", F.col("root").alias("label")), texts, words, percent), "pivot-links")
        found = found.unionByName(links)
        own = dealt.drop("root").join(links.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))


def large_links(large: DataFrame, texts: DataFrame, words: int, percent: int, block_shingles: int) -> DataFrame:
    """Links inside clusters of more than one block."""
    sized = large.withColumn("class", size_class(F.col("n"), percent))
    parts = sized.groupBy("cluster", "class").agg(F.ceil(F.sum("n") / block_shingles).alias("parts"))
    blocks = stored(
        sized.join(parts, ["cluster", "class"])
        .withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
        .select("cluster", "class", "part", "id", "n", F.concat_ws("/", "cluster", "class", "part").alias("task"), F.col("id").alias("label")),
        "blocks",
    )
    plain = ["task", "cluster", "id", "label"]
    inside = stored(joined(blocks.select(*plain), texts, words, percent), "inside")

    own = blocks.join(inside.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = stored(inside.unionByName(pivot_links(own, texts, words, percent, block_shingles)), "known")

    # Whatever is outside the largest component of its cluster meets every block near its size.
    roots = components(known).select("id", F.col("component").alias("root"))
    placed = stored(blocks.drop("label").join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root"), "placed")
    sizes = placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("m")).select("cluster", F.col("m.label").alias("main"))
    outside = placed.join(largest, "cluster").where("label <> main").drop("main")
    there = placed.select("cluster", "class", "part").distinct()
    near = lambda a, b: F.abs(a - b) <= 1
    # Pairs of blocks (x holds rows from outside, y any), each pair of a cluster once for each x.
    x = outside.select("cluster", F.col("class").alias("xc"), F.col("part").alias("xp")).distinct()
    pairs = stored(
        x.join(there.withColumnsRenamed({"class": "yc", "part": "yp"}), "cluster").where(near(F.col("xc"), F.col("yc")) & ~((F.col("xc") == F.col("yc")) & (F.col("xp") == F.col("yp"))))
        .withColumn("task", F.concat_ws("/", "cluster", "xc", "xp", "yc", "yp")),
        "pairs",
    )
    of = lambda rows, c, p: rows.drop("task").join(pairs.select("cluster", F.col(c).alias("class"), F.col(p).alias("part"), "task"), ["cluster", "class", "part"])
    cross = of(outside, "xc", "xp").select(*plain).unionByName(of(placed, "yc", "yp").select(*plain))
    return known.unionByName(joined(cross, texts, words, percent))


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two documents link when 100 * common >= ``percent`` * all shingles of both. The
    component is the smallest id that links lead to.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    base = stored(rows.mapInArrow(sketches(words, percent), SKETCH), "sketches")
    classes = stored(base.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    reps = stored(classes.where("rep is not null").select(F.col("rep").alias("id"), "n").join(clusters(base, percent), "id"), "clusters")
    totals = reps.groupBy("cluster").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")).where("members > 1")
    sized = reps.join(totals, "cluster")
    small = sized.where(F.col("total") <= block_shingles)
    bins = max(1, -(-(small.agg(F.sum("n")).first()[0] or 0) // (block_shingles // 2)))
    tasks = small.select(F.concat_ws("/", F.lit("bin"), F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("task"), "cluster", "id", F.col("id").alias("label"))
    texts = rows.where("id is not null and text is not null")
    found = joined(tasks, texts, words, percent)
    large = sized.where(F.col("total") > block_shingles)
    if not large.isEmpty():
        found = found.unionByName(large_links(large, texts, words, percent, block_shingles))
    # Rows with one id and several texts hang together by their id, which is one node here.
    parts = components(found)
    joined_classes = stored(
        classes.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("n", "h1", "h2", F.coalesce("component", "rep").alias("component")),
        "joined",
    )
    placed = base.select("id", "n", "h1", "h2").join(joined_classes, ["n", "h1", "h2"], "left")
    return placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def hinted(rows: DataFrame) -> DataFrame:
    """``rows`` with a broadcast hint while few enough are counted."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component kept: the first by id, NULL ids last, then by the text's hash.

    Decided row by row: rows with equal id and text are one document and are kept once, one
    id's different texts are documents of their own. Rows without id and without words are all kept.
    """
    own, body = F.col(id).cast("long"), F.col(text).cast("string")
    repeated = stored(docs.where(own.isNotNull()).groupBy(own.alias("_of")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_of"), "repeated")
    wordless = F.coalesce(F.translate(body, " \t\n\x0b\x0c\r", "") == "", F.lit(True))
    marked = docs.join(hinted(repeated), own == F.col("_of"), "left").withColumns({
        "_odd": F.col("_of").isNotNull() | (own.isNull() & ~wordless),
        # A row is known by its id or, where that is not its own, by a hash of id and text.
        "_row": F.when(F.col("_of").isNull() & own.isNotNull(), own).otherwise(F.xxhash64(own, body)),
    }).drop("_of")
    given = marked.select("_row", "_odd", own.alias("_id"), body.alias("_text"))
    odd = stored(given.where("_odd").groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_text").alias("_text")), "odd")
    once = given.where("not _odd and _id is not null").select("_row", "_text").unionByName(odd.select("_row", "_text"))
    parts = stored(link(once, id="_row", text="_text", **settings).select(F.col("doc_id").alias("_row"), "component_id"), "parts")
    if odd.isEmpty():
        gone = parts.where("_row <> component_id").select("_row")
    else:
        named = parts.join(hinted(odd.select("_row", "_id", F.lit(True).alias("_known"))), "_row", "left")
        named = named.withColumn("_id", F.when(F.col("_known"), F.col("_id")).otherwise(F.col("_row")))
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_m"), F.count(F.lit(1)).alias("c")).where("c > 1")
        gone = named.join(first, "component_id").where("_row <> _m._row").select("_row")
    kept = marked.join(gone, "_row", "left_anti")
    return kept.where("not _odd").unionByName(kept.where("_odd").dropDuplicates(["_row"])).select(*docs.columns)
