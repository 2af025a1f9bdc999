"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are regular-expression matches. Each candidate value is hashed, and the
hashes are counted over the corpus by distinct repositories and owners: a value
that many owners carry is a widely copied example, one that stays with few owners
looks live. Besides the base kinds, unlabelled high-entropy runs are candidates; such a
run becomes a span (kind ``owned``) only where its hash is owner-specific, so the
method adds spans and never removes a base one.

One row comes out for each row in, repeated ids included. NULL texts count as empty
and give no spans. NULL owners or repositories count as one unnamed owner or
repository. Texts are searched whole, in time that grows with their matches; ties of two spans at one start follow the
order of KINDS. Columns besides id, text, owner and repository are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm.tables import stored

# The base kinds, in their order, with pattern, value group and least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
OWNED = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
EXAMPLE_OWNERS = 3
LIVE_OWNERS = 1
HEAVY_SHARE = 1000


def matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap, size, value) of all leftmost non-overlapping matches, in text order.

    ``gap`` is the length of the text between a match and the one before it; running sums
    of gaps and sizes give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), values.alias("v")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("value")),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string>>"))


def candidates(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (rank, gap, size, hash) in text order; ``hash`` is NULL where the value is no candidate."""

    def candidate(m: Column) -> Column:
        counts = F.length(m["value"]) >= least
        if kind == "owned":
            counts = counts & high_entropy(m["value"])
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), m["gap"].alias("gap"), m["size"].alias("size"), F.when(counts, F.sha2(m["value"], 256)).alias("hash"))

    return F.transform(matches(text, pattern, group), candidate)


def high_entropy(value: Column) -> Column:
    """Mixed letters and digits with at least twelve distinct characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= 12)


def found_in(text: Column) -> Column:
    """The matches of all kinds in a text, each kind in text order."""
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<rank:int,gap:int,size:int,hash:string>>")
    assign, access, _ = (candidates(body, *kind) for kind in BASE_KINDS)
    # Runs of 23 and less never count, and dropping them moves no other run.
    hexes = candidates(body, "hex", "[0-9a-f]{24,}", 0, 24)
    loose = candidates(body, "owned", OWNED, 0, 24)
    return F.concat(
        assign, F.when(body.contains("AKIA"), access).otherwise(none),
        F.when(body.rlike("[0-9a-f]{24}"), hexes).otherwise(none), F.when(body.rlike(OWNED), loose).otherwise(none),
    )


def located(each: DataFrame) -> DataFrame:
    """One row for each candidate of ``each`` (row, owner, repository, found), with begin and end.

    Unlabelled candidates that overlap a base one are left out. Places and overlaps are
    running sums, maxima and minima over the matches of a row, so a text full of matches
    costs no more for each of them; one shuffle by row serves all three windows.
    """
    hits = each.select("row", "owner", "repository", F.posexplode("found").alias("nth", "m")).select("row", "owner", "repository", "nth", "m.*")
    so_far = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    placed = placed.where("hash IS NOT NULL").withColumn("begin", F.col("end") - F.col("size"))
    base = F.col("rank") != KINDS.index("owned")
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("begin"))
    after = F.min(F.when(base, F.col("begin"))).over(Window.partitionBy("row").orderBy(F.col("begin").desc()))
    apart = placed.withColumns({"_before": before, "_after": after})
    overlaps = F.coalesce(F.col("_before") > F.col("begin"), F.lit(False)) | F.coalesce(F.col("_after") < F.col("end"), F.lit(False))
    return apart.where(base | ~overlaps).select("row", "owner", "repository", "rank", "begin", "end", "hash")


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """Distinct owners and repositories of each candidate hash, and its occurrences.

    Occurrences collapse to (hash, owner, repository) on the map side before they
    are shuffled, so a value copied into a third of all rows stays small.
    """
    pairs = found.groupBy("hash", F.coalesce(F.col(owner), F.lit("")).alias("o"), F.coalesce(F.col(repository), F.lit("")).alias("r")).agg(F.count(F.lit(1)).alias("times"))
    owners = pairs.groupBy("hash", "o").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.sum("times").alias("times"))


def with_ownership(flat: DataFrame) -> DataFrame:
    """``flat`` with owners and repositories of each hash.

    A hash that holds more than one in HEAVY_SHARE of all occurrences would be one task of
    the join. There are fewer than HEAVY_SHARE such hashes whatever the input, so these
    are broadcast, and their occurrences stay where they are.
    """
    counts = stored(ownership(flat, "owner", "repository"), "secret-owners")
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    heavy = F.col("times") * HEAVY_SHARE > total
    hot = F.broadcast(counts.where(heavy).drop("times"))
    cold = flat.join(hot.select("hash"), "hash", "left_anti").join(counts.where(~heavy).drop("times"), "hash")
    return flat.join(hot, "hash").unionByName(cold)


def scan(
    docs: DataFrame, owner: Column, repository: Column, id: str = "doc_id", text: str = "text",
    example_owners: int = EXAMPLE_OWNERS, live_owners: int = LIVE_OWNERS,
) -> DataFrame:
    """For each row: id and ``findings``, sorted structs (begin, rank, kind, end, hash, owners, repositories, verdict).

    ``verdict`` is ``example`` from ``example_owners`` owners on, ``live`` up to
    ``live_owners``, else ``shared``.
    """
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    each = stored(texts.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", found_in(F.col("text")).alias("found")), "secrets")
    counted = with_ownership(stored(located(each), "secret-hits"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") <= live_owners, "live").otherwise("shared")
    kept = counted.where((F.col("rank") != KINDS.index("owned")) | (F.col("owners") <= live_owners))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind")
    finding = F.struct("begin", "rank", kind, "end", "hash", "owners", "repositories", verdict.alias("verdict"))
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    empty = F.array().cast(grouped.schema["findings"].dataType)
    return each.select("row", "id").join(grouped, "row", "left").select(F.col("id").alias(id), F.coalesce("findings", empty).alias("findings"))


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda m: F.concat_ws(":", m["kind"], m["begin"], m["end"])), ",")


def digest(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans of each scanned row."""
    of = lambda kind: F.size(F.filter("findings", lambda m: m["kind"] == kind)).cast("long")
    judged = lambda v: F.size(F.filter("findings", lambda m: m["verdict"] == v)).cast("long")
    base = F.filter("findings", lambda m: m["kind"] != "owned")
    return scanned.select(
        id, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"),
        of("owned").alias("n_owned"), judged("example").alias("n_example"), judged("live").alias("n_live"),
        F.coalesce(F.array_max(F.transform("findings", lambda m: m["repositories"])), F.lit(0).cast("long")).alias("most_repositories"),
    )
