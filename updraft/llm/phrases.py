"""Phrase collocations of each language by best-first branch-and-bound growth over prefixes.

Phrases grow by one word at a time. Words and word pairs are counted whole, for those whose every part is
frequent; longer phrases only below prefixes on the frontier. A phrase of three words
that begins with the pair p = (v, w) occurs at most f(p) times, and as often as its rest at most, so cut
after its first word its score is no more than f(p) / f(v): the prefix counts bound it
from above. Each language's frontier is expanded from the highest bounds down to a floor:
the score that ``rank`` of its pairs reach. Whether a pair survives depends on longer phrases too, so the prefixes
that could hold one of half its count are expanded as well. With ``top`` surviving phrases at
or above the floor the language is settled, ties included: whatever was not expanded scores less. Else
the rank is doubled and more is expanded, until nothing is left to expand.

Which occurrences lie below the frontier is told by bitmaps of a fixed size, whatever the number of
prefixes: a wrong bit makes a phrase counted in vain, and none is missed. A task adds up what it
holds at a time by hashes of 64 bits; all counts and joins after that are on the phrases themselves. Scores are integers from exact decimals.

A-Z is lower-cased; pieces end at ``.,;:!?`` and 0x0A-0x0D, words at spaces and tabs, and nothing
else. NULL and empty texts have no words. A NULL language is ``und`` and one with rows of that name. Repeated rows count each
time. Tied phrases go by count, then by the bytes of the phrase. An empty table, or one without frequent
phrases, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm import bitmaps
from updraft.llm.tables import stored
from updraft.llm.words import GROUP_BYTES, STEP, buffer_hashes, cuts, mix

TOP = 2000
LEAST = 10
# A candidate falls to a longer one with this share of its count, in hundredths.
SHARE = 50
SCALE = 1_000_000
# Occurrences and bytes that a task holds before it counts and hands on; rows it hands on at once.
HELD = 500_000
HELD_BYTES = 8 << 20
YIELDED = 100_000
MERGED = 200_000
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
U64 = np.uint64
COUNTS = "lang string, phrase string, c long"


def bits_at(hashes: np.ndarray, lang: np.ndarray | np.uint64) -> np.ndarray:
    """Places of phrases in a bitmap, by their hashes and those of their languages."""
    return (mix(hashes + lang) & U64(bitmaps.BITS - 1)).astype(np.int64)


def lang_hash(lang: str) -> np.uint64:
    return mix(np.array([zlib.crc32(lang.encode())], U64) + U64(1))[0]


def place_task(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            own = np.array([lang_hash(x) for x in langs.dictionary.to_pylist()], U64)[langs.indices.to_numpy()]
            words = buffer_hashes(b"\n".join(batch.column(1).cast(pa.binary()).to_pylist()))[1].reshape(-1, order)
            yield pa.RecordBatch.from_arrays([pa.array(bits_at(together([words[:, k] for k in range(order)]), own))], names=["at"])

    return run


def bitmap(phrases: DataFrame, order: int) -> np.ndarray:
    """The bits of ``phrases`` (lang, phrase), all of ``order`` words."""
    return bitmaps.built(phrases.select("lang", "phrase").mapInArrow(place_task(order), "at long"), F.col("at"))


def together(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of the phrases whose first, second, ... words have these hashes."""
    out = words[0]
    for word in words[1:]:
        out = out * STEP + word
    return mix(out + U64(len(words)))


class Located:
    """The words of a lower-case buffer, whose gaps are spaces and, between pieces, line feeds."""

    def __init__(self, data: bytes):
        starts, hashes, offset = [], [], 0
        for part in cuts(data, GROUP_BYTES) if len(data) > 2 * GROUP_BYTES else [data]:
            start, found = buffer_hashes(part)
            starts.append(start + offset)
            hashes.append(found)
            offset += len(part)
        raw = np.frombuffer(data, np.uint8)
        gaps = np.append(np.flatnonzero((raw == 0x20) | (raw == 0x0A)), len(raw))
        self.start, self.hashes = np.concatenate(starts), np.concatenate(hashes)
        self.end = gaps[np.searchsorted(gaps, self.start)]
        self.piece = np.searchsorted(np.flatnonzero(raw == 0x0A), self.start)

    def phrases(self, order: int, heads: np.ndarray | None, tails: np.ndarray | None, lang: np.uint64) -> tuple[np.ndarray, ...]:
        """Hash, start, end and whether single spaces part it, of each phrase whose first words are in ``heads`` and last ones in ``tails``."""
        n = max(0, len(self.start) - order + 1)
        first, last = np.arange(n), np.arange(order - 1, order - 1 + n)
        keep = self.piece[first] == self.piece[last]
        of = lambda size: together([self.hashes[k : len(self.hashes) - size + 1 + k] for k in range(size)])
        if order > 1 and n:
            at = bits_at(of(order - 1), lang)
            keep &= bitmaps.at_places(heads, at[:-1])
            keep[keep] = bitmaps.at_places(tails, at[1:][keep])
        first, last = first[keep], last[keep]
        plain = np.ones(len(first), dtype=bool)
        for k in range(order - 1):
            plain &= self.start[first + k + 1] - self.end[first + k] == 1
        return (of(order)[keep] if n else np.empty(0, U64)), self.start[first], self.end[last], plain


class Held:
    """Occurrences of one language that wait to be counted, with the buffers that hold them."""

    def __init__(self) -> None:
        self.buffers: list[bytes] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.bytes = self.rows = 0

    def add(self, data: bytes, found: tuple[np.ndarray, ...]) -> None:
        hashes, start, end, plain = found
        if len(hashes):
            self.found.append((hashes, start + self.bytes, end + self.bytes, plain))
            self.buffers.append(data)
            self.bytes += len(data)
            self.rows += len(hashes)

    def counted(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The distinct phrases with their counts. Within what is held, phrases are told apart by their hashes of 64 bits."""
        if not self.rows:
            return
        raw = np.frombuffer(b"".join(self.buffers), np.uint8)
        hashes, start, end, plain = (np.concatenate(x) for x in zip(*self.found))
        self.buffers, self.found = [], []
        _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        del hashes
        for begin in range(0, len(first), YIELDED):
            own, often = first[begin : begin + YIELDED], counts[begin : begin + YIELDED]
            for rows, number in ((own[plain[own]], often[plain[own]]), (own[~plain[own]], often[~plain[own]])):
                if not len(rows):
                    continue
                if plain[rows[0]]:
                    size = end[rows] - start[rows]
                    offsets = np.append(0, np.cumsum(size))
                    letters = raw[np.repeat(start[rows] - offsets[:-1], size) + np.arange(offsets[-1])]
                    phrases = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
                else:
                    phrases = pa.array([b" ".join(raw[start[i] : end[i]].tobytes().split()) for i in rows], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), phrases, pa.array(number, pa.int64())], names=["lang", "phrase", "c"])


def count_task(order: int, heads: np.ndarray | None, tails: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts are joined to buffers of about GROUP_BYTES for each language; a longer text is a buffer of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        lengths: dict[str, int] = {}
        held: dict[str, Held] = {}
        size = 0

        def locate(lang: str) -> None:
            data = b"\n".join(waiting.pop(lang))
            lengths.pop(lang)
            if data:
                held.setdefault(lang, Held()).add(data, Located(data).phrases(order, heads, tails, lang_hash(lang)))

        for batch in batches:
            for at in range(batch.num_rows):
                lang, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py().encode().translate(FOLD)
                own = waiting.setdefault(lang, [])
                own.append(text)
                size += len(text) + 1
                lengths[lang] = lengths.get(lang, 0) + len(text)
                if lengths[lang] >= GROUP_BYTES:
                    locate(lang)
                if size >= HELD_BYTES or sum(h.rows for h in held.values()) >= HELD:
                    for name in list(waiting):
                        locate(name)
                    for name, full in held.items():
                        yield from full.counted(name)
                    held.clear()
                    size = 0
        for name in list(waiting):
            locate(name)
        for name, full in held.items():
            yield from full.counted(name)

    return run


def counted(texts: DataFrame, order: int, heads: np.ndarray | None = None, tails: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, c): how often each phrase of ``order`` words occurs, if its first and last words have their bits."""
    return texts.mapInArrow(count_task(order, heads, tails), COUNTS).groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def before_last(phrase: str) -> Column:
    return F.expr(f"substr({phrase}, 1, length({phrase}) - length(substring_index({phrase}, ' ', -1)) - 1)")


def after_first(phrase: str) -> Column:
    return F.expr(f"substr({phrase}, length(substring_index({phrase}, ' ', 1)) + 2)")


def score_of(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) by decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)").cast("decimal(38,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(SCALE).cast("decimal(38,0)"), wide(l) * wide(r)).cast("long")


def with_counts(rows: DataFrame, counts: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds ``name``, the count of ``key`` in the row's language."""
    own = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("c").alias(name))
    keyed = rows.withColumn("_key", key)
    return keyed.join(own, (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col("_phrase"))).drop("_lang", "_phrase", "_key")


def floors(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(lang, floor): the highest score that ``rank`` pairs of the language reach; 0 where there are fewer.

    Scores are whole numbers up to SCALE, so a language's histogram is bounded.
    """
    steps = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upward = Window.partitionBy("lang").orderBy(F.desc("score"))
    reached = steps.withColumn("n", F.sum("n").over(upward)).join(ranks, "lang").where(F.col("n") >= F.col("rank"))
    return ranks.select("lang").join(reached.groupBy("lang").agg(F.max("score").alias("floor")), "lang", "left").select("lang", F.coalesce("floor", F.lit(0)).alias("floor"))


def frontier(pairs: DataFrame, floor: DataFrame) -> DataFrame:
    """(lang, phrase): the prefixes below which a phrase could reach the floor or make a pair above it fall."""
    own = pairs.join(F.broadcast(floor) if floor.count() <= 10_000 else floor, "lang")
    # The smallest count above the floor of the pairs that begin with a word.
    least = own.where(F.col("score") >= F.col("floor")).groupBy("lang", F.substring_index("phrase", " ", 1).alias("w")).agg(F.min("c").alias("m"))
    bounded = own.where(F.col("bound") >= F.col("floor")).select("lang", "phrase")
    ends = own.select("lang", "phrase", "c", F.substring_index("phrase", " ", -1).alias("w"))
    holding = ends.join(least, ["lang", "w"]).where(100 * F.col("c") >= SHARE * F.col("m")).select("lang", "phrase")
    return bounded.unionByName(holding).distinct()


def scored_pairs(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds l, r, score and the bound of what grows from each pair."""
    first = with_counts(pairs, words, F.substring_index("phrase", " ", 1), "l")
    whole = with_counts(first, words, F.substring_index("phrase", " ", -1), "r")
    bound = F.call_function("div", F.col("c").cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(38,0)"), F.col("l").cast("decimal(38,0)")).cast("long")
    return whole.select("lang", "phrase", "c", "l", "r", score_of(F.col("c"), F.col("l"), F.col("r")).alias("score"), bound.alias("bound"))


def scored_triples(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut of each phrase of three words; of equal ones the first."""
    rows = with_counts(triples, words, F.substring_index("phrase", " ", 1), "l1")
    rows = with_counts(rows, pairs, after_first("phrase"), "r1")
    rows = with_counts(rows, pairs, before_last("phrase"), "l2")
    rows = with_counts(rows, words, F.substring_index("phrase", " ", -1), "r2")
    cut = lambda k: F.struct(score_of(F.col("c"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    return rows.select("lang", "phrase", "c", F.least(cut(1), cut(2)).alias("_cut")).select("lang", "phrase", "c", "_cut.l", "_cut.r", "_cut.score")


def survivors(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """The phrases that lie in no longer one of enough count: all ``triples``, and the pairs left of ``pairs``."""
    longer = triples.select("lang", F.explode(F.array(before_last("phrase"), after_first("phrase"))).alias("phrase"), "c")
    longest = longer.groupBy("lang", "phrase").agg(F.max("c").alias("_most"))
    left = pairs.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_most") < SHARE * F.col("c"), F.lit(True)))
    columns = ["lang", "phrase", "c", "l", "r", "score"]
    return triples.select(columns).unionByName(left.select(columns))


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """Adds ``rank`` and keeps each language's first ``top``: first those of its slices, then those of all slices."""
    order = [F.desc("score"), F.desc("c"), F.asc("phrase")]
    slices = max(1, -(-rows.count() // MERGED))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    near = sliced.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_n") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).drop("_slice", "_n")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best ``top`` phrases of two and three words.

    a: occurrences of the phrase, l and r: those of the two parts of its lowest-scoring cut, n: all words of the language.
    """
    texts = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    all_words = stored(counted(texts, 1), "words")
    words = all_words.where(F.col("c") >= least)
    frequent = bitmap(words, 1)
    counts = stored(counted(texts, 2, frequent, frequent).where(F.col("c") >= least), "pairs")
    pairs = stored(scored_pairs(words, counts), "scored")
    tails = bitmap(pairs, 2)

    ranks = stored(pairs.groupBy("lang").agg(F.lit(2 * top).cast("long").alias("rank")), "ranks")
    expanded = triples = None
    while True:
        floor = stored(floors(pairs, ranks), "floors")
        fresh = frontier(pairs, floor)
        fresh = stored(fresh if expanded is None else fresh.join(expanded, ["lang", "phrase"], "left_anti"), "frontier")
        found = counted(texts, 3, bitmap(fresh, 2), tails).where(F.col("c") >= least).withColumn("_head", before_last("phrase"))
        # Bits of the frontier that other prefixes share are not part of it.
        found = found.join(fresh.select("lang", F.col("phrase").alias("_head")), ["lang", "_head"], "left_semi").drop("_head")
        found = stored(scored_triples(words, counts, found), "triples")
        triples = found if triples is None else triples.unionByName(found)
        expanded = fresh if expanded is None else expanded.unionByName(fresh)
        known = floor.join(pairs, "lang").where(F.col("score") >= F.col("floor")).select(pairs.columns)
        alive = survivors(known, triples).join(floor, "lang").where(F.col("score") >= F.col("floor"))
        alive = stored(alive.drop("floor"), "survivors")
        enough = floor.join(alive.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "lang", "left").where((F.coalesce("_n", F.lit(0)) < top) & (F.col("floor") > 0))
        again = stored(ranks.join(enough.select("lang", F.lit(True).alias("_open")), "lang", "left"), "ranks")
        if again.where("_open").isEmpty():
            break
        ranks = again.select("lang", F.when(F.col("_open"), 2 * F.col("rank")).otherwise(F.col("rank")).alias("rank"))
    sizes = all_words.groupBy("lang").agg(F.sum("c").alias("n"))
    best = first_of_each(alive, top).join(sizes, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("c").alias("a"), "l", "r", "n", "score")
