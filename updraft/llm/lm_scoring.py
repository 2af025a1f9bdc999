"""Language-model scores from an n-gram trie of Elias-Fano levels (``elias_fano``).

The model interpolates bigrams with smoothed unigrams:
p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
Words are lower-case runs of non-spaces; each text ends with one end token, which is also
what the first word follows. Everything is counted over all training texts.

Every word has its own bigrams, however rare. No count is kept in one place beyond a bounded
table: the words of the largest counts, at most ``broadcast`` of them, have numbers and are broadcast. All
others go by their 64-bit hashes and are numbered inside each shard; their counts reach the shards that ask
for them by a join. Bigrams are
sharded by their first word, the most frequent first words by their second as well. A task of the second stage
holds the occurrences of one shard: from the training ones it builds the shard's trie, and it
looks up each distinct bigram of all texts in it. What moves grows with the text, as packed
columns of occurrences, and a shard holds about ``shard_tokens`` of them.

A smaller model can be asked for: with ``dictionary``, words beyond that many form one class, within which
a word has its unigram share.

Scores are sums of log10 probabilities, each quantised to 1/2048, so they do not depend on the
sharding. NULL and empty
texts hold the end token alone. Rows keep their number: equal rows share one
score. Without training texts p(w) is that of an unknown word. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.llm.elias_fano import QUANTUM, Trie, quantised
from updraft.llm.tables import stored
from updraft.llm.words import mix, scan

BROADCAST_WORDS = 1 << 18
SHARD_TOKENS = 2_000_000
GATHERED = 1_000_000
LOOKED_UP = 1 << 18
MU = 4.0
OTHER, END, FIRST = 0, 1, 2
U64 = np.uint64
COUNTS = "h long, c long"
TEXTS = "key long, n_tokens long, known long, base double, other array<long>, shards array<long>"
BLOBS = "shard long, blob binary, rare binary, h long, c long"
PARTIAL = "bucket long, sums binary"
SUMS = "key long, quanta long"


@dataclass
class Dictionary:
    """Frequent words by hash, and the counts of all: by number, those of the class OTHER and of the end included.

    Where ``merged``, all words without a number are that class; else each is known by its hash.
    """

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    other_types: int
    merged: bool

    @property
    def size(self) -> int:
        return len(self.counts)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], OTHER)

    def identities(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; for a word without one its hash, which is ``size`` or more, or OTHER where merged."""
        numbers = self.number(hashes)
        return numbers.astype(U64) if self.merged else np.where(numbers == OTHER, hashes, numbers.astype(U64))

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def unigram(self) -> np.ndarray:
        """Probability by number; the class has the mass of all its words, the unknown one included."""
        mass = self.counts + 0.5
        mass[OTHER] = self.counts[OTHER] + 0.5 * (self.other_types + 1)
        return mass / self.denominator


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["h", "c"])

    for batch in batches:
        for _, _, hashes in scan(batch.column(0)):
            held.append(hashes)
            if sum(map(len, held)) > GATHERED:
                yield counted()
    if held:
        yield counted()


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words: all with a count that at most ``most`` words reach."""
    steps = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c"))
    least, total = None, 0
    for row in steps.toLocalIterator():
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    if least is None:
        return np.empty(0, U64), np.empty(0, np.int64)
    table = counts.where(F.col("c") >= least).toArrow()
    return table["h"].to_numpy().view(U64), table["c"].to_numpy()


def dictionary_of(counts: DataFrame, ends: int, most: int, merged: bool) -> Dictionary:
    hashes, own = frequent(counts, most)
    order = np.argsort(hashes)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("v")).first()
    by_number = np.concatenate([[total["c"] - own.sum(), ends], own[order]]).astype(np.int64)
    numbers = np.arange(FIRST, FIRST + len(own))
    return Dictionary(hashes[order], numbers, by_number, total["c"] + ends, total["v"] + (ends > 0), total["v"] - len(own), merged)


def lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, pa.int64()))


def text_rows(words: Dictionary, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a text's own words give: tokens, those in the dictionary, their part of the base score, and the other words
    with the shards of the bigrams that end in them."""
    parts = spread(words, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log10 = np.log10(words.unigram())
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, other, asked = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), [], []
            for first, counts, hashes in scan(batch.column(1)):
                numbers = words.number(hashes)
                inside = numbers != OTHER
                here = np.repeat(np.arange(len(counts)), counts)
                part = slice(first, first + len(counts))
                tokens[part] = counts + 1
                known[part] = np.bincount(here[inside], minlength=len(counts)) + (words.counts[END] > 0)
                base[part] = np.bincount(here[inside], weights=log10[numbers[inside]], minlength=len(counts)) + log10[END]
                before, word, text = bigrams(words.identities(hashes), counts)
                before = before[np.diff(text, append=-1) == 0]
                edges = np.cumsum(np.bincount(here[~inside], minlength=len(counts)))[:-1]
                other += np.split(hashes[~inside].view(np.int64), edges)
                asked += np.split(shard_of(before[~inside], words.identities(hashes[~inside]), parts, shards), edges)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens), pa.array(known), pa.array(base), lists(other), lists(asked)],
                names=["key", "n_tokens", "known", "base", "other", "shards"],
            )

    return run


def planes(values: np.ndarray) -> bytes:
    """The bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8)[: n * size].reshape(size, n).T).view(kind).ravel()


def bigrams(identities: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, second word and text of each bigram. Each text: its words, then the end; before the first word stands an end."""
    ends = np.cumsum(sizes + 1)
    word = np.full(ends[-1], END, U64)
    inner = np.ones(ends[-1], dtype=bool)
    inner[ends - 1] = False
    word[inner] = identities
    return np.concatenate([np.array([END], U64), word[:-1]]), word, np.repeat(np.arange(len(sizes)), sizes + 1)


def pack_occurrences(
    keys: np.ndarray, training: np.ndarray, text: np.ndarray, before: np.ndarray, word: np.ndarray, size: int
) -> tuple[bytes, bytes]:
    """Occurrences of one shard, sorted by bigram, with the keys of the texts they come from; and the hashes of its rare words.

    A word of ``size`` or more is a hash; it is packed as ``size`` plus its place among those hashes.
    """
    rare = np.unique(np.concatenate([before[before >= size], word[word >= size]]))
    before, word = (np.where(x >= size, size + np.searchsorted(rare, x), x).astype(np.int64) for x in (before, word))
    order = np.lexsort((text, word, before))
    before, word, text = before[order], word[order], text[order]
    # A bigram counts once for each text that holds it, with its number there.
    fresh = np.flatnonzero((np.diff(before, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    times = np.diff(np.append(fresh, len(order)))
    used, local = np.unique(text[fresh], return_inverse=True)
    steps = np.diff(before[fresh], prepend=0)
    parts = [
        np.array([len(fresh), len(used)], np.int64).tobytes(), keys[used].tobytes(), training[used].astype(np.uint8).tobytes(),
        *(planes(x.astype(np.uint32)) for x in (steps, word[fresh], local, times)),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts)), rare.tobytes()


def unpack_occurrences(blob: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, used = np.frombuffer(data[:16], np.int64)
    keys = np.frombuffer(data[16 : 16 + 8 * used], np.int64)
    at = 16 + 8 * used
    training = np.frombuffer(data[at : at + used], np.uint8)
    at += used
    steps, word, local, times = (unplanes(data[at + i * 4 * n : at + (i + 1) * 4 * n], np.uint32, n) for i in range(4))
    return keys, training, local, np.cumsum(steps, dtype=np.int64), word, times


def spread(words: Dictionary, shards: int) -> np.ndarray:
    """By number: over how many shards the bigrams that begin with it are dealt."""
    return 1 + words.counts * shards // max(1, words.tokens)


def shard_of(before: np.ndarray, word: np.ndarray, parts: np.ndarray, shards: int) -> np.ndarray:
    """Words by identity; one without a number is too rare to be dealt over several shards."""
    dealt = np.where(before < len(parts), parts[np.minimum(before, len(parts) - 1).astype(np.int64)], 1).astype(U64)
    return ((mix(before + U64(1 << 33)) + mix(word + U64(1)) % dealt) % U64(shards)).astype(np.int64)


def occurrence_blobs(words: Dictionary, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts = spread(words, shards)

    def blobs(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, training, sizes, identities = (np.concatenate(x) for x in zip(*held))
        before, word, text = bigrams(identities, sizes)
        shard = shard_of(before, word, parts, shards)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for rows in np.split(order, edges[1:]):
            blob, rare = pack_occurrences(keys, training, text[rows], before[rows], word[rows], words.size)
            none = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard[rows[0]]], pa.int64()), pa.array([blob], pa.binary()), pa.array([rare], pa.binary()), none, none],
                names=["shard", "blob", "rare", "h", "c"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            training = batch.column(2).to_numpy(zero_copy_only=False)
            for first, counts, hashes in scan(batch.column(1)):
                part = slice(first, first + len(counts))
                held.append((keys[part], training[part], counts, words.identities(hashes)))
                size += len(hashes) + len(counts)
                if size > GATHERED:
                    yield from blobs(held)
                    held, size = [], 0
        if held:
            yield from blobs(held)

    return run


def shard_trie(before: np.ndarray, word: np.ndarray, counts: np.ndarray, unigram: np.ndarray, totals: np.ndarray) -> Trie:
    """Trie of the distinct bigrams, sorted, with their smoothed probabilities."""
    contexts = np.unique(before)
    p = (counts + MU * unigram[word]) / (totals[before] + MU)
    return Trie.of(
        [contexts[:, None], np.stack([before, word], axis=1)], [np.log10(unigram[contexts]), np.log10(p)], len(unigram)
    ).mapped()


def emptied(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list gives them up."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def score_shard(words: Dictionary, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """For each text of a shard's occurrences the sum of their log10 probabilities, packed by buckets of texts.

    Rows without occurrences hold the counts of the rare words that end bigrams of the shard.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, training, text, times, bigram, shift = [], [], [], [], [], 0
        packed = np.flatnonzero(table["blob"].is_valid().to_numpy())
        own_rare = [np.frombuffer(table["rare"][int(i)].as_py(), U64) for i in packed]
        rare = np.unique(np.concatenate(own_rare))
        vocabulary = words.size + len(rare)
        for i, hashes in zip(packed, own_rare):
            own, learned, local, before, word, often = unpack_occurrences(table["blob"][int(i)].as_py())
            place = np.concatenate([np.arange(words.size), words.size + np.searchsorted(rare, hashes)])
            keys.append(own)
            training.append(learned)
            text.append((local + shift).astype(np.int32))
            times.append(often)
            bigram.append(place[before] * vocabulary + place[word])
            shift += len(own)
        keys, training, text, times, bigram = map(emptied, (keys, training, text, times, bigram))
        order = np.argsort(bigram)
        bigram, text, times = bigram[order], text[order], times[order]
        del order
        fresh = np.flatnonzero(np.diff(bigram, prepend=-1))
        before, word = np.divmod(bigram[fresh], vocabulary)
        sizes = np.diff(np.append(fresh, len(bigram)))
        del bigram
        seen = np.add.reduceat(training[text] * times, fresh, dtype=np.int64)
        # A rare word's bigrams are all in this shard, so its count as a first word is their sum.
        totals = np.concatenate([words.counts, np.bincount(before, weights=seen, minlength=vocabulary)[words.size :]])
        counted = table.select(["h", "c"]).filter(table["h"].is_valid())
        own = np.zeros(len(rare))
        own[np.searchsorted(rare, counted["h"].to_numpy().view(U64))] = counted["c"].to_numpy()
        unigram = np.concatenate([words.unigram(), (own + 0.5) / words.denominator])
        # Without a bigram's count the model falls back to the context's share of the unigram.
        quanta = quantised(np.log10(MU * unigram[word] / (totals[before] + MU))).astype(np.int64)
        learned = seen > 0
        if learned.any():
            trie = shard_trie(before[learned], word[learned], seen[learned], unigram, totals)
            contexts, each = np.unique(before, return_inverse=True)
            parent = trie.child(0, np.zeros(len(contexts), np.int64), contexts)
            for begin in range(0, len(word), LOOKED_UP):
                part = slice(begin, begin + LOOKED_UP)
                at = trie.child(1, parent[each[part]], word[part])
                quanta[part][at >= 0] = trie.quanta(2, at[at >= 0])
        sums = np.bincount(text, weights=np.repeat(quanta, sizes) * times, minlength=len(keys)).astype(np.int64)
        bucket = (mix(keys.view(U64)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        return pa.table({
            "bucket": pa.array([bucket[p[0]] for p in parts], pa.int64()),
            "sums": pa.array([keys[p].tobytes() + sums[p].tobytes() for p in parts], pa.binary()),
        })

    return run


def add_up(table: pa.Table) -> pa.Table:
    """The sums of each text of a bucket over all shards, in quanta."""
    halves = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table["sums"].to_pylist()]
    keys, sums = np.concatenate(halves, axis=1)
    order = np.argsort(keys)
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] - 1))
    return pa.table({"key": keys[order][first], "quanta": np.add.reduceat(sums[order], first)})


def score(
    docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text",
    dictionary: int | None = None, shard_tokens: int = SHARD_TOKENS, broadcast: int = BROADCAST_WORDS,
) -> DataFrame:
    """Scores of every row, by a model of the rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    ``held_out`` is a condition on ``docs``; NULL counts as false. ``broadcast`` decides where counts
    lie, not what the model learns; ``dictionary`` merges all words beyond so many into a class.
    """
    body = F.col(text).cast("string")
    rows = docs.select(
        F.xxhash64(F.col(id), body).alias("key"), body.cast("binary").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("training"),
        F.col(id).cast("long").alias("doc_id"),
    )
    learned = rows.where("training")
    counts = stored(learned.select("text").mapInArrow(count_words, COUNTS).groupBy("h").agg(F.sum("c").alias("c")), "counts")
    merged = dictionary is not None
    words = dictionary_of(counts, learned.count(), dictionary if merged else broadcast, merged)
    shards = max(1, -(-words.tokens * 5 // 4 // shard_tokens))

    texts = stored(rows.select("key", "text").mapInArrow(text_rows(words, shards), TEXTS), "texts")
    blobs = rows.select("key", "text", "training").mapInArrow(occurrence_blobs(words, shards), BLOBS)
    if not merged:
        ends = texts.select(F.explode(F.arrays_zip("other", "shards")).alias("x")).select(F.col("x.shards").alias("shard"), F.col("x.other").alias("h")).distinct()
        none = F.lit(None).cast("binary")
        blobs = blobs.unionByName(ends.join(counts, "h").select("shard", none.alias("blob"), none.alias("rare"), "h", "c"))
    partial = blobs.groupBy("shard").applyInArrow(score_shard(words, shards), PARTIAL)
    sums = partial.groupBy("bucket").applyInArrow(add_up, SUMS).select("key", (F.col("quanta") * -QUANTUM).alias("log10"))

    # Words outside the dictionary: their unigram part by their count and, where they are merged, their share of the class.
    denominator = words.denominator
    of_class = float(words.unigram()[OTHER])
    mass = F.coalesce("c", F.lit(0)) + 0.5
    each = texts.select("key", F.explode("other").alias("h")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))
    looked = each.join(counts, "h", "left").select(
        "key", F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10(mass / denominator)).alias("base"), (F.col("n") * F.log10(mass / (denominator * of_class)) if merged else F.lit(0.0)).alias("log10"),
    )
    zero = F.lit(0.0)
    whole = (
        texts.select("key", "n_tokens", "known", "base", zero.alias("log10"), F.lit(1).alias("m"))
        .unionByName(looked.withColumn("m", F.lit(0)))
        .unionByName(sums.select("key", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("known"), zero.alias("base"), "log10", F.lit(0).alias("m")))
        .groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "log10", "m")))
    )
    ids = rows.select("doc_id", "key", (~F.col("training")).alias("held_out"))
    return ids.join(whole, "key").select(
        "doc_id", "held_out", F.expr("n_tokens div m").alias("n_tokens"), F.expr("known div m").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") / F.col("m")).alias("base_score"), (F.col("log10") / F.col("m")).alias("score"),
    )
