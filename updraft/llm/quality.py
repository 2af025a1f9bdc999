"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of the character n-grams of
each word with its boundaries; words and n-grams are hashed into one table, and a word that
repeats the one before it adds a token of its own. A linear
layer and a softmax give the probability of each label. Vectors and layer are trained
together by stochastic gradient descent in numpy, in small batches of labelled
documents, with a linearly falling step. The training rows are a bounded sample: the ``train_rows`` labelled
rows with the smallest hash of their id; they reach the trainer as counted buckets.

Scoring needs only each bucket's share of the label difference, one number for each
bucket, since the average is linear: the model sent to the executors is ``2 ** bits`` floats.
Every text is read whole, in pieces cut between words, so memory does not follow its
length; a single word beyond a piece counts as several.

NULL and empty texts score the bias alone; if no row is labelled, or all with one
label, everything scores that share (0.5 without labels). Repeated rows each get their
score; a document with several labels trains on each. Label rows without text or label
are left out. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.llm.words import powers

TRAIN_ROWS = 3000
BITS = 17
DIMENSIONS = 12
GRAMS = (2, 3, 4)
EPOCHS = 6
LEAST_VISITS = 12_000
STEP = 0.5
BATCH = 16
ACCEPT = 0.7
PIECE = 1 << 18
U64 = np.uint64
SPREAD = U64(0x9E3779B97F4A7C15)
REPEAT = U64(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(0x3001, dtype=bool)
SPACE[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def code_points(text: str) -> np.ndarray:
    """Code points with every white space as 0x20, and one at each end."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    gap = SPACE[np.minimum(points, 0x2FFF)] | (points == 0x3000)
    return np.where(gap, np.uint32(0x20), points)


def features(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words, repeats and n-grams of each length: bucket, whether it counts, and a place inside it."""
    gap = points == 0x20
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    edge = np.diff(gap.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    shift = U64(64 - bits)
    word = (sums[end] - sums[start]) * down[start] * SPREAD
    yield word >> shift, np.ones(len(start), bool), start
    # A word that follows itself after a single space is the token REPEAT besides.
    again = np.flatnonzero((word[1:] == word[:-1]) & (start[1:] - end[:-1] == 1)) + 1
    yield np.full(len(again), REPEAT >> shift), np.ones(len(again), bool), start[again]
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        # An end may be the word's boundary; inner characters may not.
        if n == 2:
            counts = ~(gap[:-1] & gap[1:])
        else:
            counts = ~gap[1 : m + 1]
            for j in range(2, n - 1):
                counts &= ~gap[j : m + j]
        yield ((sums[n:] - sums[:-n]) * down[:m] * (SPREAD + U64(2 * n))) >> shift, counts, np.arange(m)


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        to = text.rfind(" ", at + PIECE // 2, at + PIECE)
        to = at + PIECE if to < 0 else to
        yield text[at:to]
        at = to
    yield text[at:]


def bucket_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the text and how often each occurs."""
    total = [np.empty(0, np.int64)]
    for piece in pieces(text):
        total += [found[counts].astype(np.int64) for found, counts, _ in features(code_points(piece), bits)]
    found, counts = np.unique(np.concatenate(total), return_counts=True)
    return found.astype(np.int32), counts.astype(np.float32)


@dataclass
class Model:
    """``weight[b]`` is what one occurrence of bucket b adds before averaging."""

    weight: np.ndarray
    bias: float

    def probability(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        margin = self.bias + sums / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dimensions: int = DIMENSIONS,
    epochs: int = EPOCHS, step: float = STEP, batch: int = BATCH, seed: int = 1,
) -> Model:
    """``rows``: buckets, their counts and the label (0 or 1) of each document."""
    positive = sum(label for _, _, label in rows)
    if not 0 < positive < len(rows):
        share = 0.5 if not rows else (1 - 1e-6 if positive else 1e-6)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    layer = rng.uniform(-0.1, 0.1, (dimensions, 2)).astype(np.float32)
    bias = np.log(np.array([len(rows) - positive, positive], np.float32) / len(rows))
    shares = [c / max(c.sum(), 1) for _, c, _ in rows]
    # Few rows are gone through more often.
    epochs = max(epochs, -(-LEAST_VISITS // len(rows)))
    total, done = epochs * len(rows), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            rate = step * (1 - done / total)
            hidden = np.stack([shares[i] @ vectors[rows[i][0]] if len(rows[i][0]) else np.zeros(dimensions, np.float32) for i in chosen])
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), [rows[i][2] for i in chosen]] -= 1
            back = p @ layer.T
            layer -= rate * hidden.T @ p / len(chosen) * 8
            bias -= rate * p.mean(axis=0)
            for i, gradient in zip(chosen, back):
                # Averages over hundreds of buckets move each vector little; the step is scaled by the document's buckets.
                vectors[rows[i][0]] -= (rate * np.sqrt(len(rows[i][0]) + 1) * shares[i])[:, None] * gradient
            done += len(chosen)
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def counted_rows(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found, counts = bucket_counts(text.as_py() or "", bits)
                yield pa.RecordBatch.from_pydict({
                    "found": pa.array([found.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
                    "label": pa.array([label], pa.int32()),
                })

    return run


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The sample, gathered on the driver: ``train_rows`` rows of at most ``2 ** bits`` counts each."""
    chosen = (
        labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & usable)
        .select(F.col(id).alias("_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "label").limit(train_rows)
    )
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    # At most train_rows ids.
    joined = texts.join(F.broadcast(chosen), "_id").select("_text", "label", "_id")
    counted = joined.select("_text", "label").mapInArrow(counted_rows(bits), "found binary, counts binary, label int").collect()
    rows = [(np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.float32), r["label"]) for r in counted]
    return sorted(rows, key=lambda r: (len(r[0]), r[2], r[0].tobytes()))


def group_sums(texts: list[str], weight: np.ndarray) -> np.ndarray:
    """For each text the sum of its features' weights and their number, from one scan of all."""
    points = [code_points(t) for t in texts]
    begin = np.cumsum([0, *map(len, points)])[:-1]
    out = np.zeros((2, len(texts)))
    # Two spaces part two texts, so no word or n-gram spans them.
    for found, counts, place in features(np.concatenate(points), len(weight).bit_length() - 1):
        if len(place) == 0:
            continue
        if place[-1] != len(place) - 1:
            text = np.searchsorted(begin, place, side="right") - 1
            out[0] += np.bincount(text, weights=weight[found], minlength=len(texts))
            out[1] += np.bincount(text, minlength=len(texts))
        else:
            # Every text holds two places at least, so begins ascend and lie inside.
            at = np.minimum(begin, len(found) - 1)
            out[0] += np.add.reduceat(weight[found] * counts, at, dtype=np.float64)
            out[1] += np.add.reduceat(counts, at, dtype=np.int64)
    return out


def score_rows(weight: np.ndarray, bias: float, text: int, least: float | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the text, column number ``text``, by its score; with ``least``, gives the rows that reach it instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weight, bias)
        for batch in batches:
            out = np.zeros((2, batch.num_rows))
            group: list[tuple[int, str]] = []

            def flush() -> None:
                if group:
                    np.add.at(out, (slice(None), [i for i, _ in group]), group_sums([t for _, t in group], weight))
                    group.clear()

            size = 0
            for i, body in enumerate(batch.column(text)):
                for piece in pieces(body.as_py() or ""):
                    group.append((i, piece))
                    size += len(piece) + 2
                    if size >= PIECE:
                        flush()
                        size = 0
            flush()
            score = model.probability(*out)
            if least is None:
                yield batch.set_column(text, "score", pa.array(score, pa.float64()))
            else:
                yield batch.filter(pa.array(score >= least))

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, **settings) -> Model:
    """``usable``: which label rows may be learned from, as a condition on the label table."""
    named = {k: settings.pop(k) for k in ("id", "text", "label", "train_rows", "bits") if k in settings}
    return train(training_rows(docs, labels, usable, **named), bits=named.get("bits", BITS), **settings)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): the probability of label 1 for every row of ``docs``."""
    kept = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("score"))
    return kept.mapInArrow(score_rows(model.weight, model.bias, 1), "_id long, score double").select(F.col("_id").alias(id), "score")


def accept(docs: DataFrame, model: Model, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their own columns only."""
    names = docs.columns
    packed = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    return packed.mapInArrow(score_rows(model.weight, model.bias, names.index(text), least), packed.schema).toDF(*names)
