"""Top-k, the Jaccard join and the language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from updraft.llm import jaccard_join, lm_scoring, topk
from updraft.llm.elias_fano import EliasFano, Trie
from updraft.llm.queries import held_out_of
from updraft.llm.signature_tree import SignatureTree


def test_top_k_with_ties_and_unusable_vectors(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(400)]
    bad = [(1000, None), (1100, []), (1200, [1.0, None, 0.0, 0.0]), (1300, [float("nan")] * 4), (1400, [float("inf")] * 4), (None, [1.0] * 4)]
    vectors = topk.integer_vectors(spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows} | {1100: np.zeros(4, int)}
    want = set()
    for q in [*range(0, 400, 100), 1100]:
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:10]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    for blocks in ({}, {"query_block": 2, "candidate_block": 37}):
        assert {tuple(r) for r in topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, **blocks).collect()} == want
    few = vectors.where("vec_id < 3")
    assert topk.top_k(few.where("vec_id = 0"), few).count() == 2 and topk.top_k(few.limit(0), few).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def linked(docs, k, percent):
    sets = {}
    for i, text in docs:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def copies(seed):
    rnd, docs = random.Random(seed), [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one "), (6, "a b")]
    for group in range(5):
        base = [f"w{rnd.randrange(40)}" for _ in range(rnd.choice([3, 10, 12, 60, 150]))]
        for _ in range(rnd.choice([2, 20, 40])):
            words = list(base)
            for _ in range(rnd.randrange(2 + len(words) // 25)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(500)}"
            docs.append((100 * group + len(docs) + 10, " ".join(words)))
    return docs


@pytest.mark.parametrize("k,percent,block", [(3, 90, 2_000_000), (5, 80, 600)])
def test_join_equals_all_pairs(spark, k, percent, block):
    docs = copies(k)
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int")
    got = jaccard_join.link(frame, words=k, percent=percent, block_shingles=block)
    assert {tuple(r) for r in got.collect()} == linked(docs, k, percent)


def test_pivots_meet_in_rounds_of_bounded_tasks(spark, monkeypatch):
    # A chain of near copies, each 3 words from the last, whose ends have little in common.
    rnd = random.Random(4)
    words, docs = [f"w{i}" for i in range(90)], []
    for i in range(300):
        docs.append((rnd.randrange(10**6) * 300 + i, " ".join(words)))
        words[rnd.randrange(90)] = f"x{i}"
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    block, rounds, joined = 1600, [], jaccard_join.joined

    def noted(rows, *rest):
        tasks = {r["task"]: r["c"] for r in rows.join(sizes, "id").groupBy("task").agg(F.sum("n").alias("c")).collect()}
        if any(t.startswith("pivots/") for t in tasks):
            rounds.append(tasks)
        return joined(rows, *rest)

    sizes = frame.select(F.col("doc_id").alias("id"), F.lit(88).alias("n"))
    monkeypatch.setattr(jaccard_join, "joined", noted)
    got = jaccard_join.link(frame, words=3, percent=80, block_shingles=block)
    assert {tuple(r) for r in got.collect()} == linked(docs, 3, 80)
    assert len(rounds) > 1 and len(rounds[-1]) == 1
    assert all(len(b) <= -(-len(a) // 2) for a, b in zip(rounds, rounds[1:])) and all(max(a.values()) <= 2 * block for a in rounds)


def test_clusters_hold_no_documents_that_cannot_be_linked(spark):
    # Few words, so any two texts may share shingles by chance; every fifth text has a near copy, one phrase is in all short ones.
    rnd, docs = random.Random(7), []
    for i in range(300):
        words = [f"w{rnd.randrange(24)}" for _ in range(rnd.choice([16, 60, 200]))]
        words = "all of them".split() + words if len(words) == 16 else words
        docs.append((10 * i, " ".join(words)))
        if i % 5 == 0:
            docs.append((10 * i + 1, " ".join([*words, "end"])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    base = frame.selectExpr("doc_id AS id", "CAST(text AS binary) AS text").mapInArrow(jaccard_join.sketches(3, 90), jaccard_join.SKETCH).cache()
    found = {r["id"]: r["cluster"] for r in jaccard_join.clusters(base, 90).collect()}
    sizes = Counter(found.values())
    assert all(found[10 * i] == found[10 * i + 1] for i in range(0, 300, 5))
    # Before, nearly all texts were one cluster; now only the short ones are, which are tied by a frequent shingle.
    n = {r["id"]: r["n"] for r in base.collect()}
    assert all(max(n[i] for i in found if found[i] == c) < 30 or m < 10 for c, m in sizes.items())
    got = jaccard_join.link(frame, words=3, percent=90, block_shingles=400)
    assert {tuple(r) for r in got.collect()} == linked(docs, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_bound_of_common_shingles_from_prefixes(percent):
    rnd, out = np.random.default_rng(percent), 0
    for _ in range(400):
        pool = rnd.choice(1000, rnd.integers(2, 120), replace=False)
        a, b = (np.unique(np.concatenate([rnd.permutation(pool)[: rnd.integers(1, len(pool) + 1)], rnd.choice(1000, rnd.integers(0, 4))])) for _ in range(2))
        ends = (x[: jaccard_join.prefix_size(len(x), percent)] for x in (a, b))
        most = jaccard_join.most_common(next(ends), len(a), next(ends), len(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
        out += most < jaccard_join.least_overlap(len(a) + len(b), percent)
    assert out > 100


def test_join_of_odd_and_no_documents(spark, odd, none):
    got = sorted(((r[0] or 0, r[1], r[2]) for r in jaccard_join.link(odd, words=3, percent=90).collect()), key=str)
    assert len(got) == odd.count()
    assert {r for r in got if r[0] in (5, 6)} == {(5, 8, 5), (6, 8, 5)} and (1, 0, 1) in got
    kept = [r["doc_id"] for r in jaccard_join.representatives(odd, words=3, percent=90).collect()]
    assert 5 in kept and 6 not in kept and {1, 2, 3, None} <= set(kept)
    assert jaccard_join.link(none).count() == 0


def test_representatives_are_chosen_row_by_row(spark):
    t, u, v, w = (" ".join(f"{x}{i}" for i in range(12)) for x in "tuvw")
    rows = [(5, t), (5, t), (6, t), (None, t), (7, t), (7, u), (None, v), (None, v), (8, w), (8, w), (None, None), (None, None), (9, None), (9, None), (10, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _extra string")
    kept = jaccard_join.representatives(docs, words=3, percent=90)
    want = [(5, t), (7, u), (None, v), (8, w), (None, None), (None, None), (9, None), (10, " ")]
    assert kept.columns == docs.columns and sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(str(Row(doc_id=i, text=x)) for i, x in want)
    plain = docs.where("doc_id in (6, 10)").unionByName(docs.where("doc_id = 6").selectExpr("doc_id - 4 AS doc_id", "text", "_extra"))
    assert {r["doc_id"] for r in jaccard_join.representatives(plain, words=3, percent=90).collect()} == {2, 10}


@pytest.mark.parametrize("bits", [64, 1 << 13])
def test_tree_with_exact_and_with_shared_bits(monkeypatch, bits):
    monkeypatch.setattr("updraft.llm.signature_tree.MOST_BITS", bits)
    rnd = np.random.default_rng(bits)
    base = [rnd.choice(5000, rnd.integers(5, 200), replace=False) for _ in range(6)]
    sets = []
    for b in base * 12:
        s = b.copy()
        s[: rnd.integers(0, max(2, len(s) // 8))] += 10_000
        sets.append(np.unique(s).astype(np.uint64))
    want = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 90 * (len(sets[a]) + len(sets[b]) - o):
                x, y = want[a], want[b]
                want[want == max(x, y)] = min(x, y)
    assert (SignatureTree(sets).join(90, np.arange(len(sets))) == want).all()


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (100, 10**6), (900, 1000), (3000, 2**40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n))
    sequence, _ = EliasFano.view(memoryview(EliasFano.of(values, universe).to_bytes()))
    assert (sequence.access(np.arange(len(values))) == values).all()
    asked = rng.integers(0, universe, 500)
    at, equal = sequence.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_of_three_orders(tmp_path):
    rng = np.random.default_rng(3)
    three = np.unique(rng.integers(0, 20, (900, 3)), axis=0)
    grams = [np.arange(20)[:, None], np.unique(three[:, :2], axis=0), three]
    built = Trie.of(grams, [np.full(len(g), -float(k)) for k, g in enumerate(grams)], 20)
    (tmp_path / "trie").write_bytes(built.to_bytes())
    trie = Trie.view(memoryview(np.memmap(tmp_path / "trie", mode="r")))
    for k, g in enumerate(grams):
        assert (trie.find(g) == np.arange(len(g))).all() and (trie.quanta(k + 1, np.arange(len(g))) == 2048 * k).all()
    asked, places = rng.integers(0, 20, (2000, 3)), {tuple(g): i for i, g in enumerate(three.tolist())}
    assert trie.find(asked).tolist() == [places.get(tuple(g), -1) for g in asked.tolist()]


def model_scores(docs, most):
    tokens = {i: ["", *words_of(t), ""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count, pairs = Counter(), Counter()
    for i, t in tokens.items():
        count.update(t[1:] if not held[i] else [])
    n, v = sum(count.values()), len(count)
    steps, least, total = Counter(c for w, c in count.items() if w), math.inf, 0
    for c in sorted(steps, reverse=True):
        total += steps[c]
        if total > most:
            break
        least = c
    of = lambda w: w if not w or count[w] >= least else None
    classes = Counter()
    for w, c in count.items():
        classes[of(w)] += c
    others = sum(of(w) is None for w in count)
    p = lambda k: (classes[k] + 0.5 * ((others + 1) if k is None else 1)) / (n + 0.5 * (v + 1))
    for i, t in tokens.items():
        pairs.update(() if held[i] else zip(map(of, t), map(of, t[1:])))
    out = {}
    for i, t in tokens.items():
        base = [math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t[1:]]
        score = 0.0
        for a, b, own in zip(t, t[1:], base):
            x = (pairs[of(a), of(b)] + lm_scoring.MU * p(of(b))) / (classes[of(a)] + lm_scoring.MU)
            score += -round(-math.log10(x) * 2048) / 2048 + (own - math.log10(p(None)) if of(b) is None else 0)
        out[i] = (held[i], len(t) - 1, sum(count[w] > 0 for w in t[1:]), n, sum(base), score)
    return out


@pytest.mark.parametrize("most,shard", [(30, 300), (1 << 18, 4_000_000), (0, 1000)])
def test_language_model(spark, most, shard):
    rnd = random.Random(most)
    docs = [(i, " ".join(rnd.choice(["The", "the", "a", "of", f"w{rnd.randrange(80)}"]) for _ in range(rnd.randrange(60)))) for i in range(120)]
    docs += [(1000, None), (1001, "unseen Unseen " * 3)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, key string")
    got = {r["doc_id"]: tuple(r)[1:] for r in lm_scoring.score(frame, held_out_of(5, 1), dictionary=most, shard_tokens=shard).collect()}
    want = model_scores(docs, most)
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i][:4] == row[:4] and math.isclose(got[i][4], row[4], abs_tol=1e-9) and math.isclose(got[i][5], row[5], abs_tol=0.01)


@pytest.mark.parametrize("few,shard", [(30, 300), (0, 1000), (1 << 18, 300)])
def test_language_model_learns_bigrams_of_rare_words(spark, few, shard):
    rnd = random.Random(few)
    docs = [(i, " ".join(rnd.choice(["The", "the", "a", "of", f"w{rnd.randrange(80)}", f"once{i} twin{i % 40}"]) for _ in range(rnd.randrange(60)))) for i in range(120)]
    docs += [(1000, None), (1001, "unseen Unseen " * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in lm_scoring.score(frame, held_out_of(5, 1), shard_tokens=shard, broadcast=few).collect()}
    for i, row in model_scores(docs, math.inf).items():
        assert got[i][:4] == row[:4] and math.isclose(got[i][4], row[4], abs_tol=1e-9) and math.isclose(got[i][5], row[5], abs_tol=0.01)


def test_language_model_of_odd_and_no_documents(odd, none):
    rows = lm_scoring.score(odd, held_out_of(5, 1)).collect()
    assert len(rows) == odd.count() and len({tuple(r) for r in rows if r["doc_id"] == 6}) == 1
    assert lm_scoring.score(none, held_out_of(5, 1)).count() == 0
