"""b-bit MinHash links against all pairs, with hot groups and groups of several blocks."""

import random

import numpy as np
import pytest

from updraft.llm import minhash_links
from updraft.llm.words import mix

from .test_search import copies, linked


def answer(frame, **settings):
    rows = minhash_links.link(frame, **settings).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return {tuple(r)[:3] for r in rows}


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, {"bucket_members": 7, "block_weight": 300})])
def test_links_equal_all_pairs(spark, seed, settings):
    docs = copies(seed)
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n int, bits string")
    assert answer(frame, **settings) == linked(docs, 2, 80)


def test_chains_across_blocks(spark):
    """Each text is like the next one only, so that one component spans every block."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[3 * i : 3 * i + 40])) for i in range(120)]
    random.Random(3).shuffle(docs)
    docs += [(1000 + i, t) for i, t in docs[:40]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert answer(frame, bucket_members=5, block_weight=400) == linked(docs, 2, 80)


def test_odd_and_no_documents(spark, odd, none):
    got = minhash_links.link(odd).collect()
    assert len(got) == odd.count() and minhash_links.link(none).count() == 0
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by_id[5] == (9, 5, True) and by_id[6] == (9, 5, False) and by_id[1] == (0, 1, True) and by_id[None] == (4, None, None) and by_id[8] == (1, 8, True)
    two = spark.createDataFrame([(1, "a b c d"), (1, "x y z"), (2, "x y z"), (3, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in minhash_links.link(two).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_estimates_are_corrected_and_seldom_miss():
    rng = np.random.default_rng(5)
    pools = mix(rng.integers(0, 1 << 62, (300, 1000)).astype(np.uint64))
    errors, missed = [], 0
    for pool in pools:
        common, own = pool[:800], pool[800:]
        sets = [np.unique(np.concatenate([common, own[:100]])), np.unique(np.concatenate([common, own[100:]]))]
        least = minhash_links.minima(np.concatenate(sets), np.cumsum([0, len(sets[0])]))
        bits, keys = minhash_links.packed_bits(least), minhash_links.band_keys(least)
        low = least & 3
        agree = minhash_links.agreeing(bits[0], bits[1:])
        assert agree[0] == (low[:, 0] == low[:, 1]).sum()
        errors.append(minhash_links.estimated(agree)[0] - 0.8)
        missed += not (keys[0] == keys[1]).any() or minhash_links.estimated(agree)[0] < minhash_links.least_estimate(80)
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.035 and missed == 0
