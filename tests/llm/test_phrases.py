"""Phrase mining against brute force, with floors that need several rounds."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from updraft.llm import phrases


def brute(rows, top, least):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            w = re.findall("[^\\x20\\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        fallen = {q for p, c in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * c >= 50 * f[q]}
        rows = []
        for p, a in found.items():
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if p not in fallen:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out |= {(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}
    return out


@pytest.mark.parametrize("top,held", [(2000, 1_000_000), (3, 50), (12, 50)])
def test_mining_equals_brute_force(spark, monkeypatch, top, held):
    monkeypatch.setattr(phrases, "MERGED", 7)
    monkeypatch.setattr(phrases, "HELD", held)
    rnd = random.Random(top)
    stock = ["new york city", "the", "of the", "a b a b", "É té", "x\x1fy z", "big, apple", "one two three", "the end"]
    rows = [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choice([*stock, f"w{rnd.randrange(30)}", "New\tYork; city\n"]) for _ in range(rnd.randrange(90)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " .,"), ("fr", "one"), *rows[:10]]
    docs = spark.createDataFrame([(l, t, "x", 1) for l, t in rows], "lang string, text string, phrase string, c int")
    got = [tuple(r) for r in phrases.mine(docs, top=top, least=4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, top, 4)


def test_wrong_bits_cost_nothing_but_time(spark, monkeypatch):
    rows = [("en", "a b c a b d b c a b c")] * 6 + [("de", "a b c c b a")] * 6
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "bitmap", lambda rows, order: 255 + phrases.np.zeros(phrases.bitmaps.BITS // 8, phrases.np.uint8))
    assert {tuple(r) for r in phrases.mine(docs, least=5).collect()} == brute(rows, 2000, 5)


def test_odd_and_no_documents(odd, none):
    got = {tuple(r) for r in phrases.mine(odd).collect()}
    assert got == brute([(r["lang"], r["text"]) for r in odd.collect()], 2000, 10)
    assert phrases.mine(none).count() == 0


def test_exact_scores_beyond_64_bits(spark):
    row = spark.range(1).select(phrases.score_of(F.lit(10**14), F.lit(10**14 + 1), F.lit(10**14)).alias("s")).first()
    assert row["s"] == 10**6 * 10**14 // (10**14 + 1)
