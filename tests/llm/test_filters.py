"""Secrets, URLs, decontamination and the quality classifier."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from updraft.llm import decontaminate, quality, secrets, urls

PATTERNS = [(k, re.compile(p), g, n) for k, p, g, n in secrets.BASE_KINDS]


def spans(text):
    return sorted(
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern, group, least) in enumerate(PATTERNS) for m in pattern.finditer(text or "") if len(m.group(group)) >= least
    )


def test_secret_spans_and_owners(spark):
    run = "k9" * 9 + "QwErTyUiOpAsDf"
    texts = [
        (1, "é password: 'hunter22' token=ab token=abcdef", "a", "a/1"), (2, "AKIA" + "X" * 16 + " " + "0a" * 13 + " PASSWD = zzzzzz!", "a", "a/2"),
        (3, run, "a", "a/1"), (3, run, "a", "a/1"), (4, "", "b", None), (5, None, None, None), (6, "api_key:\"" + "q" * 9 + "\" secret secret=", "b", "b/1"),
        *((10 + i, "password=example-value", f"o{i}", f"o{i}/r") for i in range(4)),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string, repo string").withColumn("hash", F.lit("clash"))
    out = secrets.digest(secrets.scan(docs, F.col("source"), F.col("repo"))).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(t[0] for t in texts)
    by_id = {r["doc_id"]: r for r in out}
    for doc_id, text, *_ in texts:
        base = ",".join(f"{kind}:{b}:{e}" for b, _, kind, e in spans(text))
        assert by_id[doc_id]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(x for x in by_id[doc_id]["spans"].split(",") if not x.startswith("owned")) == base
    assert by_id[3]["spans"] == f"owned:0:{len(run)}" and by_id[3]["n_live"] == 1
    assert by_id[10]["n_example"] == 1 and by_id[10]["n_live"] == 0
    assert secrets.scan(docs.limit(0), F.col("source"), F.col("repo")).count() == 0


def test_secrets_of_a_text_full_of_them(spark):
    parts = [("token=abc123", "x=1", "AKIA" + "Z" * 16, "0f" * 12, "Ab3dEf6hIj9kLm2nOp5qRs8t", "secret: k9k9k9k9k9k9k9k9k9k9k9k9k9")[i % 6] + f" {i} " for i in range(160_000)]
    docs = spark.createDataFrame([(1, "".join(parts), "a"), (2, None, "a"), (3, "password=zzzzzzz", "b")], "doc_id long, text string, source string")
    begun = time.monotonic()
    row = secrets.digest(secrets.scan(docs, F.col("source"), F.col("source"))).where("doc_id = 1").first()
    assert time.monotonic() - begun < 60
    base = spans("".join(parts))
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
    text = ",".join(f"{kind}:{b}:{e}" for b, _, kind, e in base)
    assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    # One unlabelled run in six parts, none of those that a base span covers.
    assert row["n_owned"] == len([i for i in range(160_000) if i % 6 == 4])


def test_hot_secret_hashes_are_broadcast_and_counted(spark, monkeypatch):
    rows = [(i, "api_key=copied-everywhere" if i % 3 else f"api_key=single-{i:04d}", f"o{i % 5}", f"o{i % 5}/r{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    found = {}
    for share in (10, 1_000_000, 1):
        monkeypatch.setattr(secrets, "HEAVY_SHARE", share)
        out = secrets.scan(docs, F.col("source"), F.col("repo")).collect()
        found[share] = sorted((r["doc_id"], *r["findings"][0]) for r in out)
        assert len(out) == len(rows) and all(len(r["findings"]) == 1 for r in out)
    assert found[10] == found[1_000_000] == found[1]
    assert {(r[6], r[7], r[8]) for r in found[10] if r[0] % 3} == {(5, len({(i % 5, i % 7) for i in range(600) if i % 3}), "example")}
    assert {(r[6], r[7], r[8]) for r in found[10] if r[0] % 3 == 0} == {(1, 1, "live")}


def test_url_rules_and_terms(spark):
    rows = [
        ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.org", "x.org", "", None, "allow"), ("http://notorg/a", "notorg", "/a", None, "allow"), ("http://a.com/de/x#y", "a.com", "/de/x", "com/de/", "block"),
        ("http://free-bets.example.net/", "free-bets.example.net", "/", None, "block"), ("http://casino.net/", "casino.net", "/", None, "block"),
        ("http://casinoble.net/free", "casinoble.net", "/free", None, "allow"), ("no scheme casino", "", "", None, "block"), ("//free.example.net/Bets", "", "", None, "block"), ("org/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://a.net/" + "x/" * 50_000 + "porn", "a.net", "/" + "x/" * 50_000 + "porn", None, "block"),
    ]
    pages = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id long, url string, verdict string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert out == {i: r[1:] for i, r in enumerate(rows)}
    assert urls.judge(pages.unionByName(pages)).count() == 2 * len(rows)
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_vocabulary_from_a_table(spark):
    rows = [*((f"Bad{i:05d}", "strict") for i in range(10_000)), *((f"meh{i:05d}", "soft") for i in range(10_000)), ("meh00001", "soft"), ("bad00007", "soft")]
    table = spark.createDataFrame(rows, "term string, kind string")
    strict, soft = urls.terms_of(table)
    assert (len(strict), len(soft)) == (10_000, 10_000)
    asked = ["http://a.net/bad09999", "http://a.net/xbad09999", "http://a.net/meh00001/meh00002", "http://a.net/meh00001/meh00001", "http://a.net/bad00007"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    got = urls.judge(pages, strict=strict, soft=soft).orderBy("page_id")
    assert [r["verdict"] for r in got.collect()] == ["block", "allow", "block", "allow", "block"]
    assert urls.terms_of(table.limit(0)) == ([], [])
    for odd in ([("", "soft")], [(None, "soft")], [("x", "hard")], [("x", None)]):
        with pytest.raises(ValueError):
            urls.terms_of(spark.createDataFrame(odd, "term string, kind string"))
    with pytest.raises(ValueError):
        urls.terms_of(table, most_bytes=1000)


def test_leaks_equal_brute_force(spark, odd):
    rnd = random.Random(4)
    items = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(30)) for _ in range(n)) for n in (1, 3, 4, 5, 6, 9, 20, 33, 60)]
    docs = [(i, None if i == 0 else " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.choice([0, 3, 200])))) for i in range(60)]
    for i in range(1, 60):
        words = items[i % len(items)].upper().split()
        for _ in range(rnd.randrange(0, 3)):
            words[rnd.randrange(len(words))] = "changed"
        docs[i] = (i, f"{docs[i][1]} {', '.join(words)}. end")
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, " ")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: (min(5, len(t.split())), decontaminate.shingles(t.encode(), min(5, len(t.split())))) for i, t in enumerate(items)}
    want = set()
    for d, text in docs:
        for i, (width, wanted) in sets.items():
            n = len(wanted & decontaminate.shingles((text or "").encode(), width))
            if n / len(wanted) >= 0.8:
                want.add((d, i, len(wanted), n))
    for block in (1 << 20, 50):
        got = decontaminate.leaks(frame, bench, block_bytes=block)
        assert {tuple(r)[:4] for r in got.collect()} == want
        assert {r[0] for r in decontaminate.clean(frame, bench, block_bytes=block).select("doc_id").collect()} == {d for d, _ in docs} - {x[0] for x in want}
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_classifier_learns_and_scores_whole_texts(spark, odd):
    rnd = random.Random(7)
    good = lambda: " ".join(rnd.choice(["river", "stone", "garden", "walking", "slowly"]) for _ in range(60))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([*((i, int(i % 3 > 0)) for i in range(240)), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((out[i] >= 0.7) == (i % 3 > 0) for i in range(300))
    assert {r[0] for r in quality.accept(docs, model).select("doc_id").collect()} == {i for i in range(300) if i % 3}
    scored = quality.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.accept(odd, model, least=0.0).columns == odd.columns
    assert quality.score(odd, quality.fit(docs, labels.limit(0), F.lit(True))).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)


def test_grouped_sums_equal_single_ones():
    model = quality.train([(*quality.bucket_counts(t, 12), y) for t, y in (("aa bb", 1), ("cc dd dd", 0))], bits=12, epochs=2)
    texts = ["", " ", "a", "aa aa bb", "x　y", "cc dd dd " * 30, "é"]
    grouped = quality.group_sums(texts, model.weight)
    for text, (total, n) in zip(texts, grouped.T):
        found, counts = quality.bucket_counts(text, 12)
        assert counts.sum() == n and np.isclose((model.weight[found] * counts).sum(), total, atol=1e-4)


def test_op5_learns_from_no_held_out_label_and_scores_each_text_alone(spark, tmp_path):
    from updraft.llm.queries import op5_subword_quality

    rnd = random.Random(3)
    good, bad = [f"fine{i}" for i in range(30)], [f"junk{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choices(good if i % 3 else bad, k=25)), rnd.choice("ab"), "en") for i in range(400)]
    docs += [(400, None, "a", "en"), (401, "", "b", None), (402, "fine1 " * 5000, None, "fr")]
    apart = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in docs}
    results = []
    # Other labels on held-out rows, other sources and languages, and shuffled rows change nothing.
    for turn in range(2):
        folder = f"{tmp_path}/{turn}"
        rows = [(i, t, s if turn == 0 else "z", g if turn == 0 else "xx") for i, t, s, g in (docs if turn == 0 else docs[::-1])]
        spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
        marks = [(i, int((i % 3 > 0) != (turn == 1 and apart[i]))) for i in range(400)]
        spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        results.append({r["doc_id"]: r for r in op5_subword_quality(spark, folder).collect()})
    for i, row in results[0].items():
        assert row["held_out"] == apart[i] and row["predicted"] == int(row["score"] >= 0.7)
        assert np.isclose(row["score"], results[1][i]["score"], atol=1e-6)
    assert set(results[0]) == {i for i, *_ in docs}
    assert all(row["predicted"] == int(i % 3 > 0) for i, row in results[0].items() if i < 400 and apart[i])
    known = [(*quality.bucket_counts(t, quality.BITS), int(i % 3 > 0)) for i, t, *_ in docs[:400] if not apart[i]]
    model = quality.train(sorted(known, key=lambda r: (len(r[0]), r[2], r[0].astype(np.int32).tobytes())), bits=quality.BITS)
    for i, text, *_ in docs:
        found, counts = quality.bucket_counts(text or "", quality.BITS)
        alone = float(model.probability(np.array([(model.weight[found] * counts).sum()]), np.array([counts.sum()]))[0])
        assert np.isclose(alone, results[0][i]["score"], atol=1e-4), i
