"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from updraft.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def level_up(nodes):
    return [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, copied nodes) of each row, every version by a whole new tree."""
    parts = {}
    for row in rows:
        parts.setdefault(row[1], []).append(row)
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for s in order:
        parts[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        levels[s] = [list(map(leaf, parts[s]))]
        while len(levels[s][-1]) > 1:
            levels[s].append(level_up(levels[s][-1]))
    top = [[levels[s][-1][0] for s in order]]
    while len(top[-1]) > 1:
        top.append(level_up(top[-1]))
    out = []
    for place, s in enumerate(order):
        for at, row in enumerate(parts[s]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            digest, proof, way = leaf((*row[:4], text)) if changed else levels[s][0][at], "", []
            for i, nodes in ((at, levels[s]), (place, top)):
                for level in nodes[:-1]:
                    first = i // 16 * 16
                    run = level[first : first + 16]
                    proof += "".join(run[: i - first] + run[i - first + 1 :])
                    run[i - first] = digest
                    digest, i = h(*run), i // 16
                    way.append(digest)
            out.append((row[0], levels[s][0][at], levels[s][-1][0], top[-1][0], h(proof), digest, way if changed else []))
    return sorted(out, key=str)


def proven(docs):
    rows = merkle.manifest(docs, merkle.lower_cased, merkle.one_in(5))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_deep_and_wide_trees(spark, odd):
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(4100)]
    rows += [(10_000 + i, f"s{i}", None if i % 3 else "", None, None if i % 7 == 0 else "Ab " * (i % 5)) for i in range(300)]
    rows += [(None, None, None, None, None), (None, "hot", "de", 1, "Up"), (7, "hot", "en", 7, "Again"), (7, "hot", "en", 7, "Again"), (5, None, "", 0, "")]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("root", F.lit("clash")).withColumn("pos", F.lit(1))
    assert proven(docs.repartition(7)) == plain(rows)
    assert proven(odd) == plain([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()])


def test_small_and_empty_tables(spark):
    for n in (0, 1, 2, 16, 17, 256, 257):
        rows = [(i, "a", "en", 1, "T") for i in range(n)]
        assert proven(spark.createDataFrame(rows, FIELDS)) == plain(rows)


def test_a_version_shares_untouched_nodes():
    tree = merkle.PersistentTree([h(str(i)) for i in range(200)], 2)
    before, nodes = list(tree.digest), len(tree.digest)
    version = tree.replaced(tree.root, 37, h("x"))
    assert len(tree.digest) == nodes + 3 and tree.digest[:nodes] == before
    old, new = tree.children[tree.root], tree.children[version[-1]]
    assert [a == b for a, b in zip(old, new)] == [i != 37 // 16 for i in range(len(old))]
    assert merkle.folded(h("x"), tree.siblings(tree.root, 37))[-1] == tree.digest[version[-1]]
