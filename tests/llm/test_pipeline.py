"""The stages on the small tables: each keeps or drops what it should, none changes columns."""

import corpus_pipeline
from updraft.llm import quality
from updraft.llm.tables import read, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = (before, docs.count())
    assert kept["mix"][0] == kept["mix"][1]
    assert all(0 < after <= before for before, after in kept.values())
    order = [r["doc_id"] for r in docs.collect()]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(order)
    # The token files hold the mixture in the order in which it was written.
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == order


def test_rejected_labels_go(spark):
    docs = read(spark, SF, "documents")
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    left = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    right = [(i in left) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)


def test_odd_rows_pass_every_stage(spark, odd, none):
    for rows in (odd, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert quality.ACCEPT == 0.7
