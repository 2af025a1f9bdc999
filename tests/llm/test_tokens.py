"""Token files, token counts and the mixture."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from .odd_rows import ODD_DOCS
from pyspark.sql import functions as F

from updraft.llm import mixing, pieces, seekable, token_files
from updraft.llm.pieces import PieceEncoder
from updraft.llm.queries import TOKENIZER


ODD = [
    "a  b", " a", "a ", "\n\n a  \n b", " ", "a <|endoftext|> b", "é  é", "a \x1c b", "\x85 a", "a\x1fb", "don't. 12.5,3 ...!? |x|y|", "1²,² a.²", "it's.'s 'll",
]


@pytest.mark.parametrize("group", [50, 4 << 20])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, group):
    monkeypatch.setattr(pieces, "GROUP_BYTES", group)
    monkeypatch.setattr(pieces, "GENERATION", 20)
    encoder = PieceEncoder(TOKENIZER)
    texts = [*ODD, None, "", *(t for _, t, *_ in ODD_DOCS)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == encoder.whole([text or ""])[0].tolist()


@pytest.mark.parametrize("literal", [True, False])
def test_pieces_between_marks_and_letters_give_the_ids_of_the_plain_library(monkeypatch, literal):
    from tokenizers import Tokenizer

    monkeypatch.setattr(pieces, "GROUP_BYTES", 2000)
    monkeypatch.setattr(pieces, "GENERATION", 100)
    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = literal
    rnd = random.Random(3)
    signs = [*"aZé ß9ɏ×÷ºµĠ中½٣😀  \n\t\r\x1f\x1c\xa0", *map(chr, range(33, 48)), *":;<=>?@[]^_`{|}~\\", "\u0301", "'s", "'ll", " the", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    got = PieceEncoder(TOKENIZER, literal).encode(pa.array(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert pieces.cut(pa.array(["été. naß) it's"])).to_pylist() == [["été", ".", " naß", ")", " it's"]]


@pytest.fixture
def given(monkeypatch):
    """The texts handed to the library."""
    texts, whole = [], PieceEncoder.whole
    monkeypatch.setattr(pieces, "_encoders", {})
    monkeypatch.setattr(PieceEncoder, "whole", lambda self, new, *by: texts.extend(new) or whole(self, new, *by))
    return texts


def test_pieces_that_are_no_words_go_to_the_library_many_at_a_time(given):
    encoder = PieceEncoder(TOKENIZER)
    given.clear()
    numbers = [f" {n}" for n in range(10_000, 12_000)]
    assert [x.tolist() for x in encoder.encode(pa.array(numbers))] == [encoder.tokenizer.encode(n).ids for n in numbers]
    assert len(given) <= 2 + len(numbers) // pieces.JOINED


def test_a_worker_gives_pieces_to_the_library_once_for_all_its_tasks(given):
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["some words\nand 17 others", "more words"]})
    task = seekable.make_shards(TOKENIZER, 2, 100, False)
    first = [b.to_pylist() for b in task(iter([batch]))]
    assert given
    given.clear()
    assert [b.to_pylist() for b in task(iter([batch]))] == first and not given


def ids_of(text):
    return PieceEncoder.of(TOKENIZER).whole([text or ""])[0].tolist()


def test_shards_round_trip(spark, odd, none, tmp_path):
    seekable.write(odd, f"{tmp_path}/a", TOKENIZER, shard_bytes=64)
    rows = sorted(seekable.read(spark, f"{tmp_path}/a").collect(), key=lambda r: r["start"])
    docs = sorted(ODD_DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    start = 0
    for row, (doc_id, text, *_) in zip(rows, docs, strict=True):
        ids = [*ids_of(text), 2]
        assert tuple(row)[:4] == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    seekable.write(none, f"{tmp_path}/b", TOKENIZER)
    assert seekable.read(spark, f"{tmp_path}/b").count() == 0


def test_token_files_hold_the_ids_of_the_plain_library(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from updraft.llm.queries import op6_seekable_frames

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y \x1f z", "plain words", *ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(TOKENIZER)
    ids = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    want = {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (op6_seekable_frames(spark, str(tmp_path)), corpus_pipeline.tokens(spark, stored, str(tmp_path))):
        assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()} == want


def test_shard_is_seekable_and_checked():
    import zstandard

    shard = seekable.Shard(wide=False)
    for n in range(5):
        shard.add(n, np.arange(n * 3, dtype="<u4"))
    data = shard.close()
    reader = seekable.ShardReader(data)
    assert reader.doc_ids.tolist() == list(range(5)) and reader[4].tolist() == list(range(12))
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(np.arange(n * 3, dtype="<u2").tobytes() for n in range(5))
    broken = bytearray(data)
    broken[reader.offsets[4] + 10] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        seekable.ShardReader(bytes(broken))[4]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_sizes_across_blocks(block):
    rnd = random.Random(block)
    for _ in range(50):
        ids = np.array([rnd.choice([9, 1, 2, 3]) for _ in range(rnd.randrange(40))], "<u2")
        want, open_ = [], 0
        for i in ids.tolist():
            open_ += 1
            if i == 9:
                want.append(open_)
                open_ = 0
        sizes, ended = token_files.document_sizes(ids, 9, block)
        assert sizes.tolist() == want + [open_] * (open_ > 0) and ended == (open_ == 0)


def test_counts_of_documents(spark, odd, none, tmp_path):
    got = token_files.document_counts(odd, f"{tmp_path}/f", TOKENIZER).select("doc_id", "n_tokens").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((d[0], len(ids_of(d[1])) + 1) for d in ODD_DOCS), key=key)
    assert token_files.document_counts(none, f"{tmp_path}/g", TOKENIZER).count() == 0


def test_counts_keep_their_documents_when_scans_are_split_anew(spark, tmp_path):
    texts = [(i, "word " * (i % 37)) for i in range(4000)]
    for half in (texts[:2500], texts[2500:]):
        spark.createDataFrame(half, "doc_id long, text string").coalesce(1).write.mode("append").option("parquet.block.size", 4096).parquet(f"{tmp_path}/d")
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    try:
        spark.conf.set(cost, "1")
        counts = token_files.document_counts(spark.read.parquet(f"{tmp_path}/d"), f"{tmp_path}/f", TOKENIZER).select("doc_id", "n_tokens")
        spark.conf.set(size, "4k")
        got = sorted(map(tuple, counts.collect()))
    finally:
        spark.conf.unset(size)
        spark.conf.unset(cost)
    assert got == [(i, len(ids_of(t)) + 1) for i, t in texts]


def test_flat_files_are_bounded_and_count_like_whole_ones(spark, tmp_path):
    texts = [(i, "word " * (i % 37)) for i in range(300)] + [(300, "word " * 500), (None, None), (301, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    # One file of a whole partition was read as one value, whatever its size.
    whole = token_files.document_counts(docs, f"{tmp_path}/w", TOKENIZER, segment_ids=1 << 40).collect()
    parted = token_files.document_counts(docs, f"{tmp_path}/p", TOKENIZER, segment_ids=100).collect()
    assert sorted(map(str, parted)) == sorted(map(str, whole)) and len(parted) == len(texts)
    files = lambda at: [f.stat().st_size for f in (tmp_path / at).glob("kind=a-ids/**/*.txt")]
    assert len(files("w")) == 1 and sum(files("p")) == files("w")[0]
    assert len(files("p")) > 20 and max(files("p")) <= 2 * (100 + 501 + 1)


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 2}, {"a": 50, "b": 1, None: 7}, {f"s{i}": i + 1 for i in range(9)}])
def test_edf_keeps_every_source_within_a_block(weights):
    slots = mixing.slots_of_period(weights, 97)
    total, done = sum(slots.values()), dict.fromkeys(slots, 0)
    for slot, (source, block, at, release, deadline) in enumerate(mixing.edf(slots)):
        assert at == slot and release <= slot < deadline and block == done[source]
        done[source] += 1
        for s, n in slots.items():
            assert abs(done[s] - n * (slot + 1) / total) < 1


def test_mix_keeps_rows_and_follows_the_schedule(spark, odd, none):
    rows = [(i, "x" * 10, "ab"[i % 5 > 0], 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    mixed = mixing.mix(docs, {"a": 1, "b": 1}, block_units=10).collect()
    assert sorted(r["doc_id"] for r in mixed) == list(range(500)) and docs.columns == mixed[0].__fields__
    assert all(abs(sum(r["source"] == "a" for r in mixed[: n + 1]) - (n + 1) / 2) <= 1 for n in range(190))
    timed = mixing.schedule(docs.drop("slot"), {"a": 3, "b": 1}, block_units=40)
    assert timed.where("slot < release or slot >= deadline").count() == 0
    blocks = timed.groupBy("source", "block").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("s")).collect()
    assert all(r["s"] == 1 and r["n"] <= 4 for r in blocks)
    out = mixing.mix(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, {}).count() == odd.count()


def plain_schedule(docs, keys):
    """(doc_id, source, block, slot, release, deadline) by serving the earliest deadline slot by slot."""
    size = lambda d: len(d[1] or "")
    names = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    units = {s: sum(size(d) for d in docs if d[2] == s) for s in names}
    slots = mixing.slots_of_period({s: max(1, n) ** 0.5 for s, n in units.items()}, mixing.PERIOD)
    total = sum(slots.values())
    block_units = min(mixing.BLOCK_UNITS, max(1, -(-sum(units.values()) // (mixing.PERIODS * total))))
    placed = {}
    for s in names:
        at = 0
        for d in sorted((d for d in docs if d[2] == s), key=lambda d: (keys[d[0]], d[0])):
            placed[d[0]] = (s, at // block_units)
            at += size(d)
    served, done = {}, dict.fromkeys(names, 0)
    for slot in range(total * (1 + max(b // slots[s] for s, b in placed.values()))):
        due = [(-(-(done[s] + 1) * total // slots[s]), n, s) for n, s in enumerate(names) if done[s] * total // slots[s] <= slot]
        deadline, _, s = min(due)
        served[s, done[s]] = (slot, done[s] * total // slots[s], deadline)
        done[s] += 1
    rows = {(i, s, b, *served[s, b]) for i, (s, b) in placed.items()}
    return rows, slots, block_units


@pytest.mark.parametrize("seed", [1, 2])
def test_op2_equals_a_schedule_served_slot_by_slot(spark, tmp_path, seed):
    from updraft.llm.queries import op2_pfair_mix

    rnd = random.Random(seed)
    docs = [(i, rnd.choice([None, "", "x" * rnd.randrange(1, 200), "y" * rnd.randrange(3000)]), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(500)]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, slot long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    keys = dict(map(tuple, frame.select("doc_id", F.xxhash64("doc_id", "text")).collect()))
    want, slots, block_units = plain_schedule(docs, keys)
    assert {tuple(r) for r in op2_pfair_mix(spark, str(tmp_path)).collect()} == want
    # Up to the end of each slot before a source runs out, its units are within a block and a document of its share.
    size, longest, of = {d[0]: len(d[1] or "") for d in docs}, max(len(d[1] or "") for d in docs), {r[0]: r for r in want}
    ends = {s: max(r[3] for r in want if r[1] == s) for s in slots}
    had, total = dict.fromkeys(slots, 0), sum(slots.values())
    by_slot = sorted(want, key=lambda r: r[3])
    at = 0
    for slot in range(min(ends.values())):
        while at < len(by_slot) and by_slot[at][3] <= slot:
            had[by_slot[at][1]] += size[by_slot[at][0]]
            at += 1
        for s, n in slots.items():
            assert -block_units <= had[s] - n * (slot + 1) * block_units / total <= block_units + longest
    assert len(of) == len(docs)
