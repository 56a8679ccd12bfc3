"""Token counts, pieces, quality, packing and sharding against libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scribelens.llm import packing, pieces, quality, sharding, token_counts
from scribelens.llm.byte_bpe import ByteBpe, read_vocabulary
from tests.llm.conftest import TEXTS, rows_of

BITS = st.sampled_from(
    ["a", "B", "the", "er", "ing", " ", "  ", "\n", "\t", "▁", "▁▁", "é", "中", "🙂", "\0", "1", "²", "'s", "_", "!!", "\x1c", "\xa0", "\u2028",
     "</s>", "<0x41>", "<|endoftext|>", "   "]
)
STRINGS = st.lists(BITS, max_size=16).map("".join)


DECODER = pieces.Decoder(pieces.read_model())


@pytest.fixture(scope="module")
def piece_library():
    return token_counts.load(token_counts.read_model())


@pytest.fixture(scope="module")
def counter(piece_library):
    return token_counts.TokenCounter(token_counts.read_model(), token_counts.whole_tokens(piece_library))


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.read_model())


@pytest.fixture(scope="module")
def byte_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def byte_bpe():
    return ByteBpe(read_vocabulary())


@settings(max_examples=400, deadline=None)
@given(STRINGS)
def test_counts_and_pieces_equal_the_library(piece_library, counter, encoder, text):
    want = piece_library.encode(text)
    assert counter.count(text) == len(want)
    got = np.frombuffer(encoder.encode([text])[0], "<i4").tolist()
    assert got == want and DECODER.decode(got) == piece_library.decode(want)


@settings(max_examples=300, deadline=None)
@given(STRINGS)
def test_byte_ids_equal_the_library(byte_library, byte_bpe, text):
    assert byte_bpe.ids(text) == byte_library.encode(text, add_special_tokens=False).ids


def test_whole_tokens_are_proven(piece_library):
    whole = token_counts.whole_tokens(piece_library)
    assert len(whole) > 5000 and "▁the" in whole and "▁" in whole and "the" not in whole
    assert token_counts.splits_at_marks(piece_library)


def test_a_model_without_proof_counts_whole_texts(piece_library):
    counter = token_counts.TokenCounter(token_counts.read_model(), None)
    assert counter.count("a  long day") == len(piece_library.encode("a  long day"))


def test_long_pre_token_is_relaxed(piece_library, encoder):
    text = "abcdefghij" * 900 + " x"
    assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == piece_library.encode(text)


def test_token_counts_of_messy_rows(cluttered, empty, piece_library):
    got = token_counts.count_tokens(cluttered, limit=100)
    want = [(i, len((t or "").encode()), len(n := piece_library.encode(t or "")), len(n) > 100) for i, t in TEXTS]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty).isEmpty()


def test_pieces_of_messy_rows(cluttered, empty, piece_library):
    encoded = pieces.encode_pieces(cluttered)
    decoded = pieces.decode_pieces(encoded)
    want = [(i, piece_library.encode(t or ""), piece_library.decode(piece_library.encode(t or ""))) for i, t in TEXTS]
    assert rows_of(decoded, "doc_id", "ids", "text") == sorted(want, key=repr)
    assert pieces.decode_pieces(pieces.encode_pieces(empty)).isEmpty()


def test_texts_of_very_many_characters_equal_the_library(piece_library, encoder):
    every = "".join(chr(c) for c in range(0x21, 0x1A000) if not 0xD800 <= c < 0xE000)
    rare = "".join(chr(c) for c in range(0x20000, 0x20040))
    for text in (every + " the end", rare):
        text = "".join(c for c in text if piece_library.normalize(c).strip(token_counts.MARK) == c)
        assert np.frombuffer(encoder.encode([text])[0], "<i4").tolist() == piece_library.encode(text)


def test_suffix_ranges_are_all_occurrences():
    rng = random.Random(2)
    codes = np.array([rng.randrange(1, 4) for _ in range(500)])
    array = pieces.SuffixArray(codes, 5)
    rows = np.full((40, 5), -1)
    for r in rows:
        n = rng.randrange(1, 6)
        r[:n] = [rng.randrange(1, 4) for _ in range(n)]
    for row, lo, hi in zip(rows, *array.ranges(rows)):
        piece = row[row >= 0].tolist()
        found = [i for i in range(len(codes)) if codes[i : i + len(piece)].tolist() == piece]
        assert sorted(array.order[lo:hi].tolist()) == found


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_pieces(rows, library, texts, length):
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in texts)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    streams = []
    for found in docs.values():
        for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
            if r.start == 0:
                streams.append([])
            assert r.start == len(streams[-1])
            streams[-1] += r.ids
            assert len(streams[-1]) <= r.doc_tokens
    assert sorted(map(tuple, streams)) == want
    assert sorted(sequences) == list(range(len(sequences)))
    for number, found in sequences.items():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or number == len(sequences) - 1


def test_packing_of_messy_rows(cluttered, empty, byte_library):
    rows = packing.pack(cluttered, length=64, with_ids=True).collect()
    texts = [(i, t) for i, t in TEXTS]
    check_pieces(rows, byte_library, texts, 64)
    assert packing.pack(empty).isEmpty()


def test_differencing_is_tight_and_complete():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 10_000) for _ in range(2000)] + [400_000]
    shard = sharding.differencing(sizes, 24)
    sums = [sum(s for s, k in zip(sizes, shard) if k == j) for j in range(24)]
    assert max(sums) - min(sums) <= 2
    assert sharding.differencing([5], 3) == [0] and sharding.differencing([], 3) == []


def test_shards_of_messy_rows(cluttered, empty):
    rows = sharding.shard_by_bytes(cluttered, shards=3).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == want
    homes, slots = {}, {}
    for r in rows:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(empty).isEmpty()


def test_many_small_groups_are_balanced(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(900)).cast("int")).alias("text"))
    mixed = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.lit("hot text")).otherwise(F.concat("text", F.col("doc_id").cast("string"))))
    sums = [r["s"] for r in sharding.shard_by_bytes(mixed).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 24 and (max(sums) - min(sums)) < 0.001 * min(sums)


def test_quality_learns_and_scores_everything(spark, cluttered):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    made, marks = [], []
    for i in range(600):
        good = i % 3 != 0
        w = [rng.choice(words) for _ in range(30)]
        made.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks + [(None, 1), (5, None), (7, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels, sample=200)
    rows = quality.scores(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = dict(marks)
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.held_out)
    messy = quality.scores(cluttered, model).collect()
    assert len(messy) == len(TEXTS) and all(0 <= r.score <= 1 for r in messy)
    assert {r.doc_id for r in messy if not r.held_out} >= {None}
    kept = quality.keep_good(cluttered, model)
    assert kept.columns == cluttered.columns
    assert kept.count() == sum(r.score >= 0.5 for r in messy)


def test_quality_counts_all_labels_and_fits_one_row_per_document(spark, monkeypatch):
    made = [(i, f"word{i} {'good' if i % 2 else 'bad'}") for i in range(400)] + [(3, "word3 good")] * 50
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    given = {}
    real = quality.fit

    def fit(rows, *more, **named):
        given["rows"] = len(rows)
        return real(rows, *more, **named)

    monkeypatch.setattr(quality, "fit", fit)
    model = quality.train(docs, labels, sample=500)
    trained = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert given["rows"] == len(trained)
    few = quality.train(docs, labels, sample=20)
    assert given["rows"] == 20
    assert (few[0] == model[0]).all() and quality.SAMPLE == 12_000


def test_quality_without_labels_is_constant(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    assert {r.score for r in quality.scores(docs, model).collect()} == {0.5}
    assert quality.scores(empty, model).isEmpty()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    judged = quality.op3_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in judged]) > 0.95
