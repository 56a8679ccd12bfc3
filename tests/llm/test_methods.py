"""Methods compared with plain versions: naive Bayes and hinge loss, differencing, the curve, long white space."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelens.llm import byte_bpe, packing, pieces, quality, sharding
from tests.llm.conftest import rows_of

BITS = 10


def dense(texts, bits=BITS):
    grams = quality.NGrams(bits)
    found = np.zeros((len(texts), 1 << bits))
    for row, t in zip(found, texts):
        row[grams.columns(t)] = 1.0
    return found


def made(n, seed=5):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(pick.choices(words[: 30 + 30 * (i % 2)], k=pick.randrange(12))), i % 2) for i in range(n)]


def plain_ratios(x, good):
    """Smoothed frequencies of every column in both classes, dense."""
    sizes = np.array([(~good).sum(), good.sum()], float)
    counts = np.array([x[~good].sum(axis=0), x[good].sum(axis=0)])
    smooth = sizes / sizes.mean()
    share = (counts + smooth[:, None]) / sizes[:, None]
    return np.log(share[1] / share[0])


def plain_descent(x, good, ratios, cost, epochs, seed):
    """Dual coordinate descent on a dense matrix, written out row by row."""
    z = x * ratios
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    z = np.hstack([np.where(length > 0, z / np.maximum(length, 1e-12), z), np.ones((len(z), 1))])
    y = np.where(good, 1.0, -1.0)
    dual, order = np.zeros(len(z)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(z)):
            weight = (dual * y) @ z
            best = min(max(dual[i] - (y[i] * (weight @ z[i]) - 1) / (z[i] @ z[i]), 0.0), cost)
            moved, dual[i] = max(moved, abs(best - dual[i])), best
        if moved < quality.TOLERANCE:
            break
    return (dual * y) @ z, dual, z, y


def test_ratios_and_hinge_loss_equal_the_dense_version(spark):
    rows = made(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels, bits=BITS)
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    x, good = dense([t for _, t, _ in kept]), np.array([q == 1 for _, _, q in kept])
    ratios = plain_ratios(x, good)
    assert np.allclose(model[0, :-1], ratios)
    weight, dual, z, y = plain_descent(x, good, ratios, quality.COST, quality.EPOCHS, 1)
    assert np.allclose(model[1], weight, atol=1e-9)
    # At the optimum both problems have one value: half the squared weights plus the losses.
    primal = weight @ weight / 2 + quality.COST * np.maximum(0, 1 - y * (z @ weight)).sum()
    assert primal - (dual.sum() - weight @ weight / 2) < 0.05 * primal
    got = {r.doc_id: r.score for r in quality.scores(docs, model).collect()}
    for i, t, _ in rows:
        v = dense([t])[0] * ratios
        margin = (v @ weight[:-1]) / max(np.sqrt(v @ v), 1e-12) + weight[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-9)


def test_counts_are_of_the_documents_of_smallest_hash(spark):
    rows = made(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    chosen = [r.doc_id for r in labels.where(~quality.in_fold(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    model = quality.train(docs, labels, bits=BITS, counted=50)
    few = [rows[i] for i in chosen]
    want = plain_ratios(dense([t for _, t, _ in few]), np.array([q == 1 for _, _, q in few]))
    assert np.allclose(model[0, :-1], want)


def test_no_text_is_exchanged_for_training(spark):
    """The labels are broadcast, so the texts are scanned and joined in place."""
    docs = spark.createDataFrame([r[:2] for r in made(9)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made(9)], "doc_id bigint, quality int")
    seen = []
    real = quality.class_counts

    def counts(given, bits):
        seen.append(given._jdf.queryExecution().executedPlan().toString())
        return real(given, bits)

    quality.class_counts, before = counts, quality.class_counts
    try:
        quality.train(docs, labels, bits=BITS)
    finally:
        quality.class_counts = before
    assert "BroadcastHashJoin" in seen[0] and "SortMergeJoin" not in seen[0]


def plain_differencing(sizes, shards):
    """Lists of partial partitions; the two of largest spread are combined until one is left."""
    parts = [sorted([(s, [i])] + [(0, [])] * (shards - 1), key=lambda x: -x[0]) for i, s in enumerate(sizes)]
    spread = lambda p: p[0][0] - p[-1][0]
    while len(parts) > 1:
        parts.sort(key=spread)
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1])), key=lambda t: -t[0]))
    return [s for s, _ in parts[0]], parts[0]


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_differencing_equals_the_plain_version(shards):
    """Sizes without equal sums, where both have one way to go."""
    pick = random.Random(shards)
    for n in (1, 2, 5, 12):
        sizes = [pick.randrange(1, 1 << 50) for _ in range(n)]
        shard = sharding.differencing(sizes, shards)
        sums = [sum(s for s, k in zip(sizes, shard) if k == j) for j in range(shards)]
        want, groups = plain_differencing(sizes, shards)
        assert sorted(sums) == sorted(want)
        assert {frozenset(i for i, k in enumerate(shard) if k == j) for j in range(shards)} == {frozenset(g) for _, g in groups}


def test_sequences_follow_the_curve(spark):
    """Documents lie in the stream by place on the curve, then doc_id, as a plain version orders them."""
    pick = random.Random(4)
    words = "alpha beta gamma delta omega sigma theta kappa".split()
    rows = [(i, " ".join(pick.choices(words[i % 4 : i % 4 + 4], k=30))) for i in range(80)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    vocabulary = byte_bpe.read_vocabulary()
    bpe, axes = byte_bpe.ByteBpe(vocabulary), packing.projection()
    keys = []
    for i, t in rows:
        ids = [*bpe.ids(t or ""), packing.END]
        counts = np.zeros((1, packing.BUCKETS))
        for x in ids:
            counts[0, (x * 2654435761 & 0xFFFFFFFF) >> 22] += 1
        keys.append((int(packing.hilbert_key(packing.curve_points(counts, axes))[0]), i))
    got = packing.pack(docs, length=64).orderBy("sequence_id", "offset").collect()
    assert list(dict.fromkeys(r.doc_id for r in got)) == [i for _, i in sorted(keys)]
    # Near in the stream is near in content: neighbours share more than documents far apart.
    group = {i: i % 4 for i, _ in rows}
    order = [i for _, i in sorted(keys) if i < 80]
    beside = np.mean([group[a] == group[b] for a, b in zip(order, order[1:])])
    assert beside > 0.4


BLANK = [" " * 1_000_000, "\n" * 1_000_000, "\t" * 600_000, "a" + " \n" * 400_000 + "b", "x " * 30_000 + " " * 20_000 + "<|endoftext|> y",
         "　" * 20_000, "\x1c" * 20_000 + " "]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("number", range(len(BLANK)))
def test_long_white_space_has_the_library_ids(library, number):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_vocabulary())
    assert bpe.ids(BLANK[number]) == library.encode(BLANK[number], add_special_tokens=False).ids


def test_long_white_space_is_packed(spark, library):
    docs = spark.createDataFrame(list(enumerate(BLANK)), "doc_id bigint, text string")
    totals = docs.join(packing.pack(docs), "doc_id").groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("m"))
    want = [(i, n, n) for i, t in enumerate(BLANK) for n in [len(library.encode(t, add_special_tokens=False).ids) + 1]]
    assert rows_of(totals, "doc_id", "n", "m") == sorted(want)


def test_short_gaps_are_no_long_white_space():
    assert not byte_bpe.has_long_space("word " * 50_000) and not byte_bpe.has_long_space(" " * 9_999)
    assert byte_bpe.has_long_space("word " * 50_000 + " " * 10_000)


def test_a_worker_forgets_the_older_half():
    memory = pieces._Memory(4)
    for i in range(3):
        memory[f"w{i}"] = b"%d" % i
    memory.make_room()
    assert not memory and memory["w1"] == b"1" and list(memory) == ["w1"]
    assert memory.missing({"w0", "w1", "x"}) == {"x"}
    memory.update(a=b"", b=b"")
    memory.make_room()
    assert memory.missing({"w0", "w1", "a"}) == {"w0"}


def test_forgetting_changes_no_ids(monkeypatch):
    model = pieces.read_model()
    texts = [" ".join(f"word{i % 37} thing{i % 11}" for i in range(at, at + 60)) for at in range(0, 900, 30)]
    whole = pieces.Encoder(model).encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    small = pieces.Encoder(model)
    assert [small.encode([t])[0] for t in texts] == whole
    assert len(small.memory) < 120


def test_round_trip_in_one_pass(cluttered, empty):
    both = pieces.encode_pieces(cluttered, decoded=True)
    apart = pieces.decode_pieces(pieces.encode_pieces(cluttered))
    want = sorted(((r.doc_id, r.ids, sha256(r.text.encode()).hexdigest()) for r in apart.collect()), key=repr)
    assert rows_of(both, "doc_id", "ids", "decoded_sha256") == want
    assert pieces.encode_pieces(empty, decoded=True).isEmpty()
