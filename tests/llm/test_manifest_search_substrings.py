"""Merkle manifest, lexical search and substring dedup against brute force."""

import random
import re
import zlib
from hashlib import sha256
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelens.llm import lexical, merkle, substrings
from scribelens.llm.registry import llm_oracles, llm_queries
from tests.compare import connect, difference
from tests.llm.conftest import SCHEMA, TEXTS, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_lexical_search", "op13_substring_dedup"])
def test_against_sql(spark, name):
    assert difference(llm_queries()[name](spark, FOLDER), connect(FOLDER), llm_oracles()[name]) is None


# Manifest ----------------------------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h(field(row[0]), field(row[3]), field(row[2]), field(row[4]), field(text))


def raised(nodes):
    """All levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, at):
    """(digests left, digests right) per level."""
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def plain_manifest(rows):
    """Rows of (doc_id, text, lang, source, n_chars), one by one."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: raised([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = raised([trees[g][-1][0] for g in names]) if names else [[]]
    out = []
    for i, g in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], at), *siblings(top, i)]
            low = None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            digest = leaf_of(r, low) if tampered else leaf
            for left, right in path:
                digest = h(*left, digest, *right)
            proof = h(*(d for left, right in path for d in (*left, *right)))
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=repr)


FOLDED = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def third():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def test_manifest_of_messy_rows(cluttered, empty):
    rows = [(i, t, None, "hot", None if t is None else len(t)) for i, t in TEXTS]
    got = merkle.Manifest.build(merkle.doc_leaves(cluttered, third())).prove()
    assert rows_of(got, *FOLDED) == plain_manifest(rows)
    assert merkle.Manifest.build(merkle.doc_leaves(empty)).prove().isEmpty()


@pytest.mark.parametrize("n,levels", [(1, 1), (8, 1), (9, 1), (65, 1), (700, 1), (700, 2), (700, 4)])
def test_manifest_of_many_rounds(spark, n, levels):
    """One language of most rows, others of one row, blocks of 8 or 64 leaves."""
    pick = random.Random(n)
    rows = [(i, f"Text {i}", "en" if i < n - 12 else pick.choice(["de", "é", "", None, f"x{i}"]), None, i) for i in range(n)]
    docs = spark.createDataFrame(pick.sample(rows, n), SCHEMA).repartition(5)
    got = merkle.Manifest.build(merkle.doc_leaves(docs, third()), levels).prove()
    assert rows_of(got, *FOLDED) == plain_manifest(rows)


def test_untampered_manifest_verifies(docs):
    got = merkle.Manifest.build(merkle.doc_leaves(docs)).prove()
    assert got.where("NOT verified").isEmpty() and got.count() == len(TEXTS)


# Search ------------------------------------------------------------------------------------


def words_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]


def plain_search(docs, items, top):
    docs = [(i, words_of(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in items:
        scores = []
        for i, words in docs:
            score = 0
            for t in set(words_of(text)) & set(words):
                df, tf = sum(t in w for _, w in docs), words.count(t)
                m = 10 + 90 * len(words) * n_docs // total
                score += floor(1000 * log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=repr)


ITEMS = [(1, "The QUICK fox, the lazy dog!"), (2, None), (3, ""), (4, "unheard words"), (5, "line shared é中🙂"),
         (6, "two words"), (6, "two words"), (None, "lorem ipsum solo"), (7, "dolor " * 3000)]


@pytest.mark.parametrize("top,round_bytes", [(10, 1 << 20), (2, 8)])
def test_search_of_messy_rows(spark, cluttered, empty, monkeypatch, top, round_bytes):
    monkeypatch.setattr(lexical, "ROUND_BYTES", round_bytes)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("score", F.lit(3))
    got = lexical.search(cluttered, items, top)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == plain_search(TEXTS, ITEMS, top)
    assert lexical.search(empty, items).isEmpty() and lexical.search(cluttered, items.limit(0)).isEmpty()
    assert lexical.search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_at_the_cut_go_to_the_smallest_ids(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text")).repartition(7)
    other = spark.createDataFrame([(5000 + i, f"other text {i}") for i in range(50)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "other words")], "item_id bigint, text string")
    got = lexical.search(docs.union(other), items, 60)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert set(scores) == {*range(5000, 5050), *range(10)}


def test_products_are_exact_beyond_the_bound():
    """Products below 2^52 whose sums are beyond 2^53."""
    pick = np.random.default_rng(1)
    left, right = pick.integers(0, 1 << 20, (3, 400)), pick.integers(0, 1 << 32, (400, 2))
    got = lexical.multiply(left.astype(float), right.astype(float), 1 << 52)
    assert (got > 1 << 53).all() and got.tolist() == (left @ right).tolist()


# Substrings --------------------------------------------------------------------------------


def plain_drop(rows, length):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    seen, out = set(), []
    for k in order:
        i, words = docs[k]
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


DROPPED = "doc_id n_words n_removed kept_sha256".split()


@pytest.mark.parametrize("length,base", [(20, 5), (4, 1), (4, 4), (2, 1)])
def test_repeats_of_messy_rows(cluttered, empty, length, base):
    got = substrings.drop_repeats(cluttered.repartition(1).sortWithinPartitions("doc_id"), length, base)
    assert rows_of(got, *DROPPED) == plain_drop(TEXTS, length)
    assert substrings.drop_repeats(empty, length, base).isEmpty()


@pytest.mark.parametrize("chunk_bytes,bucket", [(1, 4), (300, 50), (1 << 20, 1 << 20)])
def test_repeats_over_chunks_and_buckets(spark, chunk_bytes, bucket):
    pick = random.Random(chunk_bytes)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = [f"w{pick.randrange(40)}" for _ in range(pick.randrange(60))]
        if pick.random() < 0.5:
            a = pick.randrange(40)
            at = pick.randrange(len(words) + 1)
            words[at:at] = passage[a : a + pick.randrange(5, 50)]
        if pick.random() < 0.2:
            words = words * 2  # repeats itself
        rows.append((i * 7 % 120, " \n".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = substrings.drop_repeats(docs, 8, 2, with_text=True, chunk_bytes=chunk_bytes, bucket=bucket)
    assert rows_of(got, *DROPPED) == plain_drop(rows, 8)
    assert all(sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_nothing_survives_the_first_length(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(20)]
    got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert rows_of(got, *DROPPED) == plain_drop(rows, 20)
    with pytest.raises(ValueError):
        substrings.drop_repeats(got.withColumn("text", F.lit("")), 20, 6)


def test_windows_are_doubled():
    words = np.random.default_rng(2).integers(0, 1 << 62, 100).astype(np.uint64)
    whole = substrings.windows(words, 5, 20)
    assert len(whole) == 81 and len(substrings.windows(words[:7], 5, 20)) == 0
    again = substrings.windows(words[30:50], 5, 20)
    assert again[0] == whole[30] and len(set(whole.tolist())) == 81
    packed = np.sort(whole.astype(np.uint32))
    assert (substrings._unpack(substrings._pack(packed)) == packed).all()


def test_levels_read_hashes_instead_of_texts(spark):
    rows = [(2, "a  b a"), (1, None), (None, "é b")]
    made = substrings.chunked(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1))
    held = {r.doc_id: np.frombuffer(r.words, np.uint64).tolist() for r in made.collect()}
    assert held[1] == [] and held[2][0] == held[2][2] != held[2][1] == held[None][1]
    columns = ["chunk", "row", "words", "doc_id"]  # no text
    own = substrings.Chunk(made.select(*columns).toArrow(), [5, 10, 20])
    assert own.ids[:2].tolist() == [1, 2] and own.lengths.tolist() == [0, 3, 2]
    assert own.words.tolist() == held[2] + held[None]
