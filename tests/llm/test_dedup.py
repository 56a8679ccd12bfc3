"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scribelens.llm import exact_dedup, line_dedup, simhash
from scribelens.llm.components import components
from scribelens.llm.cuckoo import CuckooFilter
from tests.compare import connect, difference
from tests.llm.conftest import TEXTS, rows_of

FOLDER = "/root/testdata/sf0.001"


def by_union(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_groups_of_messy_rows(cluttered):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(plain(t), []).append((-len(t or ""), float("inf") if i is None else i))
    want = []
    for i, t in TEXTS:
        best = min(groups[plain(t)])[1]
        keep = None if best == float("inf") else best
        want.append((i, keep, len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()))
    got = exact_dedup.exact_groups(cluttered, fan=2).cache()
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == len(groups)
    assert got.where("kept AND NOT doc_id <=> keep_id").isEmpty()


def test_exact_runs_merge_alike_for_every_fan(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("text")
    )
    results = [rows_of(exact_dedup.exact_groups(rows.repartition(p), fan=f), "doc_id", "keep_id", "group_size", "kept") for p, f in [(1, 2), (9, 2), (9, 4)]]
    assert results[0] == results[1] == results[2]


def test_exact_stage_keeps_columns_and_one_row_per_group(cluttered, empty):
    kept = exact_dedup.drop_copies(cluttered)
    assert kept.columns == cluttered.columns
    assert rows_of(kept, "doc_id") == [(1,), (10,), (11,), (12,), (13,), (2,), (5,), (6,), (7,), (8,), (9,), (None,)][1:]
    assert exact_dedup.drop_copies(empty).isEmpty() and exact_dedup.exact_groups(empty).isEmpty()


def reference_print(text):
    from xxhash import xxh64_intdigest

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_messy_rows(cluttered):
    want = sorted(((i, f"{reference_print(t):016x}") for i, t in TEXTS), key=repr)
    got = simhash.near_groups(cluttered).cache()
    assert rows_of(got, "doc_id", "fingerprint") == want
    zero = {r.component_id for r in got.where("fp = 0").collect()}
    assert zero == {3}


@pytest.mark.parametrize("blocks,crowd,max_bits", [(4, 64, 2), (3, 64, 2), (5, 64, 2), (4, 1, 2), (4, 64, 1), (4, 1, 1)])
def test_links_have_the_components_of_all_close_pairs(spark, blocks, crowd, max_bits):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.choice([1, 1, 2, 3])):
            p ^= 1 << b
        prints.append(p)
    signed = sorted({simhash._signed(p) for p in prints} | {0, -1})
    close = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits]
    want = by_union(signed, close)
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), max_bits, blocks, crowd)
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= max_bits for r in edges.collect())
    roots = {r.node: r.root for r in components(edges).collect()}
    assert {s: roots.get(s, s) for s in signed} == want


def test_near_stage_keeps_one_document_per_group(spark, cluttered, empty):
    kept = simhash.drop_near_copies(cluttered)
    assert kept.columns == cluttered.columns
    groups = by_union([k for k, _ in enumerate(TEXTS)], [
        (a, b) for a, (_, s) in enumerate(TEXTS) for b, (_, t) in enumerate(TEXTS[:a])
        if (reference_print(s) ^ reference_print(t)).bit_count() <= 2
    ])
    assert kept.count() == len(set(groups.values()))
    assert simhash.drop_near_copies(empty).isEmpty() and simhash.near_groups(empty).isEmpty()
    nameless = spark.createDataFrame([(None, "a b c d e"), (None, "v w x y z"), (None, "a b c d e")], "doc_id bigint, text string")
    assert rows_of(simhash.drop_near_copies(nameless), "text") == [("a b c d e",), ("v w x y z",)]


def test_near_stage_keeps_different_texts_of_one_doc_id(spark):
    rows = [(3, "a b c d e"), (5, "A b c d e"), (5, "v w x y z"), (5, "v w x y z"), (7, "k l m n o"), (7, "p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(3, "a b c d e"), (5, "v w x y z"), (7, "k l m n o"), (7, "p q r s t")]
    assert rows_of(simhash.drop_near_copies(docs), "doc_id", "text") == want


def test_near_stage_keeps_one_of_close_texts_of_one_doc_id(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)]
    for i in range(400):
        other = " ".join([*words[:i], "x", *words[i + 1 :]])
        if 0 < (reference_print(other) ^ reference_print(texts[0])).bit_count() <= 2:
            texts.append(other)
            break
    assert len(texts) == 2
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id bigint, text string")
    assert simhash.drop_near_copies(docs).count() == 1


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(60)] + [(900, 900)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    nodes = {n for e in edges for n in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {n: got.get(n, n) for n in nodes} == by_union(nodes, edges)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).isEmpty()


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_lines_of_messy_rows(cluttered, empty):
    assert rows_of(line_dedup.dedup_lines(cluttered), *COLUMNS) == brute_lines(TEXTS)
    assert line_dedup.dedup_lines(empty).isEmpty()


def test_line_index_is_reversible(spark):
    rng = random.Random(1)
    made = [(i, "\n".join(f"line number {rng.randrange(40)} of many" for _ in range(rng.randrange(6)))) for i in range(60)]
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    first, second = frame(made[20:]), frame(made[:20])
    a, b = line_dedup.stored_references(first), line_dedup.stored_references(second)
    index = line_dedup.LineIndex.build(a)
    both = index.insert(b)
    everything = line_dedup.stored_references(frame(made))
    assert rows_of(both.clean(frame(made), everything), *COLUMNS) == brute_lines(made)
    back = both.delete(b)
    assert rows_of(back.counts, "high", "low", "n", "first") == rows_of(index.counts, "high", "low", "n", "first")
    assert rows_of(back.clean(first, a), *COLUMNS) == brute_lines(made[20:])


def test_cuckoo_filter_adds_finds_and_removes():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, (3000, 2))
    held = CuckooFilter(len(keys))
    assert held.add(keys[:, 0].copy(), keys[:, 1].copy()) and held.contains(keys[:, 0].copy(), keys[:, 1].copy()).all()
    again = CuckooFilter.load(held.dump())
    again.remove(keys[:1500, 0].copy(), keys[:1500, 1].copy())
    assert again.contains(keys[1500:, 0].copy(), keys[1500:, 1].copy()).all()
    assert again.contains(keys[:1500, 0].copy(), keys[:1500, 1].copy()).mean() < 0.01
    again.remove(keys[1500:, 0].copy(), keys[1500:, 1].copy())
    assert not again.table.any()
    assert not CuckooFilter(8).add(keys[:, 0].copy(), keys[:, 1].copy())


def test_shards_grow_with_the_index(spark, empty, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 100)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some line with number "), F.col("id") % 500).alias("text"))
    index = line_dedup.LineIndex.build(line_dedup.stored_references(empty))
    given = line_dedup.stored_references(rows)
    grown = index.insert(given)
    assert index.shards == 1 and grown.shards >= 5 and grown.filters.count() == grown.shards
    assert grown.repeated(given).count() == 500
    assert grown.delete(given).counts.isEmpty()


def test_a_full_filter_is_built_anew(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some line with number "), F.col("id") % 2000).alias("text"))
    small = rows.where("id < 2010").drop("id") if "id" in rows.columns else rows.where("doc_id < 2010")
    index = line_dedup.LineIndex.build(line_dedup.stored_references(small))
    rest = line_dedup.stored_references(rows.where("doc_id >= 2010"))
    grown = index.insert(rest)
    assert grown.counts.count() == 2000
    assert grown.repeated(rest).count() == 1990


@pytest.mark.parametrize("name,module", [("op4_line_dedup", line_dedup), ("op8_exact_dedup", exact_dedup)])
def test_against_sql(spark, name, module):
    assert difference(getattr(module, name)(spark, FOLDER), connect(FOLDER), module.ORACLE) is None
