"""SimHash near-deduplication with pigeonhole blocks.

A fingerprint has 64 bits. Equal fingerprints are folded first. For a distance of at most d the
bits are cut into b blocks; two fingerprints that close agree in at least b - d blocks, so each
is filed under every choice of b - d blocks, and fingerprints filed together are compared.

A file with very many fingerprints (a large group of near copies) is not compared pair by pair:
its members are hung on the neighbours they have in common. Two fingerprints differ in at most
two bits exactly if some value lies within one bit of both, and at most 65 fingerprints lie
within one bit of a value, so every member is written 65 times however large its file is. This
loses no link, whatever the bits that differ.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from scribelens.functions.layout import stored
from scribelens.llm.components import components
from scribelens.llm.tables import attach, map_batches, read, utf8, with_run

SHINGLE, SEED, MAX_BITS, BLOCKS = 3, 42, 2, 4
CROWD = 64  # a file with more fingerprints is linked through common neighbours


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words.

    ``bytes`` methods treat exactly the ASCII white space as white space and A-Z as capitals.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        stops = ends[shingle - 1 :].tolist()
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed integer), one row per input row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_signed(fingerprint(t, shingle, seed)) for t in utf8(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

        return step

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, make, "doc_id long, fp long")


def block_masks(max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Masks of every choice of ``blocks - max_bits`` blocks."""
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, blocks - max_bits)]


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` within ``max_bits`` bits.

    In files of up to ``crowd`` members every close pair is an edge; larger ones give edges with
    the same components. Each edge joins fingerprints that are close themselves.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("common neighbours serve distances up to 2")
    masks = [F.lit(_signed(m)) for m in block_masks(max_bits, blocks)]
    filed = prints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in masks])).alias("choice", "key")
    )
    sizes = filed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(filed.join(sizes, ["choice", "key"]), "blocks")
    few = shared.where(F.col("n") <= crowd).select("choice", "key", "fp")
    pairs = (
        few.select("choice", "key", F.col("fp").alias("u"))
        .join(few.select("choice", "key", F.col("fp").alias("v")), ["choice", "key"])
        .where((F.col("u") > F.col("v")) & _near("u", "v", max_bits))
        .select("u", "v")
    )
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    return pairs.unionByName(_common_neighbours(many, max_bits)).distinct()


def _common_neighbours(prints: DataFrame, max_bits: int) -> DataFrame:
    flips = [0] + ([1 << i for i in range(64)] if max_bits else [])
    around = prints.select(
        "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(f))) for f in flips])).alias("z")
    )
    # At most 65 members each. With max_bits = 1 only the value itself connects.
    stars = around.groupBy("z").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    hub = F.array_min("members") if max_bits == 2 else F.when(F.array_contains("members", F.col("z")), F.col("z"))
    return (
        stars.select(hub.alias("u"), F.explode("members").alias("v"))
        .where((F.col("u") != F.col("v")) & _near("u", "v", max_bits))
    )


def near_groups(
    docs: DataFrame,
    shingle: int = SHINGLE,
    seed: int = SEED,
    max_bits: int = MAX_BITS,
    blocks: int = BLOCKS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, fp, fingerprint (16 hex digits), root and component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits`` bits,
    ``root`` the smallest fp. Null and empty texts and those without words have fingerprint 0, linked like any other. A
    null doc_id is never the smallest, unless a group has no other. Repeated rows repeat in the
    result; an empty table gives an empty result. Other columns are ignored.
    """
    rows = stored(with_run(fingerprints(docs, shingle, seed, text, doc_id)), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    tree = components(links(prints, max_bits, blocks))
    members = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    first = members.join(prints, members.node == prints.fp).groupBy("root").agg(F.min("first").alias("smallest"))
    merged = members.join(first, "root").select(F.col("node").alias("fp"), "root", "smallest")
    values = prints.join(merged, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("smallest", "first").alias("component_id")
    )
    return attach(rows, values, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id"
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """One row of ``docs`` per group, that of the smallest doc_id, all columns unchanged.

    A row is known by its doc_id and its fingerprint: rows that share both are one document, and
    rows of one doc_id whose texts are not close belong to different groups and stay both. Where
    a group holds its smallest doc_id with several fingerprints, the smallest of these stays; of
    a group without any doc_id the root stays.
    """
    nameless = F.col("component_id").isNull() & (F.col("fp") == F.col("root"))
    kept = (
        near_groups(docs, text=text, doc_id=doc_id, **params)
        .where((F.col("doc_id") == F.col("component_id")) | nameless)
        .groupBy("root")
        .agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"))
    )
    given = {k: v for k, v in params.items() if k in ("shingle", "seed")}

    @F.arrow_udf(LongType())
    def print_of(texts: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t, **given)) for t in utf8(texts)], pa.int64())

    name = lambda c, fp: F.concat(F.coalesce(c.cast("string"), F.lit("null")), F.lit("/"), fp.cast("string"))
    theirs = kept.select(name(F.col("doc_id"), F.col("fp")).alias("__identity__"))
    ours = docs.withColumn("__identity__", name(F.col(doc_id).cast("long"), print_of(F.col(text).cast("string"))))
    return ours.join(theirs, "__identity__", "left_semi").dropDuplicates(["__identity__"]).drop("__identity__")


def op9_simhash(spark, folder: str) -> DataFrame:
    return near_groups(read(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")
