"""Merkle manifest of a dataset: one digest for all rows, and a proof per row.

A row's leaf is the SHA-256 of its fields. Per language the leaves stand in order of doc_id, and
every `FAN` consecutive nodes are hashed into their parent until one is left, the subroot; the
subroots, in order of language, are hashed the same way into the root.

The tree is one of SHA midstates: a parent keeps a copy of its hash state from before each child
slot. To fold a changed leaf up, the state of its slot is resumed with the new digest and the
siblings to its right only; what stands to its left is never hashed again.

Trees are cut into blocks of `FAN` ** `LEVELS` consecutive nodes of one level, each the work of
one group: a block's root is a node of the next round, and there are as many rounds as the number
of leaves has digits to that base. Downwards, a block is handed the steps above it (for each
level the digests left and right of its ancestor), from which it restores the states once for all
its rows. No group is larger than a block, whatever share of the rows one language has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.llm.tables import LOWER, UPPER, numbered, read

FAN, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "grp string, pos long, total long, digest string"
STEPS = "steps array<struct<left: binary, right: binary>>, subroot string, root string"
FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields cannot run into each other; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


class Block:
    """Consecutive nodes of one level and the levels above them, with the states of every parent."""

    def __init__(self, nodes: list[bytes], levels: int, alone: bool):
        """``alone``: the block holds its whole tree, which ends when one node is left."""
        self.states: list[list] = []  # per level and node: the parent's state before the node's slot
        self.beside: list[list[tuple[bytes, bytes]]] = []  # and the digests left and right of it
        while len(nodes) > 1 if alone else len(self.states) < levels:
            states, beside, above = [], [], []
            for at in range(0, len(nodes), FAN):
                children = nodes[at : at + FAN]
                state = sha256()
                for i, child in enumerate(children):
                    states.append(state.copy())
                    beside.append((b"".join(children[:i]), b"".join(children[i + 1 :])))
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.states.append(states)
            self.beside.append(beside)
            nodes = above
        self.root = nodes[0]

    def steps(self, at: int) -> list[tuple[bytes, bytes]]:
        """The digests left and right of a node and its ancestors, upwards."""
        found = []
        for beside in self.beside:
            found.append(beside[at])
            at //= FAN
        return found

    def fold(self, at: int, digest: bytes) -> bytes:
        """The block's root with another digest in place of a node's."""
        for states, beside in zip(self.states, self.beside):
            state = states[at].copy()
            state.update(digest)
            state.update(beside[at][1])
            digest = state.hexdigest().encode()
            at //= FAN
        return digest


class Above:
    """The steps from a block's root to the root of all, with their states."""

    def __init__(self, steps: list[dict]):
        self.steps = [(sha256(s["left"]), s["left"], s["right"]) for s in steps]

    def fold(self, digest: bytes) -> bytes:
        for before, _, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def _sorted(nodes: pa.Table, levels: int) -> tuple[pa.Table, Block]:
    nodes = nodes.sort_by("pos")
    digests = [d.encode() for d in nodes["digest"].to_pylist()]
    return nodes, Block(digests, levels, nodes["total"][0].as_py() <= FAN**levels)


def _raise(key: tuple, nodes: pa.Table, *, levels: int) -> pa.Table:
    """The root of a block, as a node of the next round."""
    nodes, block = _sorted(nodes, levels)
    total = -(-nodes["total"][0].as_py() // FAN**levels)
    return pa.table({"grp": key[0:1], "pos": key[1:2], "total": [total], "digest": [block.root.decode()]}, _schema(NODE))


def _lower(key: tuple, nodes: pa.Table, above: pa.Table, *, levels: int) -> pa.Table:
    """The steps above every node of a block, from those above the block."""
    nodes, block = _sorted(nodes, levels)
    rest = above["steps"][0].as_py()
    steps = [[{"left": a, "right": b} for a, b in block.steps(i)] + rest for i in range(nodes.num_rows)]
    n = nodes.num_rows
    columns = {"grp": nodes["grp"], "pos": nodes["pos"], "steps": steps}
    columns |= {c: [above[c][0].as_py()] * n for c in ("subroot", "root")}
    return pa.table(columns, _schema("grp string, pos long, " + STEPS))


def _fold(key: tuple, leaves: pa.Table, above: pa.Table, *, levels: int) -> pa.Table:
    """Proof and folded root of every leaf of a block."""
    leaves, block = _sorted(leaves, levels)
    higher = Above(above["steps"][0].as_py())
    beyond = [left + right for _, left, right in higher.steps]
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    proofs, folded = [], []
    for i, (digest, changed) in enumerate(zip(leaves["digest"].to_pylist(), leaves["changed"].to_pylist())):
        proof = sha256()
        for left, right in block.steps(i):
            proof.update(left + right)
        for both in beyond:
            proof.update(both)
        proofs.append(proof.hexdigest())
        folded.append(higher.fold(block.fold(i, (changed or digest).encode())).decode())
    n = len(folded)
    columns = {
        "doc_id": leaves["doc_id"], "leaf": leaves["digest"], "subroot": [subroot] * n, "root": [root] * n,
        "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
    }
    return pa.table(columns, _schema(FOLDED))


_STEP = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    plain = ddl.replace(", " + STEPS, ", steps steps, subroot string, root string")
    return pa.schema([(n, _STEP if kind == "steps" else _TYPES[kind]) for n, kind in map(str.split, plain.split(", "))])


def _under(nodes: DataFrame, above: DataFrame, levels: int):
    """Blocks of nodes with the steps above each."""
    keyed = above.select(F.col("grp").alias("tree"), F.col("pos").alias("root_pos"), "steps", "subroot", "root")
    return _blocks(nodes, levels).cogroup(keyed.groupBy("tree", "root_pos"))


def _blocks(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.expr(f"pos DIV {FAN**levels}")).groupBy("grp", "block")


def _rounds(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of these, and so on.

    A tree takes no part in further rounds once one node (``total`` 1) is left of it.
    """
    rounds = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        active = _blocks(rounds[-1].where("total > 1").select("grp", "pos", "total", "digest"), levels)
        rounds.append(stored(active.applyInArrow(lambda key, block: _raise(key, block, levels=levels), NODE), name))
        most = -(-most // FAN**levels)
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.where("total = 1").select("grp", "digest") for r in rounds])


def _descend(rounds: list[DataFrame], tops: DataFrame, last, schema: str, levels: int) -> DataFrame:
    """Hand the steps above each tree (``tops``: grp and `STEPS`) down to the first round.

    There ``last`` makes the result from a block's nodes and the steps above it.
    """
    below = None  # steps above the blocks of a round, by grp and pos of the block
    for i in range(len(rounds) - 1, -1, -1):
        ended = rounds[i].where("total = 1").select("grp", "pos").join(tops, "grp")
        active = rounds[i].where("total > 1")
        if i == 0:
            above = ended if below is None else ended.unionByName(below)
            return _under(rounds[0], above, levels).applyInArrow(lambda key, block, over: last(key, block, over, levels=levels), schema)
        if below is not None:
            lowered = _under(active, below, levels).applyInArrow(lambda key, block, over: _lower(key, block, over, levels=levels), "grp string, pos long, " + STEPS)
            ended = ended.unionByName(lowered)
        below = ended


@dataclass(frozen=True)
class Manifest:
    """The rounds of the trees per group, the steps above each tree, and the order of the groups.

    All are tables in the shared folder. ``rounds[0]`` holds the leaves: grp, pos, total, digest,
    doc_id, changed. ``tops``: grp, steps, subroot, root.
    """

    rounds: list[DataFrame]
    tops: DataFrame
    levels: int

    @staticmethod
    def build(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
        """``leaves``: doc_id, grp (never null), digest, changed (a digest to fold in its place, or null).

        Leaves of one group stand in order of doc_id, nulls first, then of their digests; rows
        alike in these are interchangeable. Groups stand in bytewise order of ``grp``.
        """
        rounds = _rounds(numbered(leaves, "grp", ["doc_id", "digest", "changed"], "leaves"), "nodes", levels)
        subroots = stored(_roots(rounds), "subroots")
        named = numbered(subroots.select(F.lit("").alias("all"), "grp", "digest"), "all", ["grp"], "groups")
        nodes = named.select(F.col("all").alias("grp"), "pos", "total", "digest", F.col("grp").alias("name"))
        tree = _rounds(nodes, "tree", levels)
        nothing = F.array().cast("array<struct<left: binary, right: binary>>")
        top = _roots(tree).select("grp", nothing.alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        return Manifest(rounds, stored(_descend(tree, top, _name_steps, "grp string, " + STEPS, levels), "tops"), levels)

    def prove(self) -> DataFrame:
        """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

        ``folded_root`` is recomputed from ``changed``, else from the leaf, and the siblings as
        they were; ``proof_sha256`` is the hash of these, upwards and from left to right.
        """
        return _descend(self.rounds, self.tops, _fold, FOLDED, self.levels)


def _name_steps(key: tuple, nodes: pa.Table, above: pa.Table, *, levels: int) -> pa.Table:
    """As `_lower`, for the trees' roots: by the tree's name, with its root as subroot."""
    nodes = nodes.sort_by("pos")
    lowered = _lower(key, nodes, above, levels=levels)
    columns = {"grp": nodes["name"], "steps": lowered["steps"], "subroot": nodes["digest"], "root": lowered["root"]}
    return pa.table(columns, _schema("grp string, " + STEPS))


def doc_leaves(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The leaves of documents, as `Manifest.build` takes them.

    Where ``tampered`` holds, ``changed`` is the leaf with A-Z of the text lower-cased. Null
    fields, groups, ids and texts are allowed: a null group comes before all others.
    """
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in columns]
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp"),
        leaf(*map(F.col, columns)).alias("digest"),
        (F.lit(None) if tampered is None else F.when(tampered, leaf(*changed))).cast("string").alias("changed"),
    )


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, proof and root; where 3 divides the id's CRC, a tampered text is folded.

    Empty table: no rows. Repeated rows are leaves of their own, next to each other. Null ids
    come first and are not tampered with. The tables the manifest is stored in stay in the
    shared folder.
    """
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return Manifest.build(doc_leaves(read(spark, folder, "documents"), third)).prove()


# CRC-32 of a decimal number, digit by digit and bit by bit.
_CRC = """list_reduce(
    list_transform(range(length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
    4294967295)"""


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


_SQL_LEAF = " || ".join(map(_sql_field, COLUMNS))
ORACLE = f"""
WITH RECURSIVE
docs AS (
    SELECT doc_id, coalesce('+' || lang, '') AS g, text, sha256({_SQL_LEAF}) AS leaf,
           xor({_CRC}, 4294967295) % 3 = 0 AS tampered,
           sha256({_SQL_LEAF.replace(_sql_field("text"), _sql_field("low"))}) AS changed
    FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
nodes AS (
    SELECT 0 AS l, g, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves
    UNION ALL
    SELECT l + 1, g, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {FAN - 1}) // {FAN}
    FROM nodes WHERE n > 1 GROUP BY l, g, pos // {FAN}),
subroots AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS l, pos, digest, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT l + 1, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {FAN - 1}) // {FAN}
    FROM tops WHERE n > 1 GROUP BY l, pos // {FAN}),
-- The digests left and right of a node, over both trees; the second tree's levels come after the first's.
beside AS (
    SELECT a.l, a.g, a.pos,
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
    FROM nodes a JOIN nodes b ON a.l = b.l AND a.g = b.g AND a.pos // {FAN} = b.pos // {FAN} WHERE a.n > 1
    GROUP BY a.l, a.g, a.pos
    UNION ALL
    SELECT 100 + a.l, NULL, a.pos,
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), ''),
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '')
    FROM tops a JOIN tops b ON a.l = b.l AND a.pos // {FAN} = b.pos // {FAN} WHERE a.n > 1
    GROUP BY a.l, a.pos),
paths AS (
    SELECT d.g, d.pos, x.l, x.before, x.after FROM leaves d
    JOIN beside x ON x.g = d.g AND x.pos = d.pos // ({FAN} ** x.l)::BIGINT
    UNION ALL
    SELECT d.g, d.pos, x.l, x.before, x.after FROM leaves d JOIN subroots s ON s.g = d.g
    JOIN beside x ON x.g IS NULL AND x.pos = s.pos // ({FAN} ** (x.l - 100))::BIGINT),
proofs AS (
    SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY l)) AS proof,
           list({{'before': before, 'after': after}} ORDER BY l) AS steps FROM paths GROUP BY g, pos),
folded AS (
    SELECT d.doc_id, d.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
           coalesce(p.proof, sha256('')) AS proof_sha256,
           list_reduce(list_transform(coalesce(p.steps, []), lambda s: [s.before, s.after]),
                       lambda a, s: [sha256(s[1] || a[1] || s[2])],
                       [CASE WHEN d.tampered THEN d.changed ELSE d.leaf END])[1] AS folded_root
    FROM leaves d JOIN subroots s ON s.g = d.g LEFT JOIN proofs p ON p.g = d.g AND p.pos = d.pos)
SELECT *, folded_root = root AS verified FROM folded"""
