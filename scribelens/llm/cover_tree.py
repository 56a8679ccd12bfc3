"""Near-duplicate vectors by dual traversal of a cover tree; exact threshold pairs.

Distances are chords between unit vectors, so a cosine of at least t is a chord of at most
sqrt(2 - 2t). The tree is grown from the top: a node that holds too many vectors is cut by a net,
centres from a bounded sample of its vectors whose radius is halved until there are enough, and
every vector goes to its nearest centre. Rounds go on until a node has at most a block of vectors;
one that its own net cannot divide, all copies nearly, is cut by hash. A node knows its true
covering radius. Inside a block the levels go on, down to single vectors.

Both sides descend together, level by level, as tables of node pairs: a pair is dropped when its
centres are farther apart than both radii and the threshold together. The pairs of blocks left
over lie on a grid whose cells hold `GRID` times `GRID` of them or more, so a block is sent once for
as many partners. Inside, most pairs of nodes are dropped by a bound from some components; those
that lie within the threshold as a whole are linked by their sizes without looking further, and
what is left at the last level is compared vector by vector in double precision. A task gives back the number of links of each vector and a spanning
forest of the links, never the pairs themselves.

Equal vectors are one row with a count throughout.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelens.functions.layout import stored
from scribelens.llm.components import components
from scribelens.llm.tables import attach, read, with_run

COSINE = 0.95
BLOCK = 4096  # vectors per block, about; fewer where they are long
BLOCK_VALUES = 1 << 20  # components in a block, about
FANOUT, SAMPLED = 64, 8  # centres a node is cut by, at most, and vectors drawn for each
ROUNDS = 7  # cuts on the way down, at most
GRID, MOST_GRID, SIDES = 8, 24, 8  # blocks on each side of a cell of the grid of block pairs: more, up to a bound, for more than so many cells a side
RADII = (1.0, 0.5, 0.25, 0.125)
SLACK = 1e-7  # keeps rounding from pruning or including a pair that the exact test decides
CHUNK = 1 << 20  # distances held at once
FEW = 1 / 16  # pairs of a chunk that are looked at one by one, at most
ROUNDED = 1e-4  # more than single precision is off by in a bound


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled by a power of two first, so that no square is beyond a double."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _chord(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


def pivots_of(rows: np.ndarray, most: int) -> np.ndarray:
    """Nested nets: radii are halved until there are ``most`` centres or every row is one."""
    centres, radius = [0], 2.0
    nearest = _chord(rows @ rows[0])
    while len(centres) < most and nearest.max() > SLACK:
        while len(centres) < most and nearest.max() > radius:
            far = int(nearest.argmax())
            centres.append(far)
            nearest = np.minimum(nearest, _chord(rows @ rows[far]))
        radius /= 2
    return rows[centres]


def build(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Cover tree of unit rows. For each level l: ``c{l}`` centres, ``r{l}`` covering radii,
    ``f{l}`` the first node of the next level (one more entry at the end); ``order`` lists the
    rows so that every node covers neighbours, ``p{l}`` are the places where nodes begin."""
    n = len(rows)
    groups = [np.arange(n)]
    tree: dict[str, np.ndarray] = {}
    for level, radius in enumerate((*RADII, 0.0)):
        next_groups, centres, first = [], [], [0]
        for group in groups:
            if radius == 0.0 or len(group) == 1:
                next_groups += [group[i : i + 1] for i in range(len(group))]
                centres += group.tolist()
            else:
                left = group
                while len(left):
                    near = _chord(rows[left] @ rows[left[0]]) <= radius
                    near[0] = True
                    next_groups.append(left[near])
                    centres.append(left[0])
                    left = left[~near]
            first.append(len(next_groups))
        groups = next_groups
        if level:
            tree[f"f{level - 1}"] = np.array(first)
        tree[f"c{level}"] = np.array(centres)
        tree[f"r{level}"] = np.array([_chord(rows[g] @ rows[c]).max() if len(g) > 1 else 0.0 for g, c in zip(groups, centres)])
        tree[f"p{level}"] = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
        tree[f"o{level}"] = np.concatenate(groups)
    # Rows of a node stay together on every later level, so the last order serves all.
    tree["order"] = tree[f"o{len(RADII)}"]
    for level in range(len(RADII) + 1):
        del tree[f"o{level}"]
    return tree


class Forest:
    """Spanning forest over numbered vectors."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _expand(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs."""
    na, nb = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    n = na * nb
    pair = np.repeat(np.arange(len(a)), n)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return first_a[a][pair] + place // nb[pair], first_b[b][pair] + place % nb[pair]


def _bounds(x: np.ndarray, rx: np.ndarray, y: np.ndarray, ry: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Short rows for nodes with centres ``x`` and ``y``: where the product of two is below the
    last value, their centres are farther apart than their radii and the limit together.

    A product of unit rows is at most that of some components, the strongest here, plus that of the
    lengths of what is left. The bar that it has to reach, ``1 - (limit + rx + ry)^2 / 2``, is a
    sum of products too.
    """
    dimensions = x.shape[1]
    strongest = np.argsort(-np.square(x).sum(axis=0) - np.square(y).sum(axis=0), kind="stable")
    some = strongest[: int(dimensions / 20 + 4 * math.sqrt(dimensions / 20) + 6)]

    def short(rows: np.ndarray, radii: np.ndarray, first: bool) -> np.ndarray:
        parts = rows[:, some]
        left = np.sqrt(np.maximum(1.0 - np.square(parts).sum(axis=1), 0.0))
        own, one = radii * (radii / 2 + limit), np.ones(len(rows))
        return np.column_stack([parts, left, radii, *((own, one) if first else (one, own))]).astype(np.float32)

    return short(x, rx, True), short(y, ry, False), 1.0 - limit * limit / 2 - SLACK - ROUNDED


def traverse(x: np.ndarray, tx: dict, nx: np.ndarray, y: np.ndarray, ty: dict, ny: np.ndarray, cosine: float, same: bool):
    """Links between the unit rows x and y with multiplicities nx and ny.

    Returns link counts of x and of y, and a `Forest` over x followed by y. With ``same`` both
    are one block: each pair is met once and a row does not meet itself.
    """
    limit = math.sqrt(2.0 - 2.0 * cosine)
    links_x, links_y, forest = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), Forest(len(x) + len(y))
    base = 0 if same else len(x)
    order_x, order_y, last = tx["order"], ty["order"], len(RADII)

    def link(rows_x: np.ndarray, rows_y: np.ndarray) -> None:
        links_x[rows_x] += ny[rows_y].sum()
        links_y[rows_y] += nx[rows_x].sum()
        hub = int(rows_x[0])
        for r in rows_y:
            forest.join(hub, base + int(r))
        for r in rows_x[1:]:
            forest.join(int(r), base + int(rows_y[0]))

    def settle(level: int, a: np.ndarray, b: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decide pairs of nodes; returns those to look into."""
        if level == last:
            hit = dots >= cosine
            ra, rb = order_x[a[hit]], order_y[b[hit]]
            np.add.at(links_x, ra, ny[rb])
            np.add.at(links_y, rb, nx[ra])
            for i, j in zip(ra.tolist(), rb.tolist()):
                forest.join(i, base + j)
            return a[:0], b[:0]
        far = _chord(dots)
        reach = tx[f"r{level}"][a] + ty[f"r{level}"][b]
        inside = (far + reach <= limit - SLACK) & ((a != b) if same else True)
        for i, j in zip(a[inside], b[inside]):
            link(order_x[tx[f"p{level}"][i] : tx[f"p{level}"][i + 1]], order_y[ty[f"p{level}"][j] : ty[f"p{level}"][j + 1]])
        open_ = (far - reach <= limit + SLACK) & ~inside
        return a[open_], b[open_]

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        while level < last and len(a):
            sizes = (tx[f"f{level}"][a + 1] - tx[f"f{level}"][a]) * (ty[f"f{level}"][b + 1] - ty[f"f{level}"][b])
            if sizes.sum() > CHUNK and len(a) > 1:
                half = len(a) // 2
                descend(level, a[:half], b[:half])
                a, b = a[half:], b[half:]
                continue
            a, b = _expand(a, b, tx[f"f{level}"], ty[f"f{level}"])
            level += 1
            if same:
                once = a < b if level == last else a <= b
                a, b = a[once], b[once]
            found = [
                settle(level, a[i : i + CHUNK // 16], b[i : i + CHUNK // 16],
                       np.einsum("ij,ij->i", x[tx[f"c{level}"][a[i : i + CHUNK // 16]]], y[ty[f"c{level}"][b[i : i + CHUNK // 16]]]))
                for i in range(0, len(a), CHUNK // 16)
            ]
            a = np.concatenate([f[0] for f in found]) if found else a[:0]
            b = np.concatenate([f[1] for f in found]) if found else b[:0]

    # Upper levels that join few nodes prune little, as their radii are wide.
    pairs = [len(tx[f"c{level}"]) * len(ty[f"c{level}"]) for level in range(last)]
    top = max(level for level in range(last) if pairs[level] <= 2 * pairs[0])
    top_x, top_y, radii_x, radii_y = x[tx[f"c{top}"]], y[ty[f"c{top}"]], tx[f"r{top}"], ty[f"r{top}"]
    step = max(1, CHUNK // max(1, len(top_y)))
    bound_x, bound_y, least = _bounds(top_x, radii_x, top_y, radii_y, limit + SLACK)
    for start in range(0, len(top_x), step):
        part = top_x[start : start + step]
        possible = np.flatnonzero((bound_x[start : start + step] @ bound_y.T).ravel() >= least)
        if len(possible) <= FEW * len(part) * len(top_y):
            a, b = np.divmod(possible, len(top_y))
            close = np.concatenate([np.einsum("ij,ij->i", part[a[i : i + CHUNK // 16]], top_y[b[i : i + CHUNK // 16]]) for i in range(0, len(a), CHUNK // 16)] or [np.zeros(0)])
            near = close >= 1.0 - np.square(limit + SLACK + radii_x[start + a] + radii_y[b]) / 2.0 - SLACK
            a, b, close = a[near], b[near], close[near]
        else:
            dots = part @ top_y.T
            reach = radii_x[start : start + step, None] + radii_y[None, :]
            a, b = np.nonzero(dots >= 1.0 - np.square(limit + SLACK + reach) / 2.0 - SLACK)
            close = dots[a, b]
        a += start
        if same:
            once = a <= b
            a, b, close = a[once], b[once], close[once]
        a, b = settle(top, a, b, close)
        descend(top, a, b)
    if same:
        links_x += links_y
    return links_x, links_y, forest


def _valid(embedding: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))
    return F.coalesce(~F.exists(embedding, bad) & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _ball(x: np.ndarray) -> tuple[list[float], float]:
    """A centre of unit rows and the radius that covers them."""
    centre = x.mean(axis=0)
    norm = math.sqrt(centre @ centre)
    centre = centre / norm if norm > 1e-9 else x[0]
    return centre.tolist(), float(np.sqrt(np.maximum(1 + centre @ centre - 2 * x @ centre, 0)).max())


def _centres(node: tuple, sample: pa.Table) -> pa.Table:
    """A net over a node's sample, as many centres as are wanted."""
    rows = unit(_matrix(sample.sort_by("vec_id")["embedding"]))
    net = pivots_of(rows, sample["wanted"][0].as_py())
    return pa.table({"at": node[0:1], "net": [net.ravel().tolist()]}, pa.schema([("at", pa.int64()), ("net", pa.list_(pa.float64()))]))


def _cut(key: tuple, rows: pa.Table, net: pa.Table) -> pa.Table:
    """The node each vector goes to: its nearest centre's."""
    x = unit(_matrix(rows["embedding"]))
    centres = np.array(net["net"][0].as_py()).reshape(-1, x.shape[1])
    child = (x @ centres.T).argmax(axis=1)
    node = pa.array(key[0].as_py() * FANOUT + child)
    return rows.select(["vec_id", "n", "embedding"]).append_column("node", node).append_column("root", rows["root"])


ROWS = "vec_id long, n long, embedding array<double>, node long, root long"


def grown(prints: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The vectors with their last node, and per round the table of (node, parent).

    ``prints``: vec_id, n, embedding. Vectors of different lengths have roots of their own. A node
    that needs no cut is its own child.
    """
    length = F.size("embedding").cast("long")
    now = stored(prints.select("vec_id", "n", F.col("embedding").cast("array<double>").alias("embedding"), length.alias("node"), length.alias("root")), "nodes")
    steps: list[DataFrame] = []
    for _ in range(ROUNDS):
        sizes = now.groupBy("node", "root").agg(F.count("*").alias("size"))
        most = F.least(F.lit(block), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.col("root"))))
        large = stored(sizes.withColumn("most", most).where("size > most"), "large-nodes")
        if large.isEmpty():
            break
        wanted = F.least(F.lit(FANOUT), F.ceil(2 * F.col("size") / F.col("most"))).cast("int")
        large = large.withColumn("wanted", wanted).withColumn("share", F.col("wanted") * SAMPLED / F.col("size"))
        salts = F.ceil(F.col("size") / (4 * F.col("most"))).cast("int")  # groups of a few blocks
        joined = now.join(large.select("node", "wanted", "share", salts.alias("salts")), "node")
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(len(steps))), F.lit(1 << 30)) < F.col("share") * (1 << 30)
        sample = joined.where(drawn).select("node", "vec_id", "embedding", "wanted")
        nets = sample.groupBy("node").applyInArrow(_centres, "at long, net array<double>")
        # One centre divides nothing.
        nets = stored(nets.join(large.select(F.col("node").alias("at"), "root"), "at").where(F.size("net") > F.col("root")).drop("root"), "nets")
        if nets.isEmpty():
            break
        spread = nets.join(large.select(F.col("node").alias("at"), salts.alias("salts")), "at").select(
            "at", "net", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("part")
        )
        salted = joined.join(nets.select(F.col("at").alias("node")), "node", "left_semi").withColumn(
            "salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int")
        )
        cut = salted.groupBy("node", "salt").cogroup(spread.groupBy("at", "part")).applyInArrow(_cut, ROWS)
        rest = now.join(nets.select(F.col("at").alias("node")), "node", "left_anti")
        # Numbers of nodes are those of their paths, so a node that stays moves on as its first child.
        kept = rest.withColumn("node", F.col("node") * FANOUT)
        now = stored(cut.unionByName(kept.select("vec_id", "n", "embedding", "node", "root")), "nodes")
        steps.append(now.select("node").distinct().withColumn("parent", F.expr(f"node DIV {FANOUT}")))
    return now, steps


BLOCKS = "node long, cut long, root long, size long, centre array<double>, radius double, tree binary"


def _pack_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """One row: the block's vectors, its tree, ids and counts."""
    given = _matrix(rows["embedding"])
    x = unit(given)
    held = given.astype(np.float32) if (given.astype(np.float32) == given).all() else given
    out = io.BytesIO()
    small = {k: v if k[0] == "r" else v.astype(np.int32) for k, v in build(x).items()}
    np.savez(out, given=held, ids=rows["vec_id"].to_numpy(), n=rows["n"].to_numpy(), **small)
    centre, radius = _ball(x)
    values = [[k.as_py()] for k in key] + [[rows["root"][0].as_py()], [len(x)], [centre], [radius], [out.getvalue()]]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.float64()), pa.float64(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in BLOCKS.split(", ")])


def _unpacked(tree: bytes) -> dict[str, np.ndarray]:
    block = {k: v if v.dtype != np.int32 else v.astype(np.int64) for k, v in np.load(io.BytesIO(tree)).items()}
    block["x"] = unit(block.pop("given").astype(np.float64))
    return block


def _gap(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def _balls(nodes: DataFrame) -> DataFrame:
    """(node, centre, radius) that cover all balls of (node, centre, radius) with that node."""
    # The ball around the first one's centre; one row per ball, so groups are small.
    first = nodes.groupBy("node").agg(F.min_by("centre", F.struct("radius", "centre")).alias("middle"))
    far = nodes.join(first, "node").groupBy("node").agg(
        F.first("middle").alias("centre"), F.max(_gap("centre", "middle") + F.col("radius")).alias("radius")
    )
    return far.select("node", "centre", "radius")


def _near(pairs: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b), a <= b, whose nodes (node, centre, radius) can hold a link."""
    one = nodes.select(F.col("node").alias("a"), F.col("centre").alias("_ca"), F.col("radius").alias("_ra"))
    two = nodes.select(F.col("node").alias("b"), F.col("centre").alias("_cb"), F.col("radius").alias("_rb"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(_gap("_ca", "_cb") - F.col("_ra") - F.col("_rb") <= limit + SLACK).select("a", "b")


def near_nodes(steps: list[DataFrame], blocks: DataFrame, limit: float) -> DataFrame:
    """Dual traversal of the upper levels: pairs (a, b), a <= b, of last nodes that can hold a link.

    The radii of a level cover the blocks below; a pair is looked into only if its parents' pair
    was kept.
    """
    levels = [_balls(blocks.select("node", "centre", "radius"))]
    for step in reversed(steps):
        above = levels[0].join(step, "node").select(F.col("parent").alias("node"), "centre", "radius")
        levels.insert(0, _balls(above))
    levels = [stored(x, "level") for x in levels]
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for step, nodes in zip(steps, levels[1:]):
        one = step.select(F.col("parent").alias("a"), F.col("node").alias("_a"))
        two = step.select(F.col("parent").alias("b"), F.col("node").alias("_b"))
        children = pairs.join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <= b")
        pairs = stored(_near(children, nodes, limit), "node-pairs")
    return pairs


def _compared(cell: tuple, blocks: pa.Table, cosine: float, side: int) -> pa.Table:
    """Links of all near pairs of blocks in one cell of the grid: blocks of its row and its column."""
    limit = math.sqrt(2.0 - 2.0 * cosine)
    ids, counts, roots = [], [], []
    held = {}
    for number, centre, radius, tree in zip(*(blocks[c].to_pylist() for c in ("number", "centre", "radius", "tree"))):
        held[number] = np.array(centre), radius, _unpacked(tree)
    row, column = ([n for n in sorted(held) if n // side == part.as_py()] for part in cell)
    for i, j in ((i, j) for i in row for j in column if i <= j):
        (ca, ra, a), (cb, rb, b) = held[i], held[j]
        if len(ca) != len(cb) or math.sqrt(((ca - cb) ** 2).sum()) - ra - rb > limit + SLACK:
            continue
        links_a, links_b, forest = traverse(a["x"], a, a["n"], b["x"], b, b["n"], cosine, i == j)
        for block, links, base in [(a, links_a, 0)] + [(b, links_b, len(a["x"]))] * (i != j):
            for k in np.flatnonzero(links):
                root = forest.find(base + int(k))
                ids.append(int(block["ids"][k]))
                counts.append(int(links[k]))
                roots.append(int(a["ids"][root] if root < len(a["x"]) else b["ids"][root - len(a["x"])]))
    return pa.table({"u": pa.array(ids, pa.int64()), "links": pa.array(counts, pa.int64()), "v": pa.array(roots, pa.int64())})


def block_table(prints: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The packed blocks, numbered so that neighbours in the tree have neighbouring numbers."""
    rows, steps = grown(prints, block)
    most = F.least(F.lit(block), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_VALUES) / F.col("root"))))
    cuts = rows.groupBy("node", "root").agg(F.count("*").alias("size")).select("node", F.ceil(F.col("size") / most).cast("long").alias("cuts"))
    cut = rows.join(cuts, "node").withColumn("cut", F.pmod(F.xxhash64("vec_id"), F.col("cuts")))
    packed = stored(cut.groupBy("node", "cut").applyInArrow(_pack_blocks, BLOCKS), "packed-blocks")
    # A block is some thousand vectors; their numbers pass one task.
    order = Window.orderBy("root", "node", "cut")
    numbers = packed.select("node", "cut", (F.row_number().over(order) - 1).cast("long").alias("number"))
    return stored(packed.join(numbers, ["node", "cut"]), "blocks"), steps


def near_blocks(blocks: DataFrame, steps: list[DataFrame], cosine: float) -> DataFrame:
    """Pairs (a, b), a <= b, of the numbers of blocks that can hold a link."""
    limit = math.sqrt(2.0 - 2.0 * cosine)
    nodes = near_nodes(steps, blocks, limit)
    one = blocks.select(F.col("node").alias("a"), F.col("number").alias("_a"))
    two = blocks.select(F.col("node").alias("b"), F.col("number").alias("_b"))
    pairs = nodes.join(one, "a").join(two, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    return _near(pairs, blocks.select(F.col("number").alias("node"), "centre", "radius"), limit)


def vector_links(prints: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """u, links, v: for each near pair of blocks and vector linked in it, its number of links there
    and a vector it is connected with. ``prints``: vec_id, n (copies), embedding."""
    blocks, steps = block_table(prints, block or BLOCK)
    # A block is sent once to each cell of its row and column, so many blocks have wider cells.
    side = max(GRID, min(MOST_GRID, -(-blocks.count() // SIDES)))
    grid = near_blocks(blocks, steps, cosine).select(F.expr(f"a DIV {side}").alias("row"), F.expr(f"b DIV {side}").alias("column")).distinct()
    grid = stored(grid, "grid")
    packed = blocks.select(F.expr(f"number DIV {side}").alias("_part"), "number", "centre", "radius", "tree")
    across = grid.select("row", "column", F.col("row").alias("_part"))
    down = grid.where("row <> column").select("row", "column", F.col("column").alias("_part"))
    sent = across.unionByName(down).join(packed, "_part").drop("_part")
    return sent.groupBy("row", "column").applyInArrow(lambda cell, rows: _compared(cell, rows, cosine, side), "u long, links long, v long")


def vector_groups(vectors: DataFrame, cosine: float = COSINE, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows within the cosine, ``component_id`` is the smallest vec_id
    reachable over links. Vectors that are null, empty, zero or hold a null or a component that
    is not finite link with nothing, and vectors of different lengths do not link. Repeated rows
    link with each other. Rows without vec_id count as vectors but are no component's id unless
    alone. Other columns are ignored; an empty table gives an empty result.
    """
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = stored(with_run(named.withColumn("valid", _valid(F.col("embedding")))), "vectors")
    good = rows.where("valid").drop("valid", "row_id")
    # A group of equal vectors is known by a number of its own: ids may be null or repeated.
    folded = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    prints = stored(folded.withColumn("print", F.monotonically_increasing_id()), "prints")
    links = stored(vector_links(prints.select(F.col("print").alias("vec_id"), "n", "embedding"), cosine), "links")
    tree = components(links.select("u", "v"))
    members = tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())
    smallest = members.join(prints, members.node == prints.print).groupBy("root").agg(F.min("first").alias("smallest"))
    merged = members.join(smallest, "root").select(F.col("node").alias("print"), "smallest")
    counted = links.groupBy(F.col("u").alias("print")).agg(F.sum("links").alias("links"))
    values = (
        prints.join(merged, "print", "left")
        .join(counted, "print", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("smallest", "first").alias("component_id"),
        )
    )
    linked = attach(good, values, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_cover_tree(spark, folder: str) -> DataFrame:
    return vector_groups(read(spark, folder, "embeddings"))
