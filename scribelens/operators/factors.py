"""Implicit-feedback matrix factorisation and exact top-n scoring of factor tables."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelens.functions.layout import fan_out, stored
from scribelens.functions.ranking import stable, top_k
from scribelens.functions.validate import int32
from scribelens.session import shared_dir

BLOCK_ROWS = 4096
CELLS = 256  # directions of the upper level of the tree of items
NODES = 1 << 16  # nodes of the lower level, about, at most
BATCH_USERS = 512  # users scored at once, at most
HELD = 1 << 20  # list entries held for the users scored at once
SHELF_ROWS = 1 << 16  # items of a shelf, and users that meet it in one group, at most about
FACTORS_SENT = 1 << 22  # factors that half an iteration of the fit sends, as far as the least number of blocks allows
LEAST_BLOCKS = 3
SCORED = "user_id BIGINT, article_id BIGINT, score DOUBLE"


def train_factors(
    ratings: DataFrame,
    rank: int = 25,
    iterations: int = 10,
    regularization: float = 0.01,
    alpha: float = 1.0,
    seed: int = 1,
    blocks: int | None = None,
) -> ALSModel:
    """Alternating least squares on (user_id, article_id, rating).

    ``blocks`` is the number of user and of item blocks, by default one per core and at least
    ten, but fewer where users and items are many: see `_blocks`.
    """
    shared_dir(ratings.sparkSession)  # lets the iterations checkpoint
    data = ratings.select(
        int32(F.col("user_id")).alias("user"),
        int32(F.col("article_id")).alias("item"),
        F.col("rating").cast("float").alias("rating"),
    )
    blocks = blocks or _blocks(data)
    return ALS(
        implicitPrefs=True,
        rank=rank,
        maxIter=iterations,
        regParam=regularization,
        alpha=alpha,
        seed=seed,
        coldStartStrategy="drop",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
    ).fit(data)


def _blocks(data: DataFrame) -> int:
    """How many blocks of (user, item) a fit gets.

    Every iteration sends a factor to nearly all blocks of the other side, so what is exchanged is
    the number of factors times that of blocks, while a block needs nearly all factors of the other
    side however many blocks there are. Large tables therefore get fewer blocks, down to a few.
    """
    most = max(10, data.sparkSession.sparkContext.defaultParallelism)
    ids = data.agg(F.approx_count_distinct("user") + F.approx_count_distinct("item")).first()[0]
    return min(most, max(LEAST_BLOCKS, FACTORS_SENT // max(1, ids)))


def user_factors(model: ALSModel) -> DataFrame:
    return model.userFactors.select(
        F.col("id").cast("bigint").alias("user_id"), F.col("features").cast("array<double>")
    )


def item_factors(model: ALSModel) -> DataFrame:
    return model.itemFactors.select(
        F.col("id").cast("bigint").alias("article_id"), F.col("features").cast("array<double>")
    )


def save_factors(model: ALSModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_factors(path: str) -> ALSModel:
    return ALSModel.load(path)


def recommend_factors(model: ALSModel, users: DataFrame, n: int = 10) -> DataFrame:
    """Best items for the given users; users unknown to the model get no row."""
    wanted = user_factors(model).join(users.select("user_id").distinct(), "user_id", "left_semi")
    return factor_topk(wanted, item_factors(model), n)


def _norm(features):
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x * x))


def _best(users: np.ndarray, user_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, n: int) -> pd.DataFrame:
    """The n best items of each user; ``item_ids`` ascend, and ties go to the smaller id."""
    product = np.round(users @ items.T, 9)
    n = min(n, product.shape[1])
    bar = np.partition(product, -n, axis=1)[:, -n]
    row, column = np.nonzero(product >= bar[:, None])
    score = product[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return pd.DataFrame({"user_id": user_ids[row[keep]], "article_id": item_ids[column[keep]], "score": score[keep]})


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a zero vector has the direction 0."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None], norms


@dataclass(frozen=True)
class Cones:
    """Nodes of one level of the tree: a direction each, and the widest and longest of its items."""

    centres: np.ndarray
    cosines: np.ndarray  # of the angle between the centre and the item farthest from it
    norms: np.ndarray

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """What a user of length 1 can score at most in each node: rows are users.

        An item is at least as far from the user as the centre is, less the node's angle.
        """
        near = np.clip(units @ self.centres.T, -1.0, 1.0)
        cosines = np.clip(self.cosines - 1e-9, -1.0, 1.0)
        apart = near * cosines + np.sqrt(1 - near * near) * np.sqrt(1 - cosines * cosines)
        return np.where(near >= cosines, 1.0, apart + 1e-9) * self.norms


@dataclass(frozen=True)
class ConeTree:
    """Two levels: cells around a few directions, and in each the nodes that hold the items."""

    cells: Cones
    nodes: Cones
    cell_of: np.ndarray
    shelf_of: np.ndarray  # neighbouring nodes share a shelf, which users are sent to once

    def open_nodes(self, users: np.ndarray, bars: np.ndarray) -> np.ndarray:
        """Which nodes (columns) can hold a score of at least the bar for each user (rows)."""
        units, norms = _units(users)
        # A score is rounded to 9 digits, so the bar is lowered by more than that.
        lowest = (np.maximum(bars, 0.0) - 1e-8)[:, None]
        cells = self.cells.bounds(units) * norms[:, None] >= lowest
        found = np.zeros((len(users), len(self.cell_of)), bool)
        some = np.flatnonzero(cells.any(axis=0)[self.cell_of])
        if len(some):
            part = Cones(self.nodes.centres[some], self.nodes.cosines[some], self.nodes.norms[some])
            found[:, some] = cells[:, self.cell_of[some]] & (part.bounds(units) * norms[:, None] >= lowest)
        return found


def _placed(items: DataFrame, pivots: dict[int, np.ndarray], key: str | None, into: str) -> DataFrame:
    """Add the nearest pivot's number (among those of the row's ``key``) and the cosine to it."""
    pivots = {k: _units(p)[0] for k, p in pivots.items()}

    def place(batches):
        for batch in batches:
            units, _ = _units(np.stack(batch["v"].to_numpy()))
            nearest, cosine = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            groups = {0: np.arange(len(batch))} if key is None else batch.groupby(key).indices
            for k, at in groups.items():
                near = units[at] @ pivots[k].T
                nearest[at] = near.argmax(axis=1)
                cosine[at] = near[np.arange(len(at)), nearest[at]]
            yield batch.assign(**{into: nearest, f"{into}_cos": cosine})

    return items.mapInPandas(place, f"{_ddl(items)}, {into} int, {into}_cos double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _first_by_hash(items: DataFrame, most: int) -> np.ndarray:
    return np.array([r.v for r in items.orderBy(F.xxhash64("article_id"), "article_id").limit(most).select("v").collect()])


def cone_tree(items: DataFrame, block: int) -> tuple[ConeTree, DataFrame]:
    """The tree of (article_id, v, norm), and the items with the number of their ``node``.

    Cells form around `CELLS` items of smallest hash; a cell that holds more than a block gets as
    many directions of its own, twice over, and a direction with more than a block of items (copies
    of one vector, say) is cut into several nodes. The nodes' summaries are collected: at most
    `NODES` of them and of cells and directions, as the block grows with the items.
    """
    centre = _first_by_hash(items, CELLS)
    placed = stored(_placed(items, {0: centre}, None, "cell"), "cells")
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    block = max(block, 4 * sum(sizes.values()) // NODES)
    wanted = {c: 2 * n // block for c, n in sizes.items()}
    shares = items.sparkSession.createDataFrame([(c, k / sizes[c]) for c, k in wanted.items()], "cell int, share double")
    drawn = F.pmod(F.xxhash64("article_id", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    # One row per cell is broadcast; about as many directions as wanted are drawn.
    chosen = placed.join(F.broadcast(shares), "cell").where(drawn)
    directions = {c: [centre[c]] for c in sizes}
    for r in chosen.select("cell", "v").orderBy("article_id").collect():
        directions[r.cell].append(r.v)
    fine = stored(_placed(placed, {c: np.array(v) for c, v in directions.items()}, "cell", "part"), "parts")
    counts = fine.groupBy("cell", "part").agg(F.ceil(F.count("*") / block).alias("_cuts"))
    cut = fine.join(counts, ["cell", "part"]).withColumn("cut", F.pmod(F.xxhash64("article_id"), F.col("_cuts")).cast("int"))
    key = ["cell", "part", "cut"]
    summary = cut.groupBy(*key).agg(
        F.min("part_cos").alias("cos"), F.min("cell_cos").alias("cell_cos"), F.max("norm").alias("norm"),
        F.count("*").alias("n"),
    )
    nodes = sorted(summary.collect(), key=lambda r: (r.cell, r.part, r.cut))
    cells = sorted({r.cell for r in nodes})
    of_cell = {c: [r for r in nodes if r.cell == c] for c in cells}
    sizes_of = np.array([r.n for r in nodes])
    shelves = max(_ways(items), -(-int(sizes_of.sum()) // SHELF_ROWS))
    shelf_of = (np.cumsum(sizes_of) - sizes_of) * shelves // sizes_of.sum()
    tree = ConeTree(
        Cones(
            _units(np.array([centre[c] for c in cells]))[0],
            np.array([min(r.cell_cos for r in of_cell[c]) for c in cells]),
            np.array([max(r.norm for r in of_cell[c]) for c in cells]),
        ),
        Cones(
            _units(np.array([directions[r.cell][r.part] for r in nodes]))[0],
            np.array([r.cos for r in nodes]),
            np.array([r.norm for r in nodes]),
        ),
        np.array([cells.index(r.cell) for r in nodes]),
        shelf_of,
    )
    numbers = items.sparkSession.createDataFrame(
        [(r.cell, r.part, r.cut, i, int(shelf_of[i])) for i, r in enumerate(nodes)],
        "cell int, part int, cut int, node int, shelf int",
    )
    return tree, cut.join(numbers, key).select("shelf", "node", "article_id", "v")


def _ways(df: DataFrame) -> int:
    """Sides of a grid with about two cells for each core."""
    return isqrt(2 * df.sparkSession.sparkContext.defaultParallelism) + 1


def _batch(n: int) -> int:
    return max(1, min(BATCH_USERS, HELD // n))


def _first_pass(users: DataFrame, head: list, tree: ConeTree | None, n: int) -> DataFrame:
    """Where the users are read: their lists from the head alone (rows without ``shelf``), and for
    each batch of users and shelf the users to whom one of its nodes is open, packed into one row."""
    ids = np.array([h[0] for h in head], np.int64)
    vectors = np.array([h[1] for h in head])

    def score(batches):
        for batch in batches:
            for start in range(0, len(batch), _batch(n)):
                part = batch.iloc[start : start + _batch(n)]
                matrix, own = np.stack(part["u"].to_numpy()), part["user_id"].to_numpy()
                best = _best(matrix, own, vectors, ids, n)
                yield best.assign(shelf=pd.array([None] * len(best), "Int32"), users=0, ids=None, vectors=None, bars=None)
                if tree is not None:
                    bars = best.groupby("user_id", sort=False)["score"].min().reindex(own).to_numpy()
                    yield _packets(matrix, own, bars, tree)

    return users.select("user_id", "u").mapInPandas(
        score, f"{SCORED}, shelf int, users int, ids binary, vectors binary, bars binary"
    )


def _packets(matrix: np.ndarray, ids: np.ndarray, bars: np.ndarray, tree: ConeTree) -> pd.DataFrame:
    rows = []
    is_open = tree.open_nodes(matrix, bars)
    for shelf in np.unique(tree.shelf_of):
        at = np.flatnonzero(is_open[:, tree.shelf_of == shelf].any(axis=1))
        if len(at):
            rows.append((None, None, None, shelf, len(at), ids[at].tobytes(), matrix[at].tobytes(), bars[at].tobytes()))
    return pd.DataFrame(rows, columns=["user_id", "article_id", "score", "shelf", "users", "ids", "vectors", "bars"])


@dataclass(frozen=True)
class Shelf:
    """The items of neighbouring nodes, sorted by node, and a cone around those of each node."""

    article_ids: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    cones: Cones

    @staticmethod
    def of(items: pd.DataFrame) -> Shelf:
        items = items.sort_values(["node", "article_id"])
        node, vectors = items["node"].to_numpy(), np.stack(items["v"].to_numpy())
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        units, norms = _units(vectors)
        centres, _ = _units(np.add.reduceat(units, starts))
        cosines = (units * np.repeat(centres, np.diff(np.r_[starts, len(node)]), axis=0)).sum(axis=1)
        cones = Cones(centres, np.minimum.reduceat(cosines, starts), np.maximum.reduceat(norms, starts))
        return Shelf(items["article_id"].to_numpy(), vectors, np.r_[starts, len(node)], cones)

    def best(self, users: np.ndarray, user_ids: np.ndarray, bars: np.ndarray, n: int) -> pd.DataFrame:
        """The n best items of each user among those that reach its bar.

        Nodes are taken by falling bound; what is held is cut to n a user when it has grown to
        four times as many, which raises the bars.
        """
        units, norms = _units(users)
        bounds = self.cones.bounds(units) * norms[:, None]
        lowest = np.maximum(bars, 0.0) - 1e-8
        held, grown = [np.zeros((0,), np.int64)] * 2 + [np.zeros(0)], 0
        parts = [held]
        for node in np.argsort(-bounds.max(axis=0), kind="stable"):
            at = np.flatnonzero(bounds[:, node] >= lowest)
            if not len(at):
                continue
            first = self.starts[node]
            product = users[at] @ self.vectors[first : self.starts[node + 1]].T
            row, column = np.nonzero(product >= lowest[at][:, None])
            parts.append([at[row], first + column, np.round(product[row, column], 9)])
            grown += len(row)
            if grown > 4 * n * len(users):
                parts = [self._cut(parts, lowest, n)]
                grown = len(parts[0][0])
        row, column, score = self._cut(parts, lowest, n)
        return pd.DataFrame({"user_id": user_ids[row], "article_id": self.article_ids[column], "score": score})

    def _cut(self, parts: list, lowest: np.ndarray, n: int) -> list[np.ndarray]:
        row, column, score = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((self.article_ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == n - 1
        lowest[row[last]] = np.maximum(lowest[row[last]], score[last] - 1e-8)
        return [row[place < n], column[place < n], score[place < n]]


def _best_of_shelf(n: int):
    def score(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if users.empty or items.empty:
            return pd.DataFrame({"user_id": [], "article_id": [], "score": []})
        shelf = Shelf.of(items)
        found = []
        for ids, packed, bars in zip(users["ids"], users["vectors"], users["bars"]):
            ids = np.frombuffer(ids, np.int64)
            found.append(shelf.best(np.frombuffer(packed).reshape(len(ids), -1), ids, np.frombuffer(bars), n))
        return pd.concat(found)

    return score


def _prepared(users: DataFrame, items: DataFrame, n: int, block: int):
    """Users, the head of the items, and the tree of those below the head (or None) with them."""
    # Fresh names keep the two sides apart when both derive from one table.
    u = users.select(F.col("user_id").alias("user_id"), F.col("features").alias("u"))
    i = items.select(
        F.col("article_id").alias("article_id"), F.col("features").alias("v"), _norm(F.col("features")).alias("norm")
    )
    most = max(block, n)
    head = i.orderBy(F.desc("norm"), "article_id").limit(most + 1).select("article_id", "v", "norm").collect()
    below = len(head) > most
    first = sorted((h.article_id, h.v) for h in head[:most])
    if not below:
        return u, first, None, None
    last = head[most - 1]
    rest = (F.col("norm") < last.norm) | ((F.col("norm") == last.norm) & (F.col("article_id") > last.article_id))
    return u, first, *cone_tree(i.where(rest), block)


def factor_topk(users: DataFrame, items: DataFrame, n: int, block: int = BLOCK_ROWS) -> DataFrame:
    """The ``n`` items with the largest non-negative dot product for every user, exactly.

    The ``block`` items with the largest norms (at least n) are scored for every user where the
    users are read, and give each a first list; its last score is a bar. The items below are held
    in a tree of cones (`cone_tree`), of which every node has an upper bound for a user's scores
    from the angle between them; users descend it in batches. Nodes stand on shelves: a user is
    sent once to each shelf with a node that can clear the user's bar, and there multiplied with
    such nodes only. Shelves and users meet on a grid, so both are sent as often as the grid is
    wide, not once per node. A shelf emits at most n rows per user, never all pairs.

    The users' pass is stored, as lists and open shelves are read from it; that and building the
    tree are the jobs that run while planning.
    """
    u, head, tree, rest = _prepared(users, items, n, block)
    if not head:
        return users.sparkSession.createDataFrame([], SCORED + ", rank INT")
    passed = stored(_first_pass(u, head, tree, n), "first-pass")
    every = passed.where("shelf IS NULL").select("user_id", "article_id", "score")
    if tree is not None:
        every = every.unionByName(_of_shelves(passed.where("shelf IS NOT NULL"), rest, n))
    ranked = top_k(
        every.select("user_id", "article_id", stable(F.col("score")).alias("score")),
        ["user_id"],
        [F.desc("score"), F.col("article_id")],
        n,
    )
    return ranked.where("score >= 0")


def _of_shelves(packets: DataFrame, items: DataFrame, n: int) -> DataFrame:
    # A group's lists, too, are held by its task.
    rows = max(1, min(SHELF_ROWS, 4 * HELD // n))
    wanted = F.least(F.lit(_ways(packets)), F.count("*"))
    groups = packets.groupBy("shelf").agg(F.greatest(F.ceil(F.sum("users") / rows), wanted).cast("int").alias("_groups"))
    left = (
        packets.join(F.broadcast(groups), "shelf")
        .withColumn("group", F.pmod(F.xxhash64("ids"), F.col("_groups")).cast("int"))
        .select(F.col("shelf").alias("s"), F.col("group").alias("g"), "ids", "vectors", "bars")
    )
    right = items.join(F.broadcast(groups), "shelf").select(
        "shelf", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("group"), "node", "article_id", "v"
    )
    return (
        fan_out(left, "s", "g").groupBy("s", "g")
        .cogroup(fan_out(right, "shelf", "group").groupBy("shelf", "group"))
        .applyInPandas(_best_of_shelf(n), SCORED)
    )


def open_share(users: DataFrame, items: DataFrame, n: int, block: int = BLOCK_ROWS) -> float:
    """The share of all pairs of users and items below the head that `factor_topk` multiplies."""
    u, head, tree, rest = _prepared(users, items, n, block)
    if tree is None:
        return 0.0
    ids, vectors = np.array([h[0] for h in head], np.int64), np.array([h[1] for h in head])

    def visit(batches):
        for batch in batches:
            matrix = np.stack(batch["u"].to_numpy())
            best = _best(matrix, np.arange(len(batch)), vectors, ids, n).groupby("user_id")["score"].min()
            open_to = tree.open_nodes(matrix, best.to_numpy()).sum(axis=0)
            yield pd.DataFrame({"node": np.arange(len(open_to)), "users": open_to})

    visits = u.select("u").mapInPandas(visit, "node int, users bigint").groupBy("node").agg(F.sum("users").alias("users"))
    sizes = rest.groupBy("node").agg(F.count("*").alias("items"))
    multiplied = visits.join(sizes, "node").agg(F.sum(F.col("users") * F.col("items"))).first()[0] or 0
    return multiplied / (u.count() * rest.count())
