"""Vectors with cosine above a threshold, by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import components, in_groups
from plaudit.llm.vectors import doubles, matrix, unit, usable
from plaudit.sources.shared import saved

# Vectors of one block, which a task holds two of; centres of all upper cells together, which
# travel with the tasks; vectors of a leaf.
BLOCK = 2048
CENTRES = 4096
LEAF = 48
# Pairs of vectors that are compared in the time of one step of the traversal.
PAIRS_PER_STEP = 800
# Slack of bounds on distances, far above their rounding errors.
SLACK = 1e-6


class Tree:
    """A cover tree of unit vectors: the children of a node of radius r cover it by r / 2.

    A node's own centre is its first child's, so levels are nested. Each node has its true
    covering radius, the largest distance from its centre to a vector below.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        first = np.arange(len(rows))
        self._add(0, first, self._distance(0, first))
        waiting = [(0, self.radius[0])]
        while waiting:
            node, radius = waiting.pop()
            members = self.members[node]
            if len(members) <= LEAF or self.radius[node] <= SLACK:
                continue
            radius = min(radius, self.radius[node]) / 2
            own, open_ = [], members
            centre = self.centre[node]
            while len(open_):
                distance = self._distance(centre, open_)
                near = distance <= radius
                own.append(self._add(centre, open_[near], distance[near]))
                waiting.append((own[-1], radius))
                open_ = open_[~near]
                centre = int(open_[0]) if len(open_) else -1
            self.children[node] = np.array(own)
        self.centres = rows[self.centre]
        self.radii = np.array(self.radius)

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.rows[members] @ self.rows[centre])))

    def _add(self, centre: int, members: np.ndarray, distance: np.ndarray) -> int:
        self.centre.append(centre)
        self.members.append(members)
        self.radius.append(float(distance.max()) if len(distance) else 0.0)
        self.children.append(np.empty(0, np.int64))
        return len(self.centre) - 1


def leaf_pairs(one: Tree, two: Tree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of all pairs of leaves that can hold vectors at distance ``reach`` or less."""
    waiting = [(0, 0)]
    while waiting:
        a, b = waiting.pop()
        below_a, below_b = one.children[a], two.children[b]
        if not len(below_a) and not len(below_b):
            yield one.members[a], two.members[b]
            continue
        below_a = below_a if len(below_a) else np.array([a])
        below_b = below_b if len(below_b) else np.array([b])
        apart = np.sqrt(np.maximum(0, 2 - 2 * (one.centres[below_a] @ two.centres[below_b].T)))
        near = apart <= reach + one.radii[below_a][:, None] + two.radii[below_b][None, :] + SLACK
        left, right = np.nonzero(near)
        if len(left) * PAIRS_PER_STEP > len(one.members[a]) * len(two.members[b]):
            # Little is pruned here, and less will be below: compare the vectors at once.
            if len(left):
                yield one.members[a], two.members[b]
            continue
        waiting.extend(zip(below_a[left].tolist(), below_b[right].tolist(), strict=True))


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join_all(self, items: list[int]) -> None:
        roots = {self.find(x) for x in items}
        least = min(roots)
        for root in roots:
            self.parent[root] = least


def _parts(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Connected parts of a bipartite graph: their rows and columns."""
    open_rows = mask.any(1)
    while open_rows.any():
        rows = np.zeros(len(mask), bool)
        rows[open_rows.argmax()] = True
        while True:
            columns = mask[rows].any(0)
            more = mask[:, columns].any(1)
            if (more == rows).all():
                break
            rows = more
        yield np.flatnonzero(rows), np.flatnonzero(columns)
        open_rows &= ~rows


def compare(one: np.ndarray, two: np.ndarray | None, weights: tuple[np.ndarray, np.ndarray], least: float):
    """Weighted numbers of links of either side's vectors, and a forest over both sides.

    ``two`` None compares ``one`` with itself; a vector's link with itself does not count.
    """
    units = unit(one), unit(one if two is None else two)
    trees = Tree(units[0]), Tree(units[1]) if two is not None else None
    other = trees[0] if two is None else trees[1]
    counts = np.zeros(len(one), np.int64), np.zeros(0 if two is None else len(two), np.int64)
    base = 0 if two is None else len(one)
    forest = Forest(len(one) + len(counts[1]))
    for a, b in leaf_pairs(trees[0], other, float(np.sqrt(2 - 2 * least))):
        mask = units[0][a] @ units[1][b].T >= least
        if two is None:
            mask &= a[:, None] != b[None, :]
        if not mask.any():
            continue
        counts[0][a] += mask @ weights[1][b]
        if two is not None:
            counts[1][b] += weights[0][a] @ mask
        for rows, columns in _parts(mask):
            forest.join_all([*a[rows].tolist(), *(b[columns] + base).tolist()])
    return counts, forest


def _cells(points: DataFrame) -> DataFrame:
    """``points`` with ``cell``: the nearest of a space's sampled centres.

    Centres are drawn by the hash of the vector, in proportion to the spaces' sizes and no more
    than about ``CENTRES`` in all; spaces of one block need none.
    """
    sizes = points.groupBy("space").agg(F.count("*").alias("n"))
    total = points.count()
    want = F.least(F.lit(256.0), F.floor(F.col("n") * min(2 / BLOCK, CENTRES / max(1, total))))
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < (F.col("want") / F.col("n") * (1 << 30)).cast("long")
    chosen = sizes.withColumn("want", want).where((F.col("n") > BLOCK) & (F.col("want") >= 2))
    rows = points.join(chosen, "space").where(drawn).select("space", "vector").limit(2 * CENTRES).collect()
    centres: dict[str, list] = {}
    for row in sorted(rows):
        centres.setdefault(row["space"], []).append(row["vector"])
    grids = {space: unit(np.array(rows)) for space, rows in centres.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column(0).to_pylist()
            cells = [f"{space}|0" for space in spaces]
            for space in set(spaces) & set(grids):
                at = np.flatnonzero([s == space for s in spaces])
                own = unit(matrix(batch.column(2).take(pa.array(at))))
                for i, c in zip(at, (own @ grids[space].T).argmax(1), strict=True):
                    cells[i] = f"{space}|{c}"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.string())], names=[*batch.schema.names, "cell"])

    return points.select("space", "node", "vector", "weight").mapInArrow(
        nearest, "space string, node string, vector array<double>, weight long, cell string"
    )


def threshold_links(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings(vec_id, embedding, label)``.

    Rows of one label and length are compared. Equal vectors are one point with a weight. Points
    go to the nearest of their label's sampled centres, cells are dealt into blocks by hash, so
    that no label, cell or crowd of near copies has to fit one task, and a block's centre and true
    covering radius are the upper levels of the tree. Pairs of cells, then of blocks, whose
    bounds exclude a link are pruned; a task takes one pair of blocks that is left, builds both
    cover trees and traverses them together. Links are decided on the vectors themselves and
    leave a task as counts per point and a spanning forest, never as pairs.

    In high dimension distances between unlike vectors are much alike, and the bounds exclude
    pairs only in the lower levels of the tree: the work then is quadratic in a label's blocks.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
    label, have no links. Repeated rows are copies like others. A null vec_id is linked, but is
    no component's id while another has one, and never kept. An empty table gives no rows.
    """
    rows = doubles(embeddings.where("label is not null"), "vec_id", "label")
    space = F.concat_ws("|", F.col("label").cast("string"), F.size("vector").cast("string"))
    node = F.md5(F.concat_ws("|", "space", F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ",")).cast("binary"))
    rows = saved(rows.withColumn("space", space).withColumn("node", node).select("vec_id", "space", "node", "vector"))
    classes = saved(
        rows.groupBy("node").agg(
            F.first("space").alias("space"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id")
        )
    )
    points = saved(_cells(classes))
    crowd = points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    number = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("string")
    points = saved(points.join(crowd, "cell").withColumn("block", F.concat_ws("|", "cell", number)).drop("blocks"))
    near = _near_blocks(points, float(np.sqrt(2 - 2 * least)))

    sides = [
        points.join(near.select(F.col(mine).alias("block"), "pair", "one", "two"), "block")
        .where(F.lit(True) if side == 0 else F.col("one") != F.col("two"))
        .select("pair", F.lit(side).alias("side"), (F.col("one") == F.col("two")).alias("same"), "node", "vector", "weight")
        for side, mine in enumerate(("one", "two"))
    ]

    def links(pair: pa.Table) -> Iterator[pa.RecordBatch]:
        side = pair["side"].to_numpy()
        same = pair["same"][0].as_py()
        order = np.argsort(side, kind="stable")
        nodes = [n for n in pair["node"].take(pa.array(order)).to_pylist()]
        vectors = matrix(pair["vector"])[order]
        weights = pair["weight"].to_numpy()[order]
        cut = int((side == 0).sum())
        if same:
            counts, forest = compare(vectors, None, (weights, weights), least)
        elif 0 < cut < len(nodes):
            counts, forest = compare(vectors[:cut], vectors[cut:], (weights[:cut], weights[cut:]), least)
        else:
            return
        counts = np.concatenate(counts)
        roots = [forest.find(i) for i in range(len(nodes))]
        out = [i for i in range(len(nodes)) if counts[i] or roots[i] != i]
        yield pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in out], pa.string()), pa.array([nodes[roots[i]] for i in out], pa.string()), pa.array(counts[out], pa.int64())],
            names=["node", "root", "n"],
        )

    found = saved(in_groups(sides[0].unionByName(sides[1]), "pair", links, "node string, root string, n long"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labelled = (
        classes.select("node", "weight", "first_id")
        .join(counts, "node", "left")
        .join(reached, "node", "left")
        .select("node", "first_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    )
    ids = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = labelled.join(ids, "label").select("node", "n_links", "component_id")
    linked = rows.select("vec_id", "node").join(by_node, "node").select("vec_id", "n_links", "component_id")
    fit = F.col("label").isNotNull() & usable(F.col("embedding").cast("array<double>"))
    alone = embeddings.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _near_blocks(points: DataFrame, reach: float) -> DataFrame:
    """``one, two, pair``: pairs of blocks of a space, each once, that can hold a link."""

    def summary(block: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = unit(matrix(block["vector"]))
        centre = rows.mean(0)
        yield pa.RecordBatch.from_arrays(
            [
                block["space"].combine_chunks().slice(0, 1),
                block["cell"].combine_chunks().slice(0, 1),
                block["block"].combine_chunks().slice(0, 1),
                pa.array([centre.tolist()], pa.list_(pa.float64())),
                pa.array([float(np.sqrt(((rows - centre) ** 2).sum(1).max()))]),
            ],
            names=["space", "cell", "block", "centre", "radius"],
        )

    schema = "space string, cell string, block string, centre array<double>, radius double"
    blocks = saved(in_groups(points.select("space", "cell", "block", "vector"), "block", summary, schema))

    def apart(one: str, two: str):
        squares = F.zip_with(F.col(one), F.col(two), lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda sum_, x: sum_ + x))

    def near(left: DataFrame, right: DataFrame, on: list[str], id_: str) -> DataFrame:
        one = left.select(*on, F.col(id_).alias("one"), F.col("centre").alias("c1"), F.col("radius").alias("r1"))
        two = right.select(*on, F.col(id_).alias("two"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
        return one.join(two, on).where((F.col("one") <= F.col("two")) & (apart("c1", "c2") <= reach + F.col("r1") + F.col("r2") + SLACK))

    # A cell's centre is one of its blocks', its radius reaches around all of them.
    first = blocks.groupBy("cell").agg(F.min("space").alias("space"), F.min_by("centre", "block").alias("centre"))
    cells = (
        blocks.select("cell", F.col("centre").alias("own"), F.col("radius").alias("around"))
        .join(first, "cell")
        .groupBy("cell")
        .agg(F.first("space").alias("space"), F.first("centre").alias("centre"), F.max(apart("own", "centre") + F.col("around")).alias("radius"))
    )
    cell_pairs = near(cells, cells, ["space"], "cell").select(F.col("one").alias("cell_1"), F.col("two").alias("cell_2"))
    one = blocks.select(F.col("cell").alias("cell_1"), F.col("block").alias("one"), F.col("centre").alias("c1"), F.col("radius").alias("r1"))
    two = blocks.select(F.col("cell").alias("cell_2"), F.col("block").alias("two"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
    pairs = (
        cell_pairs.join(one, "cell_1")
        .join(two, "cell_2")
        .where((F.col("cell_1") != F.col("cell_2")) | (F.col("one") <= F.col("two")))
        .where(apart("c1", "c2") <= reach + F.col("r1") + F.col("r2") + SLACK)
    )
    return saved(pairs.select("one", "two", F.concat_ws("~", "one", "two").alias("pair")))
