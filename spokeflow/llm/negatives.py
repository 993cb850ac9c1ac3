"""Hard negatives from a GNAT-style multiway hyperplane tree: sibling subtrees go when their distance ranges miss the window.

All vectors are lifted onto one sphere (one more component makes up for shorter ones), where the angle to an anchor falls as
the inner product with it grows: a window of scores is an annulus of angles around the anchor. A node of the tree has up to
``FANOUT`` split points; a vector belongs to the split point next to it, so subtrees are parted by hyperplanes. Each split
point keeps the least and greatest angle to the vectors of every sibling subtree. With its angle to a split point known, an
anchor's angle to all vectors of a sibling lies in an interval (the triangle inequality of angles); if that misses the
annulus, the subtree is left out. The annulus shrinks as better rows are found. Leaves are exact: whole-number inner products.

The upper levels are one tree for all rows. Its split points come from a bounded sample, its ranges from all rows, combined
by Spark; its leaves are the cells that rows are dealt to. A cell with many rows, such as copies of one vector, is salted into
shards, and every shard gets the lower levels of its own in the task that holds it. Anchors are rows of a table all along;
they go only to the shards of cells that the upper levels leave, and stream through the task of a shard, whose rows come
first. Three visits: an anchor's own cell gives bounds for its positives, the other cells that can beat them complete these,
and the positives' windows find the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spokeflow.llm.topk import matrix
from spokeflow.session import checkpointed

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
FANOUT = 16
LEAF_ROWS = 64
# Rows of a shard, at most about; and of the sample and the cells of the upper levels, which are held by every task.
SHARD_ROWS = 4_096
SAMPLE, CELLS = 4_096, 1_024
# Angles are taken to be this uncertain; rounding is far less.
SLACK = 1e-6
NONE = -(1 << 62)
NO_ID = (1 << 63) - 1


def scaled(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; NULL for vectors that are NULL or hold NULL, NaN or infinity."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


@dataclass
class Sphere:
    """The sphere that vectors of ``width`` components are lifted to; ``radius`` is the greatest length of all."""

    width: int
    radius: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors, one component longer."""
        scaled = vectors / (self.radius or 1.0)
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        return np.column_stack((scaled, rest))

    def seen(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors as unit vectors without the added component, and their lengths."""
        lengths = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
        units = anchors / np.where(lengths > 0, lengths, 1.0)[:, None]
        return np.column_stack((units, np.zeros(len(anchors)))), lengths

    def angle(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The angle at which an anchor of this length has this score."""
        reach = np.where(length > 0, length, 1.0) * (self.radius or 1.0)
        return np.arccos(np.clip(score / reach, -1.0, 1.0))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


@dataclass
class Node:
    """Split points, the range of angles from each to the vectors below each, and what is below: nodes, or numbers of leaves.

    Leaves are numbered in order, so those below one child follow each other; ``ends`` has the first number after each child's.
    """

    splits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    below: list = field(default_factory=list)
    ends: list = field(default_factory=list)

    def widen(self, apart: np.ndarray, child: int) -> None:
        """Take in vectors of one subtree by their angles to the split points."""
        np.minimum(self.least[:, child], apart.min(axis=0), out=self.least[:, child])
        np.maximum(self.most[:, child], apart.max(axis=0), out=self.most[:, child])

    def reaches(self, apart: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """For anchors by their angles to the split points: which subtrees may hold a vector between two angles."""
        near = np.maximum(self.least[None] - apart[:, :, None], apart[:, :, None] - self.most[None]).max(axis=1)
        far = (apart[:, :, None] + self.most[None]).min(axis=1)
        return (near <= outer[:, None] + SLACK) & (far >= inner[:, None] - SLACK)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different points that are far from each other, from an even choice of them."""
    some = points[np.unique(np.linspace(0, len(points) - 1, min(len(points), 8 * n)).astype(int))]
    chosen, nearest = [0], some @ some[0]
    while len(chosen) < n:
        far = int(np.argmin(nearest))
        if nearest[far] >= 1.0 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, some @ some[far])
    return some[chosen]


class Tree:
    """A tree over points; ``leaves`` has the numbers of the points in each leaf."""

    def __init__(self, points: np.ndarray, leaf_rows: int, fanout: int = FANOUT):
        self.points, self.leaf_rows, self.fanout = points, max(1, leaf_rows), fanout
        self.nodes: list[Node] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray) -> Node | int:
        if len(rows) > self.leaf_rows:
            splits = spread(self.points[rows], min(self.fanout, -(-len(rows) // self.leaf_rows)))
            if len(splits) > 1:
                apart = angles(self.points[rows], splits)
                nearest = apart.argmin(axis=1)
                node = Node(splits, np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf))
                self.nodes.append(node)
                for child in range(len(splits)):
                    mine = nearest == child
                    if mine.any():
                        node.widen(apart[mine], child)
                    # A subtree of all rows is a leaf: its points do not part any further.
                    node.below.append(self._grow(rows[mine]) if mine.sum() < len(rows) else self._leaf(rows))
                    node.ends.append(len(self.leaves))
                return node
        return self._leaf(rows)

    def _leaf(self, rows: np.ndarray) -> int:
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def forget(self) -> None:
        """Keep the split points only: no ranges, no points."""
        for node in self.nodes:
            node.least[:], node.most[:] = np.inf, -np.inf
        self.points, self.leaves = self.points[:0], [leaf[:0] for leaf in self.leaves]

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        found = np.zeros(len(points), np.int64)

        def down(at: Node | int, rows: np.ndarray) -> None:
            if not isinstance(at, Node):
                found[rows] = at
            elif len(rows):
                nearest = angles(points[rows], at.splits).argmin(axis=1)
                for child, below in enumerate(at.below):
                    down(below, rows[nearest == child])

        down(self.root, np.arange(len(points)))
        return found

    def widen(self, points: np.ndarray, leaves: np.ndarray) -> None:
        """Take points of known leaves into the ranges."""

        def down(at: Node | int, rows: np.ndarray) -> None:
            if not isinstance(at, Node) or not len(rows):
                return
            apart = angles(points[rows], at.splits)
            child_of = np.searchsorted(at.ends, leaves[rows], "right")
            for child, below in enumerate(at.below):
                mine = child_of == child
                if mine.any():
                    at.widen(apart[mine], child)
                    down(below, rows[mine])

        down(self.root, np.arange(len(points)))

    def reached(self, units: np.ndarray, window: np.ndarray, inner, outer, visit) -> None:
        """Call ``visit`` with every leaf and the windows that may have a vector there.

        Window w is that of anchor ``window[w]``; ``inner`` and ``outer`` give the angles of some windows as they are by then.
        """

        def down(at: Node | int, alive: np.ndarray) -> None:
            if not len(alive):
                return
            if not isinstance(at, Node):
                visit(at, alive)
                return
            own, back = np.unique(window[alive], return_inverse=True)
            apart = angles(units[own], at.splits)[back]
            for child in np.argsort(apart.mean(axis=0), kind="stable"):
                # Asked anew for each child: what the ones before it had may have drawn the windows closer.
                down(at.below[child], alive[at.reaches(apart, inner(alive), outer(alive))[:, child]])

        down(self.root, np.arange(len(window)))


class Search:
    """Windows of scores over the rows of one shard; ``scored`` counts the rows that windows were compared with."""

    def __init__(self, sphere: Sphere, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        by_id = np.argsort(ids, kind="stable")
        self.sphere, self.ids, self.labels = sphere, ids[by_id], labels[by_id]
        self.vectors = exact(vectors[by_id])
        self.tree = Tree(sphere.lifted(vectors[by_id]), leaf_rows)
        self.scored = 0

    def best(
        self, anchors: np.ndarray, own: np.ndarray, label: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray,
        same: bool, k: int,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``k`` best rows of each window (``low`` to ``high``, of anchor ``window``), NONE where there
        are fewer. Rows of the anchor's label but itself if ``same``, else those of other labels."""
        units, lengths = self.sphere.seen(anchors)
        length = lengths[window]
        scores, found = np.full((len(window), k), NONE), np.full((len(window), k), NO_ID)
        # An anchor of length 0 has the score 0 with every row and no direction to go by.
        nowhere = length == 0
        inner_all = np.where(nowhere, 0.0, self.sphere.angle(high, length))
        values = exact(anchors)

        def outer(some: np.ndarray) -> np.ndarray:
            least = np.maximum(low[some], scores[some, -1])
            return np.where(nowhere[some], np.pi, self.sphere.angle(least, length[some]))

        def visit(leaf: int, some: np.ndarray) -> None:
            rows = self.tree.leaves[leaf]
            own_anchors, back = np.unique(window[some], return_inverse=True)
            products = (values[own_anchors] @ self.vectors[rows].T)[back].astype(np.int64)
            self.scored += products.size
            fits = (self.labels[rows] == label[window[some], None]) == same
            fits &= self.ids[rows] != own[window[some], None]
            fits &= (products >= np.maximum(low[some], scores[some, -1])[:, None]) & (products <= high[some, None])
            hit = fits.any(axis=1)
            if not hit.any():
                return
            some, fits = some[hit], fits[hit]
            all_scores = np.concatenate((scores[some], np.where(fits, products[hit], NONE)), axis=1)
            all_ids = np.concatenate((found[some], np.where(fits, self.ids[rows], NO_ID)), axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[some] = np.take_along_axis(all_scores, order, axis=1)
            found[some] = np.take_along_axis(all_ids, order, axis=1)

        self.tree.reached(units, window, lambda some: inner_all[some], outer, visit)
        return scores, found


def exact(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers in the type whose products are fast and still exact: double if no sum can pass 2 ** 53."""
    most = float(np.abs(vectors).max(initial=0))
    return vectors.astype(float) if most * most * max(1, vectors.shape[1]) < 2**53 else vectors.astype(np.int64)


FOUND = "anchor_id bigint, of bigint, vec_id bigint, score bigint"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return matrix(pa.chunked_array([_column(batch, "vector")]), width)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row of each window, what it is of, and its bounds."""
    lists = _column(batch, "windows")
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return rows, *[f.to_numpy(zero_copy_only=False).astype(np.int64) for f in lists.flatten().flatten()]


def placed(vectors: DataFrame, tree: Tree, sphere: Sphere) -> DataFrame:
    """``vectors`` with the ``cell`` of each row."""
    schema = vectors.select("*", F.lit(0).alias("cell")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = tree.place(sphere.lifted(_vectors(batch, sphere.width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(place, schema)


def measured(rows: DataFrame, tree: Tree, sphere: Sphere) -> Tree:
    """The tree with ranges over all ``rows`` (``vector``, ``cell``): each task's, then their extremes. One row per pair of
    siblings is collected."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree.widen(sphere.lifted(_vectors(batch, sphere.width)), _column(batch, "cell").to_numpy())
        found = [
            (number, i, j, float(node.least[i, j]), float(node.most[i, j]))
            for number, node in enumerate(tree.nodes)
            for i, j in zip(*np.nonzero(node.least <= node.most), strict=True)
        ]
        names = ("node", "split", "child", "least", "most")
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in found], pa.int64() if i < 3 else pa.float64()) for i, n in enumerate(names)})

    found = rows.select("vector", "cell").mapInArrow(measure, "node bigint, split bigint, child bigint, least double, most double")
    found = found.groupBy("node", "split", "child").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    for r in found.collect():
        node = tree.nodes[r.node]
        node.least[r.split, r.child], node.most[r.split, r.child] = r.least, r.most
    return tree


def dealt(queries: DataFrame, tree: Tree, sphere: Sphere, but_home: bool = False) -> DataFrame:
    """``queries`` (``vec_id``, ``label``, ``vector``, ``home``, ``windows``) once for each ``cell`` that their windows reach, but
    for their own cell ``home`` if ``but_home``."""
    schema = queries.select("*", F.lit(0).alias("cell")).schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = _column(batch, "home").to_numpy()
            rows, _, low, high = _windows(batch)
            units, lengths = sphere.seen(_vectors(batch, sphere.width))
            nowhere = lengths[rows] == 0
            inner = np.where(nowhere, 0.0, sphere.angle(high, lengths[rows]))
            outer = np.where(nowhere, np.pi, sphere.angle(low, lengths[rows]))
            reached: list[tuple[int, np.ndarray]] = []
            visit = lambda cell, some: reached.append((cell, np.unique(rows[some])))
            tree.reached(units, rows, lambda some: inner[some], lambda some: outer[some], visit)
            for cell, some in reached:
                sent = batch.take(pa.array(some[home[some] != cell] if but_home else some))
                cells = pa.array(np.full(sent.num_rows, cell), pa.int32())
                yield pa.RecordBatch.from_arrays([*sent.columns, cells], [*batch.schema.names, "cell"])

    return queries.mapInArrow(deal, schema)


def searched(rows: DataFrame, queries: DataFrame, salts: DataFrame, sphere: Sphere, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each shard in each window: ``anchor_id``, ``of`` (the window's), ``vec_id`` and ``score``.

    ``rows`` have their ``cell`` and ``salt``, ``queries`` their ``cell``; ``salts`` tells the shards of each cell.
    """
    asked = queries.join(F.broadcast(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    empty = F.lit(None).cast("array<struct<of:bigint,low:bigint,high:bigint>>")
    columns = ["cell", "salt", "is_query", "vec_id", "label", "vector", "windows"]
    both = rows.withColumns({"is_query": F.lit(False), "windows": empty}).select(columns).union(
        asked.withColumn("is_query", F.lit(True)).select(columns)
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            keys = np.column_stack([_column(batch, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("cell", "salt", "is_query")])
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if hi == lo:
                    continue
                part, key = batch.slice(lo, hi - lo), tuple(keys[lo, :2])
                if key != shard:
                    shard, held, tree = key, [], None
                ids, labels = (_column(part, n).to_numpy() for n in ("vec_id", "label"))
                vectors = _vectors(part, sphere.width)
                if not keys[lo, 2]:
                    held.append((ids, labels, vectors))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = Search(sphere, *[np.concatenate(c) for c in zip(*held, strict=True)])
                window, of, low, high = _windows(part)
                scores, found = tree.best(vectors, ids, labels, window, low, high, same, k)
                at, column = np.nonzero(found != NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()) for a in (ids[window[at]], of[at], found[at, column], scores[at, column])],
                    ["anchor_id", "of", "vec_id", "score"],
                )

    in_order = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "is_query")
    return in_order.mapInArrow(search, FOUND)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percents: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT),
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    sample: int = SAMPLE,
    cells: int = CELLS,
) -> DataFrame:
    """For the rows of ``embeddings`` (``vec_id``, ``embedding``, ``label``) that ``is_anchor`` picks, and each of their best
    ``positives`` other rows of the same label, the best ``negatives`` rows of other labels whose score is within
    ``percents`` of the positive's: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id`` and both scores.

    A score is the inner product of the vectors times ``scale``, rounded down; ties go to the smaller ``vec_id``. Rows without
    ``vec_id`` or label, and vectors that are NULL or hold NULL or non-finite components, take no part. Shorter vectors count as
    zero beyond their end. Rows that repeat a ``vec_id`` count once, with the smallest label and vector. A positive with a
    score below 0 has an empty window. ``sample`` and ``cells`` bound what every task holds of the upper levels.
    """
    usable = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), scaled("embedding", scale).alias("vector")
    ).where("vec_id is not null and label is not null and vector is not null")
    own = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_row")).select("vec_id", "_row.*")
    vectors = checkpointed(own)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, width, most = vectors.agg(F.count("*"), F.max(F.size("vector")), F.max(squares)).first()
    sphere = Sphere(width or 0, float(np.sqrt(most or 0.0)))
    some = vectors.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    points = np.zeros((len(some), sphere.width), np.int64)
    for i, r in enumerate(some):
        points[i, : len(r.vector)] = r.vector
    wanted = min(cells, -(-n // shard_rows) or 1)
    tree = Tree(sphere.lifted(points), -(-len(some) // wanted) or 1)
    tree.forget()
    rows = checkpointed(placed(vectors, tree, sphere))
    # At most as many rows as the upper levels have cells.
    salts = checkpointed(rows.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts")))
    tree = measured(rows, tree, sphere)
    anchors = rows.where(is_anchor).withColumnRenamed("cell", "home")
    rows = rows.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("salts")).cast("int"))

    def window(of: Column, low: Column, high: Column) -> Column:
        return F.struct(of.alias("of"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    nothing = F.lit(None).cast("bigint")
    all_scores = F.array(window(F.lit(0), F.lit(NONE), F.lit(-NONE)))
    first = anchors.withColumns({"windows": all_scores, "cell": F.col("home")})
    at_home = checkpointed(searched(rows, first, salts, sphere, True, positives))
    # The last of as many positives as are wanted bounds what other cells can add.
    bounds = _top(at_home, ["anchor_id"], positives).groupBy("anchor_id").agg(
        F.when(F.count("*") == positives, F.min("score")).otherwise(nothing).alias("_bound")
    )
    bounded = anchors.join(bounds, F.col("vec_id") == F.col("anchor_id"), "left").withColumn(
        "windows", F.array(window(F.lit(0), F.coalesce("_bound", F.lit(NONE)), F.lit(-NONE)))
    )
    elsewhere = dealt(bounded.drop("anchor_id", "_bound"), tree, sphere, True)
    others = searched(rows, elsewhere, salts, sphere, True, positives)
    chosen = checkpointed(
        _top(at_home.union(others), ["anchor_id"], positives).select(
            "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
    )
    least, most_ = (F.lit(p) * F.col("positive_score") for p in percents)
    low, high = -F.floor(-least / 100), F.floor(most_ / 100)
    windows = chosen.where(low <= high).groupBy("anchor_id").agg(
        F.collect_list(window(F.col("positive_id"), low, high)).alias("windows")
    )
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    found = searched(rows, dealt(asked, tree, sphere), salts, sphere, False, negatives)
    best = _top(found.withColumnRenamed("of", "positive_id"), ["anchor_id", "positive_id"], negatives)
    return best.join(chosen, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
