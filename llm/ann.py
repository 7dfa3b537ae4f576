"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on ``DIMS`` random Gaussian directions.  Squared projected
distance over squared true distance then follows a chi-square law with ``DIMS`` degrees
of freedom.  A kd-tree over the projections gives neighbours in order of projected
distance; each is verified on the original vector, and a search stops once the next
projected distance is so large against the k-th best true distance that a nearer vector
would lie there with a chance below 1 - ``SURE``.

The projected space is cut into cells by the top of the tree, which is fitted on a
bounded sample; every vector is indexed in its cell.  A cell that holds more than
``CELL_ROWS`` vectors is dealt into parts by a hash, so no task holds more, however many
there are.  A query first searches its own cell, which bounds its k-th distance, and then
the cells that this bound leaves open.

More directions make the test sharper and the boxes of the tree blunter.  On unit vectors
that lie nearly evenly in 64 dimensions, where the tenth neighbour is at 0.77 of the mean
distance, 24 directions at 0.95 verify about half of all vectors with a recall of 0.97, 8 at
0.999 nearly all; on clustered vectors few cells stay open.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, bound_batches, table

DIMS = 24
SURE = 0.95
BUCKET = 256
CELL_ROWS = 4096
#: Bound of the rows that the cells' borders are fitted on; all rows are indexed.
FIT_ROWS = 20_000
#: Rows of the sample that a cell's border goes by, at least.
FIT_CELL = 8
STEPS = 1 << 40
#: Comes after every id: at an equal distance a real vector goes before it.
NO_ID = (1 << 63) - 1


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(chi-square with k degrees <= x) = p, k even, by bisection."""
    def below(x):
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(width: int) -> np.ndarray:
    return np.random.RandomState(97).standard_normal((width, DIMS))


class Tree:
    """A kd-tree with buckets over projected points."""

    def __init__(self, points: np.ndarray, bucket: int = BUCKET):
        self.points = points
        self.nodes: list = []
        self.low, self.high = [], []
        self._build(np.arange(len(points)), bucket)

    def _build(self, rows: np.ndarray, bucket: int) -> int:
        at = len(self.nodes)
        p = self.points[rows]
        low, high = p.min(axis=0), p.max(axis=0)
        self.nodes.append(None)
        self.low.append(low)
        self.high.append(high)
        axis = int((high - low).argmax())
        if len(rows) <= bucket or high[axis] == low[axis]:
            self.nodes[at] = rows
            return at
        order = np.argsort(p[:, axis], kind="stable")
        half = len(rows) // 2
        self.nodes[at] = (self._build(rows[order[:half]], bucket), self._build(rows[order[half:]], bucket))
        return at

    def _away(self, at: int, q: np.ndarray) -> float:
        d = np.maximum(0, np.maximum(self.low[at] - q, q - self.high[at]))
        return float(d @ d)

    def nearest(self, q: np.ndarray):
        """(squared projected distances, rows) by rising distance, a bucket at a time.

        What a bucket gives is no nearer than the bucket itself; the number that comes
        with it is a lower bound for everything still to come.
        """
        heap = [(self._away(0, q), 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            node = self.nodes[at]
            if isinstance(node, tuple):
                for child in node:
                    heapq.heappush(heap, (self._away(child, q), child))
            else:
                yield bound, node


class Best:
    """The k nearest so far by (distance, id)."""

    def __init__(self, k: int, found: list[tuple[float, int]] | None = None):
        self.k, self.found = k, sorted(found or [])[:k]

    @property
    def worst(self) -> float:
        return self.found[-1][0] if len(self.found) == self.k else math.inf

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(d <= self.worst)
        if len(near):
            self.found = sorted([*self.found, *zip(d[near].tolist(), ids[near].tolist())])[: self.k]


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, q_low: np.ndarray, q_id: int, best: Best, stop: float) -> None:
    """Verify neighbours by projected distance until the stopping test holds."""
    for bound, rows in tree.nearest(q_low):
        if bound > stop * best.worst**2:
            break
        gap = tree.points[rows] - q_low
        rows = rows[(gap * gap).sum(axis=1) <= stop * best.worst**2]
        rows = rows[ids[rows] != q_id]
        if len(rows):
            d = vectors[rows] - q
            best.add(np.sqrt((d * d).sum(axis=1)), ids[rows])


class Cells:
    """The top of the kd-tree: borders of cells in projected space."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.split: list[tuple[int, float, int, int]] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.root = self._cut(sample, max(1, cells), np.full(DIMS, -np.inf), np.full(DIMS, np.inf))

    def _cut(self, points, cells, low, high) -> int:
        """Number of a split, or of a cell as -1 - cell."""
        axis = int(np.ptp(points, axis=0).argmax()) if len(points) else 0
        if cells <= 1 or len(points) < 2 or np.ptp(points[:, axis]) == 0:
            self.boxes.append((low, high))
            return -len(self.boxes)
        at = float(np.median(points[:, axis]))
        left = points[:, axis] < at
        if not left.any():
            at = float(points[points[:, axis] > at, axis].min())
            left = points[:, axis] < at
        me = len(self.split)
        self.split.append(None)
        upper, lower = high.copy(), low.copy()
        upper[axis], lower[axis] = at, at
        a = self._cut(points[left], cells // 2, low, upper)
        b = self._cut(points[~left], cells - cells // 2, lower, high)
        self.split[me] = (axis, at, a, b)
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def go(at, rows):
            if at < 0:
                out[rows] = -at - 1
            elif len(rows):
                axis, border, a, b = self.split[at]
                left = points[rows, axis] < border
                go(a, rows[left])
                go(b, rows[~left])

        go(self.root, np.arange(len(points)))
        return out

    def away(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance of ``q`` to each cell."""
        low, high = np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])
        d = np.maximum(0, np.maximum(low - q, q - high))
        return (d * d).sum(axis=1)


def _floats(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _cell_tables(batches):
    """All rows of one cell after another, as a table each; rows come sorted by cell."""
    held, cell = [], None
    for batch in batches:
        keys = batch.column("cell").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cut, cut[1:]):
            if a == b:
                continue
            if cell is not None and keys[a] != cell:
                yield pa.Table.from_batches(held)
                held = []
            cell = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _searched(k: int, stop: float):
    """Within each cell: queries against points; rows (query_id, vec_id, score)."""

    def run(batches):
        for t in _cell_tables(batches):
            is_query = np.array(t.column("query").to_pylist(), bool)
            if not is_query.any() or is_query.all():
                continue
            ids, vectors = t.column("vec_id").to_numpy(), _floats(t.column("v"))
            bounds = t.column("bound").to_pylist()
            low = vectors @ directions(vectors.shape[1])
            mine, rows = np.flatnonzero(~is_query), np.flatnonzero(is_query)
            points, point_ids = vectors[mine], ids[mine]
            tree = Tree(low[mine])
            out = []
            for r in rows.tolist():
                best = Best(k, [(bounds[r], NO_ID)] * k if bounds[r] is not None else None)
                search(tree, points, point_ids, vectors[r], low[r], ids[r], best, stop)
                out += [(int(ids[r]), i, d) for d, i in best.found if i != NO_ID]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, is_query, k: int = 10, sure: float = SURE, cell_rows: int = CELL_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: ``k`` nearest by Euclidean distance of each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on its columns.

    * vectors that are null, empty, zero, of another length than most or hold a null or
      non-finite component take no part, neither have null ids;
    * equal distances go to the smaller id; of equal vectors only the ``k`` + 1 smallest
      ids can be among the nearest, so no more are searched;
    * repeated rows of one id and vector count once; a query is not its own neighbour;
    * fewer candidates than ``k`` give all of them; an empty table gives no row.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "ann")
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    widths = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        scratch.drop()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows = widths
    good = scratch.keep(good.where(F.size("v") == width))
    same = Window.partitionBy("v").orderBy("vec_id")
    points = good.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    near = int(STEPS * min(1.0, 0.95 * fit_rows / rows))
    sample = points.select("v").where(F.pmod(F.xxhash64("v"), F.lit(STEPS)) < near).limit(fit_rows).toArrow()
    cells = Cells(_floats(sample.column("v")) @ directions(width), max(1, min(fit_rows // FIT_CELL, rows // cell_rows)))
    shared = spark.sparkContext.broadcast(cells)  # fit_rows / FIT_CELL boxes at most
    stop = chi_square_quantile(sure, DIMS)

    def place(batches):
        for batch in batches:
            own = shared.value.of(_floats(batch.column("v")) @ directions(width))
            yield batch.append_column("cell", pa.array(own, pa.int64()))

    def spread(batches):
        """Other cells of a query that its bound leaves open."""
        for batch in batches:
            low = _floats(batch.column("v")) @ directions(width)
            at, to = [], []
            bounds, own = batch.column("bound").to_pylist(), batch.column("cell").to_pylist()
            for i in range(batch.num_rows):
                far = shared.value.away(low[i])
                open_ = np.flatnonzero(far <= (math.inf if bounds[i] is None else stop * bounds[i] ** 2))
                open_ = open_[open_ != own[i]]
                at += [i] * len(open_)
                to += open_.tolist()
            out = batch.take(pa.array(at, pa.int64()))
            yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(to, pa.int64()))

    form = "vec_id long, v array<double>, cell long"
    placed = scratch.keep(points.mapInArrow(place, form).withColumn("query", F.lit(False)).withColumn("bound", F.lit(None).cast("double")))
    asked = scratch.keep(good.where("query").select("vec_id", "v").distinct().mapInArrow(place, form).withColumn("query", F.lit(True)).withColumn("bound", F.lit(None).cast("double")))
    # A row for each cell: bounded by the cells.
    parts = F.broadcast(scratch.keep(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"))))

    def searched(queries: DataFrame) -> DataFrame:
        """The nearest within each part of the cells that ``queries`` are in."""
        one = F.array(F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
        both = placed.unionByName(queries).join(parts, "cell").withColumn("part", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(one)))
        both = both.withColumn("cell", F.col("cell") * (1 << 32) + F.col("part")).drop("part", "parts")
        both = both.repartition("cell").sortWithinPartitions("cell", "query", "vec_id")
        return scratch.keep(both.mapInArrow(_searched(k, stop), "query_id long, vec_id long, score double"))

    first = searched(asked)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows for each part of one cell
    bound = first.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    again = asked.drop("bound").join(bound, asked["vec_id"] == bound["query_id"], "left").select("vec_id", "v", "cell", "query", "bound")
    rest = scratch.keep(again.mapInArrow(spread, again.schema))
    found = first.unionByName(searched(rest)).distinct()
    best = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    out = scratch.keep(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    scratch.drop(but=1)
    return out


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth id among all embeddings."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
