"""Nearest neighbours with vantage-point trees: cells of space, shards of cells, one tree per shard.

The top of one vantage-point tree, fitted on a bounded sample (``FIT_ROWS``), cuts space into at most
``CELLS`` cells; every valid row is in exactly one cell and, by hashed vec_id, in one shard of it
(``SHARD_ROWS`` on average). Each shard's tree is built once and stored as one row. A query first meets
one shard of its own cell, which bounds its k-th distance, and then all shards of those cells that
``factor`` times the triangle-inequality bound does not rule out; the same test skips subtrees. Factor
one is exact, larger factors skip more. Trees travel once: a task holds one tree while blocks of queries
stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_ROWS = 16_384
QUERY_ROWS = 1024
LEAF_ROWS = 256
#: Bounds of what the driver sees: cells, and rows and vector components of the sample that they are fitted on.
CELLS = 256
FIT_ROWS = 16_384
FIT_VALUES = 1 << 22
#: Relative rounding error that bounds allow for.
ROUNDING = 1e-12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows in double precision, summed in order of the dimensions.

    Where squares would leave the range of doubles, the differences are scaled by a power of two first.
    """
    total = np.zeros((len(a), len(b)))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            step = a[:, j, None] - b[None, :, j]
            step *= step
            total += step
        out = np.sqrt(total)
        odd = ~(total < np.inf)
        if any(len(x) and np.abs(x[x != 0]).min(initial=1) < 1e-120 for x in (a, b)):
            odd |= total < 1e-240
        at = np.argwhere(odd)
        for lo in range(0, len(at), 4096):
            i, j = at[lo : lo + 4096].T
            step = a[i] - b[j]
            wide = ~np.isfinite(step).all(axis=1)
            step[wide] = a[i[wide]] / 4 - b[j[wide]] / 4
            power = np.frexp(np.abs(step).max(axis=1, initial=0))[1]
            step = np.ldexp(step, -power[:, None])
            squares = np.zeros(len(step))
            for d in range(step.shape[1]):
                squares += step[:, d] * step[:, d]
            out[i, j] = np.ldexp(np.sqrt(squares), power + 2 * wide)
    return out


def _vantage(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point, of a few, whose distances to all others spread most; and these distances."""
    probe = points[:: max(1, len(points) // 16)][:16]
    across = distances(probe, points)
    with np.errstate(over="ignore", invalid="ignore"):
        best = int(np.argmax(np.nan_to_num(np.std(across, axis=1), nan=0.0)))
    return probe[best], across[best]


def _below(d: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Lower bound of the distance to points that lie between ``lo`` and ``hi`` from a vantage point at distance ``d``."""
    with np.errstate(invalid="ignore"):
        return np.fmax(0, np.fmax(lo - d, d - hi) - ROUNDING * (d + (hi if hi < np.inf else lo)))


class Tree:
    """Points in leaf order, and nodes: vantage point, bounds of its distances to both halves, children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, vantage: np.ndarray, bounds: np.ndarray, links: np.ndarray) -> None:
        self.ids, self.points, self.vantage, self.bounds, self.links = ids, points, vantage, bounds, links

    @staticmethod
    def build(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        order = np.arange(len(ids))
        vantage, bounds, links = [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(links)
            if parent >= 0:
                links[parent][side] = me
            vantage.append(np.zeros(points.shape[1]))
            bounds.append([0.0] * 4)
            links.append([-1, -1, lo, hi])
            if hi - lo <= leaf_rows:
                continue
            vantage[me], d = _vantage(points[order[lo:hi]])
            rank = np.argsort(d, kind="stable")
            order[lo:hi] = order[lo:hi][rank]
            d, half = d[rank], (hi - lo) // 2
            bounds[me] = [d[0], d[half - 1], d[half], d[-1]]
            todo += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
        return Tree(ids[order], points[order], np.asarray(vantage), np.asarray(bounds), np.asarray(links, dtype=np.int64))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each query's k nearest by distance and id: vec_ids, distances, which places are filled; and how many distances that took.

        ``limit``: the k-th distance that each query already has; farther points are not wanted.
        """
        near = np.full((len(queries), k), np.inf)
        who = np.zeros((len(queries), k), dtype=np.int64)
        void = np.ones((len(queries), k), dtype=bool)
        limit = np.full(len(queries), np.inf) if limit is None else limit
        work = 0

        def visit(node: int, q: np.ndarray, bound: np.ndarray) -> None:
            nonlocal work
            q = q[~(bound * factor > np.minimum(near[q, -1], limit[q]))]
            if not len(q):
                return
            left, right, lo, hi = self.links[node].tolist()
            if left < 0:
                d = distances(queries[q], self.points[lo:hi])
                work += d.size
                ids = np.broadcast_to(self.ids[lo:hi], d.shape)
                own = ids == query_ids[q][:, None]
                d = np.where(own, np.inf, d)
                both, names, none = (np.concatenate(x, axis=1) for x in ((near[q], d), (who[q], ids), (void[q], own)))
                best = np.lexsort((names, none, both), axis=-1)[:, :k]
                near[q], who[q], void[q] = (np.take_along_axis(x, best, 1) for x in (both, names, none))
                return
            d = distances(queries[q], self.vantage[node][None])[:, 0]
            work += len(q)
            b = self.bounds[node]
            out = [_below(d, b[0], b[1]), _below(d, b[2], b[3])]
            first = d <= b[1] / 2 + b[2] / 2
            for child, mine, bound_ in ((left, first, out[0]), (right, ~first, out[1]), (right, first, out[1]), (left, ~first, out[0])):
                visit(child, q[mine], bound_[mine])

        if len(self.ids):
            visit(0, np.arange(len(queries)), np.zeros(len(queries)))
        return who, near, ~void & (near <= limit[:, None]), work


@dataclass
class Cells:
    """The top of a vantage-point tree: inner nodes (vantage point, radius, children); a child below zero is cell ~child."""

    vantage: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    links: list[list[int]] = field(default_factory=list)
    n: int = 0

    @staticmethod
    def fit(points: np.ndarray, cells: int) -> Cells:
        """At most ``cells`` cells, with as good as equal shares of ``points``."""
        out = Cells()

        def grow(some: np.ndarray, want: int) -> int:
            if want < 2 or len(some) < 2:
                out.n += 1
                return ~(out.n - 1)
            at, d = _vantage(some)
            radius = float(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
            inner = d <= radius
            if inner.all() or not np.isfinite(radius):
                out.n += 1
                return ~(out.n - 1)
            me = len(out.links)
            out.vantage.append(at)
            out.radius.append(radius)
            out.links.append([0, 0])
            out.links[me] = [grow(some[inner], want // 2), grow(some[~inner], want - want // 2)]
            return me

        grow(points, cells)
        return out

    def _walk(self, rows: np.ndarray, go) -> None:
        todo = [(0 if self.links else ~0, np.arange(len(rows)), np.zeros(len(rows)))]
        while todo:
            node, some, bound = todo.pop()
            if not len(some):
                continue
            if node < 0:
                go(None, ~node, some, bound)
                continue
            d = distances(rows[some], self.vantage[node][None])[:, 0]
            for side, child in enumerate(self.links[node]):
                todo.append((child, *go(node, side, some, bound, d)))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(len(rows), dtype=np.int32)

        def go(node, side, some, bound, d=None):
            if node is None:
                out[some] = side
                return None
            mine = (d <= self.radius[node]) == (side == 0)
            return some[mine], bound[mine]

        self._walk(rows, go)
        return out

    def within(self, rows: np.ndarray, limit: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows): the cells that the bounds do not put beyond each row's ``limit``."""
        found: list[tuple[int, np.ndarray]] = []

        def go(node, side, some, bound, d=None):
            if node is None:
                found.append((side, some))
                return None
            r = self.radius[node]
            bound = np.maximum(bound, _below(d, 0.0, r) if side == 0 else _below(d, r, np.inf))
            near = ~(bound * factor > limit[some])
            return some[near], bound[near]

        self._walk(rows, go)
        return iter(found)


def _matrix(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (one dimension) of Arrow columns."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return np.asarray(ids, dtype=np.int64), np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(ids), -1)


def _plant(table: pa.Table) -> pa.Table:
    ids, rows = _matrix(table.column("vec_id"), table.column("vector"))
    order = np.argsort(ids)
    tree = Tree.build(ids[order], rows[order])
    parts = [tree.ids, tree.points, tree.vantage, tree.bounds, tree.links]
    names = ["ids", "points", "vantage", "bounds", "links"]
    keys = [table.column(c).slice(0, 1) for c in ("dim", "cell", "shard")]
    return pa.Table.from_arrays([*keys, *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts]], ["dim", "cell", "shard", *names])


_TREE = "dim int, cell int, shard int, ids binary, points binary, vantage binary, bounds binary, links binary"
_ASKED = "dim int, cell int, to int, block int, query_ids binary, queries binary, limits binary, homes binary"


def _pack(table: pa.Table) -> pa.Table:
    """A block of queries of one cell as one row: ids, vectors, distance limits, and the shard of the cell that they have met (or -1)."""
    ids, rows = _matrix(table.column("vec_id"), table.column("vector"))
    limits, homes = (np.asarray(table.column(c)) for c in ("bound", "home"))
    order = np.argsort(ids, kind="stable")
    data = [ids[order], rows[order], limits[order].astype(np.float64), homes[order].astype(np.int32)]
    keys = [table.column(c).slice(0, 1) for c in ("dim", "cell", "to", "block")]
    return pa.Table.from_arrays([*keys, *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["dim", "cell", "to", "block", "query_ids", "queries", "limits", "homes"])


def _search(k: int, factor: float):
    """Rows sorted by (dim, cell, shard, kind): a shard's tree, then the blocks of queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for dim, cell, shard, *data in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:], strict=True):
                if data[1].is_valid:
                    at = (dim, cell, shard)
                    kinds, shapes = ("i8", "f8", "f8", "f8", "i8"), (-1, (-1, dim), (-1, dim), (-1, 4), (-1, 4))
                    tree = Tree(*(np.frombuffer(x.as_buffer(), dtype=t).reshape(s) for x, t, s in zip(data[1:6], kinds, shapes, strict=True)))
                elif at == (dim, cell, shard):
                    ids, rows, limits, homes = (np.frombuffer(x.as_buffer(), dtype=t).reshape(s) for x, t, s in zip(data[6:], ("i8", "f8", "f8", "i4"), (-1, (-1, dim), -1, -1), strict=True))
                    use = homes != shard
                    if use.any():
                        who, near, full, _ = tree.search(ids[use], rows[use], k, factor, limits[use])
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[use], full.sum(axis=1))), pa.array(who[full]), pa.array(near[full])], ["query_id", "vec_id", "score"])

    return run


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles) and dim of the rows that take part: no null, non-finite or all-zero vectors, no null id."""
    wide = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return wide.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def _once(vectors: DataFrame) -> DataFrame:
    """``vectors`` with one row of each vec_id: its smallest vector. Only repeated ids are exchanged with their vectors."""
    again = common.materialize(vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return vectors
    least = vectors.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return vectors.join(again, "vec_id", "left_anti").union(least.select("vec_id", "vector", F.size("vector").alias("dim")))


def fit_cells(vectors: DataFrame, sizes: dict[int, int], shard_rows: int) -> dict[int, Cells]:
    """The cells of each dimension, from a sample of at most FIT_ROWS rows and FIT_VALUES components (by hashed vec_id)."""
    want = {dim: min(CELLS, -(-n // shard_rows)) for dim, n in sizes.items()}
    out = {}
    for dim, cells in sorted(want.items()):
        if cells > 1:
            rows = max(2 * cells, min(FIT_ROWS, FIT_VALUES // dim))
            key = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30))
            some = vectors.where((F.col("dim") == dim) & (key <= int(min(1.0, rows / sizes[dim]) * (1 << 30)))).select("vec_id", "vector").orderBy(key, "vec_id").limit(rows).toArrow()
            out[dim] = Cells.fit(_matrix(some.column("vec_id"), some.column("vector"))[1], cells)
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each query among ``vectors`` (vec_id, vector, dim).

    Only vectors of a query's dimension are its candidates, its own id is not; ties go to the smaller
    vec_id; of rows that repeat a vec_id the smallest vector counts. No queries or no candidates give no rows.
    The driver holds one count per dimension and the cells of each dimension with more rows than a shard.
    """
    vectors = _once(vectors)
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    cells = fit_cells(vectors, sizes, shard_rows)
    one = Cells(n=1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                cell = cells[dim].of(_matrix(some.column(0), some.column(1))[1]) if dim in cells else np.zeros(len(some), np.int32)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell)], ["vec_id", "vector", "dim", "is_query", "cell"])

    marked = vectors.select("vec_id", "vector", "dim", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    placed = common.materialize(marked.mapInArrow(place, "vec_id long, vector array<double>, dim int, is_query boolean, cell int"), "placed")
    plan = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    plan = common.materialize(plan, "vector-plan")
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    dealt = placed.join(plan, ["dim", "cell"])
    trees = common.materialize(dealt.withColumn("shard", shard).select("dim", "cell", "shard", "vec_id", "vector").groupBy("dim", "cell", "shard").applyInArrow(_plant, _TREE), "trees")

    keys = ["dim", "cell", "shard"]
    tree_columns, query_columns = ["ids", "points", "vantage", "bounds", "links"], ["query_ids", "queries", "limits", "homes"]
    empty = lambda names: [F.lit(None).cast("binary").alias(c) for c in names]

    def meet(asked: DataFrame) -> DataFrame:
        """``asked``: dim, cell, to (a shard; null: all of the cell), vec_id, vector, bound, home (a shard to leave out, or -1)."""
        blocks = asked.groupBy("dim", "cell", "to").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        place_of = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int")
        blocked = asked.alias("a").join(blocks.alias("b"), F.expr("a.dim = b.dim and a.cell = b.cell and a.to <=> b.to")).select("a.*", place_of.alias("block"))
        packed = blocked.groupBy("dim", "cell", "to", "block").applyInArrow(_pack, _ASKED)
        every = F.sequence(F.lit(0), F.col("shards") - 1)
        sent = packed.join(plan, ["dim", "cell"]).withColumn("shard", F.explode(F.when(F.col("to").isNotNull(), F.array("to")).otherwise(every)))
        sent = common.materialize(sent.select(*keys, "block", *query_columns), "query-blocks")
        met = trees.join(sent.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(-1).alias("block"), *tree_columns, *empty(query_columns))
        rows = met.union(sent.select(*keys, "block", *empty(tree_columns), *query_columns))
        return rows.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")

    asked = dealt.where("is_query").select("dim", "cell", shard.alias("to"), "vec_id", "vector", F.lit(float("inf")).alias("bound"), F.lit(-1).alias("home"))
    first = common.materialize(meet(asked), "near-home")
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("kth")).withColumnRenamed("query_id", "vec_id")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                rows = _matrix(some.column(2), some.column(3))[1]
                limit, own, home = (np.asarray(some.column(i)) for i in (4, 1, 5))
                for cell, at in cells.get(dim, one).within(rows, limit, factor):
                    part = some.take(pa.array(at))
                    there = np.where(own[at] == cell, home[at], -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.full(len(at), cell, np.int32)), part.column(2), part.column(3), part.column(4), pa.array(there)], ["dim", "cell", "vec_id", "vector", "bound", "home"]
                    )

    bounded = asked.join(bound, "vec_id", "left").select("dim", "cell", "vec_id", "vector", F.coalesce("kth", F.lit(float("inf"))).alias("bound"), F.col("to").alias("home"))
    routed = common.materialize(bounded.mapInArrow(route, "dim int, cell int, vec_id long, vector array<double>, bound double, home int"), "routed")
    second = meet(routed.withColumn("to", F.lit(None).cast("int")))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = first.union(second).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of all ``embeddings`` for each hundredth one; factor one, so exact."""
    return nearest(valid_vectors(common.table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, 
    sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
