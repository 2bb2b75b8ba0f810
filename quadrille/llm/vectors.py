"""Nearest neighbours by few stable projections, a kd-tree on them, and a chi-square stop.

Largest inner product becomes smallest distance by one more coordinate: a candidate x gets
sqrt(M * M - |x|^2), a query 0.  Projections on orthonormalised normal vectors keep a distance d, by
their scale, as d * sqrt(chi-square with as many degrees of freedom) or closer.  A kd-tree on projected points,
fitted on a bounded sample, deals all candidates into cells.  A query takes points by projected distance
and verifies their vectors exactly, until the next one's squared projected distance is above the chi-square
quantile ``confidence`` times its k-th best squared distance: a nearer neighbour would have shown up already with that
probability.  It starts in its own cell; what it finds there bounds the cells it goes to next.  Within a cell the tree goes
on down to leaves of some 64 points, opened by the distance of their boxes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .session import checkpointed, discard


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    #: An even number: the chi-square test has a closed form then.  Fewer where vectors are shorter.
    projections: int = 24
    confidence: float = 0.9
    #: Points that a query verifies before it first looks at the stop.
    first: int = 32
    #: About so many candidates make a cell of the kd-tree, which one task holds, and at most so many a leaf within it.
    cell_rows: int = 8192
    leaf_rows: int = 64
    #: About so many rows fit the kd-tree (all rows are indexed by it).
    sample: int = 32_768
    seed: int = 42


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part: no null or non-finite component, not zero, ``dim`` long."""
    inf = F.lit(float("inf"))
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good if dim is None else good & (F.size(vector) == dim), F.lit(False))


def _tail(x: float, degrees: int) -> float:
    """P(chi-square > x) for even degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return float(np.exp(-half) * total)


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 40.0 * degrees
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, degrees) > 1 - p else (low, mid)
    return high


@dataclass
class ProjectionIndex:
    """Projections, the largest squared norm, the stop, and the kd-tree's cells as boxes."""

    normal: np.ndarray
    most: float
    stop: float
    #: Splits by node: axis (-1: a leaf), value, and left child (the right one follows) or cell.
    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, dim: int, most: float, cells: int, p: AnnParams) -> ProjectionIndex:
        m = max(2, min(p.projections, (dim + 1) // 2 * 2))
        q, _ = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((max(m, dim + 1), m)))
        normal = q[: dim + 1] * np.sqrt(max(m, dim + 1))
        index = ProjectionIndex(normal, most, chi_square_quantile(p.confidence, m), *[np.zeros(0)] * 5)
        points = index.project(sample)
        axis, value, child, boxes = [-1], [0.0], [0], []
        todo = [(0, np.arange(len(points)), cells, np.full(m, -np.inf), np.full(m, np.inf))]
        while todo:
            node, ids, share, low, high = todo.pop()
            own = points[ids]
            spread = own.max(axis=0) - own.min(axis=0) if len(ids) else np.zeros(m)
            a = int(spread.argmax())
            if share < 2 or len(ids) < 8 or not spread[a]:
                child[node] = len(boxes)
                boxes.append((low, high))
                continue
            values = np.sort(own[:, a])
            cut = float(values[len(values) * (share // 2) // share])
            cut = cut if cut > values[0] else float(values[values > values[0]][0])
            axis[node], value[node], child[node] = a, cut, len(axis)
            axis += [-1, -1]
            value += [0.0, 0.0]
            child += [0, 0]
            below, above = high.copy(), low.copy()
            below[a], above[a] = cut, cut
            todo += [(child[node], ids[own[:, a] < cut], share // 2, low, below), (child[node] + 1, ids[own[:, a] >= cut], share - share // 2, above, high)]
        index.axis, index.value, index.child = np.array(axis), np.array(value), np.array(child)
        index.low, index.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        return index

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        out = x @ self.normal[:-1]
        return out if query else out + np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None] * self.normal[-1]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.child[node]
            at = node[inner]
            node[inner] = self.child[at] + (points[inner, self.axis[at]] >= self.value[at])

    def within(self, point: np.ndarray, squared: float) -> np.ndarray:
        """The cells whose box is within the stop's reach of a query with that k-th squared distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= self.stop * squared)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best by score, then id; of a repeated id the best only."""
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    _, at = np.unique(ids, return_index=True)
    at = np.sort(at)[:k]
    return ids[at], score[at]


@dataclass
class Leaves:
    """A kd-tree over one group's projected points: points in leaf order, where each leaf begins, and its tight box."""

    points: np.ndarray
    square: np.ndarray
    #: For each place in leaf order the row it came from.
    row: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def grow(points: np.ndarray, size: int) -> Leaves:
        """Splits at the median of the widest axis down to ``size`` points; equal points may part anywhere."""
        todo, done = ([np.arange(len(points))] if len(points) else []), []
        while todo:
            ids = todo.pop()
            own = points[ids]
            spread = own.max(axis=0) - own.min(axis=0)
            axis, half = int(spread.argmax()), len(ids) // 2
            if len(ids) <= size or not spread[axis]:
                done.append(ids)
                continue
            order = ids[np.argpartition(own[:, axis], half)]
            todo += [order[half:], order[:half]]
        row = np.concatenate(done) if done else np.zeros(0, np.int64)
        start = np.cumsum([0, *[len(ids) for ids in done]])
        points, at = points[row], start[:-1]
        low, high = (f.reduceat(points, at, axis=0) if done else points for f in (np.minimum, np.maximum))
        return Leaves(points, (points * points).sum(axis=1), row, start, low, high)

    def nearest_first(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves by the squared distance of their box, and these distances with an infinite one at the end."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        reach = (gap * gap).sum(axis=1)
        order = np.argsort(reach, kind="stable")
        return order, np.append(reach[order], np.inf)

    def opened(self, leaves: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared projected distances of the leaves' points, and their rows; leaves that lie together are one product."""
        leaves = np.sort(leaves)
        cut = np.flatnonzero(np.diff(leaves) > 1) + 1
        runs = [slice(self.start[leaves[i]], self.start[leaves[j - 1] + 1]) for i, j in zip([0, *cut], [*cut, len(leaves)], strict=True)]
        gap = np.concatenate([self.square[r] - 2 * (self.points[r] @ point) for r in runs]) + point @ point
        return np.maximum(gap, 0), np.concatenate([self.row[r] for r in runs])


@dataclass
class Found:
    """What one query found in one group: the k-th squared distance, how many vectors it verified and points it projected on."""

    ids: np.ndarray
    score: np.ndarray
    kth: float
    verified: int
    opened: int


def search(index: ProjectionIndex, tree: Leaves, q: np.ndarray, qid: int, kth: float, c: np.ndarray, cid: np.ndarray, p: AnnParams) -> Found:
    """The best ``k`` of a group's candidates that are not farther than ``kth``, the squared distance already known to hold
    k neighbours.

    Leaves open by the distance of their box, and a point is verified once no unopened box is nearer than it; so points
    come in order of projected distance.  The stop is looked at before each wave of half of what was verified."""
    far = float(q @ q) + index.most
    point = index.project(q[None, :], query=True)[0]
    order, reach = tree.nearest_first(point)
    out = Found(np.zeros(0, np.int64), np.zeros(0), kth, 0, 0)
    # Points of open leaves by distance, of which the first ``done`` are verified.
    gap, row, done, at = np.zeros(0), np.zeros(0, np.int64), 0, 0
    while True:
        bound = index.stop * out.kth
        nearest = gap[done] if done < len(gap) else np.inf
        if min(nearest, reach[at]) > bound or (at == len(order) and done == len(gap)):
            return out
        if at < len(order) and reach[at] <= nearest:
            upto = int(np.searchsorted(reach[:-1], max(reach[at], nearest if nearest < np.inf else 0.0), side="right"))
            # At least half as many leaves again as are open, so that points are sorted few times.
            upto = max(upto, min(at + 1 + at // 2, int(np.searchsorted(reach[:-1], bound, side="right"))))
            more, rows = tree.opened(order[at:upto], point)
            out.opened, at = out.opened + len(more), upto
            within = more <= bound
            gap, row = np.concatenate([gap[done:], more[within]]), np.concatenate([row[done:], rows[within]])
            sort = np.argsort(gap)
            gap, row, done = gap[sort], row[sort], 0
            continue
        ready = int(np.searchsorted(gap, min(reach[at], bound), side="right"))
        rows = np.sort(row[done : min(ready, done + max(p.first, out.verified // 2))])
        done += len(rows)
        out.verified += len(rows)
        mine = c.take(rows, axis=0) @ q
        near = (far - 2 * mine <= out.kth) & (cid[rows] != qid)
        if near.any():
            out.ids, out.score = _best(np.concatenate([out.ids, cid[rows[near]]]), np.concatenate([out.score, mine[near]]), p.k)
            if len(out.ids) == p.k:
                out.kth = min(out.kth, max(far - 2 * float(out.score[-1]), 0.0) * (1 + 1e-12) + 1e-300)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


_FOUND = "query_id long, vec_id long, score double, verified long, opened long, cell int, part int, v array<{kind}>, kth double"
_NAMES = ["query_id", "vec_id", "score", "verified", "opened", "cell", "part", "v", "kth"]


def _searched(batches: Iterator[pa.RecordBatch], index: ProjectionIndex, p: AnnParams) -> Iterator[pa.RecordBatch]:
    """Groups (cell, part) of rows in order, candidates before queries, which stream by: for each query its best
    candidates, and one row with what it verified, its vector and its k-th squared distance."""
    group, held, c = None, [], None
    for batch in batches:
        cell, part, role = (batch.column(x).to_numpy() for x in ("cell", "part", "role"))
        ids, kth, v = batch.column("id").to_numpy(), batch.column("kth").to_numpy(zero_copy_only=False), batch.column("v")
        edge = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1 if len(cell) else []
        for i, j in zip([0, *edge], [*edge, len(cell)], strict=True):
            if i == j:
                continue
            if group != (cell[i], part[i]):
                group, held, c = (cell[i], part[i]), [], None
            x = _vectors(v.slice(i, j - i))
            if not role[i]:
                held.append((ids[i:j], x))
                continue
            if c is None:
                cid = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
                c = np.concatenate([h[1] for h in held]) if held else np.zeros((0, x.shape[1]))
                tree = Leaves.grow(index.project(c) if len(c) else np.zeros((0, 1)), p.leaf_rows)
            out = [search(index, tree, x[n], int(ids[i + n]), float(kth[i + n]), c, cid, p) for n in range(j - i)]
            size = np.array([len(o.ids) for o in out])
            total = int(size.sum())
            none = lambda kind, n: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[i:j], size)), pa.array(np.concatenate([o.ids for o in out])), pa.array(np.concatenate([o.score for o in out])), none(pa.int64(), total), none(pa.int64(), total), none(pa.int32(), total), none(pa.int32(), total), none(v.type, total), none(pa.float64(), total)],
                _NAMES,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i:j]), none(pa.int64(), j - i), none(pa.float64(), j - i), pa.array([o.verified for o in out], pa.int64()), pa.array([o.opened for o in out], pa.int64()), pa.array(cell[i:j]), pa.array(part[i:j]), v.slice(i, j - i), pa.array([o.kth for o in out], pa.float64())],
                _NAMES,
            )


def nearest(vectors: DataFrame, is_query: Column, params: AnnParams = AnnParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, verified, opened: the ``k`` found for each row of ``vectors`` with ``is_query``,
    how many candidates the query compared in full, and how many stood in leaves that it opened.

    Every other row is a candidate; rows with the query's own id are not.  Order: score (inner
    product in double precision) down, then id.  Rows with a null id, or a vector that is null, empty,
    zero, or has null or non-finite components, or is not as long as most are, take no part.
    A repeated id gives one list of results for each of its rows' best, merged.

    A sample of about ``sample`` rows fits the tree; every row is dealt to a cell, a cell above ``cell_rows`` into parts
    (so equal vectors make no large group).  Candidates are shuffled twice: to meet the queries of their own part, and to
    meet those that the stop does not keep from their cell.  Queries stream by a group's candidates, so a task's memory is
    bounded."""
    kind = "double" if dict(vectors.dtypes)[vector_col] != "array<float>" else "float"
    v = F.col(vector_col) if kind == "float" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null").where(usable(F.col("v")))
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy(F.desc("n"), "dim").first()
    dim, n, most = (sizes.dim, sizes.n, sizes.most) if sizes else (1, 0, 1.0)
    rows = rows.where(F.size("v") == dim)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(params.seed), "id", "v"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, params.sample / max(n, 1))))
    sample = np.array([r.v for r in drawn.select("v").collect()], float).reshape(-1, dim)
    index = vectors.sparkSession.sparkContext.broadcast(ProjectionIndex.fit(sample, dim, most * (1 + 1e-12), max(1, -(-n // params.cell_rows)), params))

    def deal(batches):
        for batch in batches:
            x = _vectors(batch.column("v"))
            cell = index.value.cell(index.value.project(x)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "v", "q", "cell"])

    dealt = checkpointed(rows.mapInArrow(deal, f"id long, v array<{kind}>, q boolean, cell int"))
    cells = checkpointed(dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(params.cell_rows)).cast("int").alias("parts")))
    placed = dealt.join(cells, "cell").select("cell", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part"), "id", "v", "q")
    candidates = placed.select("cell", "part", F.lit(0).alias("role"), "id", "v", F.lit(float("inf")).alias("kth"))

    def met(queries: DataFrame) -> DataFrame:
        both = candidates.unionAll(queries.select("cell", "part", F.lit(1).alias("role"), "id", "v", "kth"))
        groups = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "part").sortWithinPartitions("cell", "part", "role")
        return checkpointed(groups.mapInArrow(lambda b: _searched(b, index.value, params), _FOUND.format(kind=kind)))

    home = met(placed.where("q").withColumn("kth", F.lit(float("inf"))))

    def onward(batches):
        for batch in batches:
            x, kth = _vectors(batch.column("v")), batch.column("kth").to_numpy()
            point = index.value.project(x, query=True) if batch.num_rows else x
            cell = [index.value.within(point[i], kth[i]).astype(np.int32) for i in range(len(kth))]
            size = np.array([len(c) for c in cell], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(cell) if len(cell) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "v", "kth", "own_cell", "own_part", "to"])

    asked = home.where("v is not null").select(F.col("query_id").alias("id"), "v", "kth", F.col("cell").alias("own_cell"), F.col("part").alias("own_part"))
    sent = asked.mapInArrow(onward, f"id long, v array<{kind}>, kth double, own_cell int, own_part int, to array<int>").withColumn("cell", F.explode("to"))
    sent = sent.join(cells, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell <> own_cell or part <> own_part")
    more = met(sent)
    discard(dealt)
    found = home.select("query_id", "vec_id", "score", "verified", "opened").unionAll(more.select("query_id", "vec_id", "score", "verified", "opened"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("verified"), F.sum("opened").alias("opened"))
    mine = W.partitionBy("query_id")
    ranked = found.withColumns({f"all_{c}": F.coalesce(F.sum(c).over(mine), F.lit(0)) for c in ("verified", "opened")}).where("vec_id is not null")
    ranked = ranked.withColumn("rank", F.row_number().over(mine.orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= params.k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.col("all_verified").alias("verified"), F.col("all_opened").alias("opened"))
