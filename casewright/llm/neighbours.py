"""Nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on M axes (orthogonal ones, as far as the dimension allows). A block of rows holds, for each
axis, its rows sorted by their projection; a query's window is a range of ranks around its own projection, and a vector's
collisions are the axes in whose window it lies. Vectors that reach the threshold are verified by their exact distance.

1. Rows are put together by their nearest pivot, of a bounded sample (PIVOTS rows at most); large cells are cut into
   blocks of BLOCK rows. Every row is in one block.
2. In one block near to it a query widens its windows (virtual rehashing: the same arrays at a growing radius) until TOP
   vectors are verified. The last of their distances bounds the query's radius in the whole table.
3. The ranges of each block's arrays make a directory, bounded by the number of blocks. A block whose ranges meet fewer of the
   query's windows than the threshold holds no vector that could reach it, so the query isn't sent there. In the others
   the windows of that radius are counted and verified, and the blocks' answers merge.

A true neighbour at exactly the radius reaches the threshold with probability 0.97 or more (measured), nearer ones more surely.
Without structure in the vectors every query still meets every block: then work is the product of queries and rows, with a
small share of the rows verified. `verified` in the search's output counts them.

Defined cases: vectors null, empty, zero or holding null or non-finite components take no part; vectors of unlike length
never meet; fewer candidates than asked are all returned; ties go to the smaller vec_id; rows that repeat a query's vec_id
count as the query's own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

M, WIDTH, THRESHOLD, GROWTH, SEED = 128, 1.3, 0.765, 1.5, 5
#: Rows of a block, queries that meet a block in one task, pivots at most, and cells of queries x rows counted at once.
BLOCK, QUERIES, PIVOTS, CELLS = 8192, 16384, 16384, 1 << 19
NEED = int(np.ceil(THRESHOLD * M))
HOME = "block long, dim int, low binary, high binary, query_id long, qh long, radius double"
FOUND = "query_id long, qh long, vec_id long, score double, verified long"


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    return vectors.where(fine).select(vectors["vec_id"].cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("dim", F.size("embedding"))


def axes(dim: int) -> np.ndarray:
    """M directions as columns: random orthonormal bases side by side, scaled so that each projection has the spread of a
    random direction's. Within a basis the squared projections sum to the squared distance, which sharpens the counts."""
    r = np.random.default_rng(SEED)
    bases = [np.linalg.qr(r.standard_normal((dim, dim if dim <= M else M)))[0] * np.sqrt(dim) for _ in range(-(-M // min(dim, M)))]
    return np.concatenate(bases, axis=1)[:, :M]


def _vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class Block:
    """Sorted projection arrays of a block of vectors, kept as sorted values and every row's rank, axis by axis."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        h = (x @ axes(x.shape[1])).astype(np.float32).T
        order = np.argsort(h, axis=1, kind="stable")
        self.values = np.take_along_axis(h, order, axis=1)
        self.ranks = np.empty(h.shape, np.uint16 if len(ids) < 65535 else np.uint32)
        np.put_along_axis(self.ranks, order, np.arange(len(ids), dtype=self.ranks.dtype)[None], axis=1)

    def collisions(self, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(query, row): in how many windows of half-width WIDTH * radius around the query's projections the row lies."""
        counts, half, kind = np.zeros((len(at), len(self.ids)), np.uint8), WIDTH * radius, self.ranks.dtype
        for i, (values, rank) in enumerate(zip(self.values, self.ranks)):
            low = np.searchsorted(values, (at[:, i] - half).astype(np.float32), "left")
            size = np.searchsorted(values, (at[:, i] + half).astype(np.float32), "right") - low
            counts += (rank[None] - low.astype(kind)[:, None]) < size.astype(kind)[:, None]
        return counts

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))

    def best(self, own: int, q: np.ndarray, rows: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        d = self.exact(q, rows)
        first = np.lexsort((self.ids[rows], d))[:top]
        return self.ids[rows[first]], d[first]

    def chunks(self, q: np.ndarray):
        step = max(1, CELLS // max(1, len(self.ids)))
        at = q @ axes(q.shape[1])
        for lo in range(0, len(q), step):
            yield np.arange(lo, min(lo + step, len(q))), at[lo : lo + step]

    def radii(self, own: np.ndarray, q: np.ndarray, top: int) -> np.ndarray:
        """A bound on each query's TOP-th distance: windows widen until so many rows are verified. Infinite if the block has
        fewer rows."""
        out = np.full(len(q), np.inf)
        for which, at in self.chunks(q):
            near = np.minimum(len(self.ids) - 1, 4 * top)
            radius = np.maximum(np.median(self.values[:, near] - self.values[:, 0]), 1e-9) * np.ones(len(which))
            left = np.arange(len(which))
            while len(left):
                counts = self.collisions(at[left], radius[left])
                go_on = []
                for k, j in enumerate(left):
                    i = which[j]
                    ids, d = self.best(own[i], q[i], np.flatnonzero(counts[k] >= NEED), top)
                    if len(d) == top:
                        out[i] = d[-1]
                    elif counts[k].min() < M:  # some row lies outside a window still
                        go_on.append(j)
                left = np.array(go_on, np.int64)
                radius[left] *= GROWTH
        return out


def _home(top: int):
    """For a block: a row with the ranges of its arrays, and the radius of every query that starts there."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("block", "dim", "low", "high", "query_id", "qh", "radius"), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64()))})
        block = Block(rows.column("vec_id").to_numpy(), _vectors(rows.column("embedding")))
        n, own = queries.num_rows, queries.column("vec_id").to_numpy()
        radius = block.radii(own, _vectors(queries.column("embedding")), top) if n else np.zeros(0)
        none = [None] * n
        return pa.table({
            "block": pa.array([rows.column("block")[0].as_py(), *none], pa.int64()), "dim": pa.array([block.x.shape[1], *none], pa.int32()),
            "low": pa.array([block.values[:, 0].tobytes(), *none], pa.binary()), "high": pa.array([block.values[:, -1].tobytes(), *none], pa.binary()),
            "query_id": pa.array([None, *own.tolist()], pa.int64()), "qh": pa.array([None, *queries.column("qh").to_pylist()], pa.int64()), "radius": pa.array([None, *radius.tolist()], pa.float64())})
    return run


def _route(directory: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """(query, block) for the blocks whose ranges meet enough of the query's windows."""
    def run(batches):
        for b in batches:
            dims, radius = b.column("dim").to_numpy(), b.column("radius").to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                blocks, low, high = directory[int(dim)]
                at = _vectors(b.column("embedding").take(pa.array(rows))) @ axes(int(dim))
                for lo in range(0, len(rows), 64):
                    some = slice(lo, lo + 64)
                    half = WIDTH * radius[rows[some]][:, None, None]
                    meets = ((low[None] <= at[some][:, None] + half) & (high[None] >= at[some][:, None] - half)).sum(axis=2) >= NEED
                    q, k = np.nonzero(meets)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows[some][q])) for c in ("vec_id", "embedding", "dim", "qh", "radius")), pa.array(blocks[k])], ["vec_id", "embedding", "dim", "qh", "radius", "block"])
    return run


def _search(top: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            block = Block(rows.column("vec_id").to_numpy(), _vectors(rows.column("embedding")))
            own, qh, radius, q = queries.column("vec_id").to_numpy(), queries.column("qh").to_numpy(), queries.column("radius").to_numpy(), _vectors(queries.column("embedding"))
            for which, at in block.chunks(q):
                counts = block.collisions(at, radius[which])
                for k, i in enumerate(which):
                    rows_ = np.flatnonzero(counts[k] >= NEED)
                    ids, d = block.best(own[i], q[i], rows_, top)
                    out.append((np.full(len(ids), own[i]), np.full(len(ids), qh[i]), ids, d, np.full(len(ids), len(rows_))))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "qh", "vec_id", "score", "verified"])
    return run


def _nearest_pivot(pivots: dict[int, np.ndarray]):
    """Adds cell: the number of the nearest pivot of the same dimension, or -1."""
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.full(len(dims), -1, np.int64)
            for dim in np.unique(dims):
                if int(dim) in pivots:
                    p = pivots[int(dim)]
                    rows = np.flatnonzero(dims == dim)
                    for lo in range(0, len(rows), 1024):
                        x = _vectors(b.column("embedding").take(pa.array(rows[lo : lo + 1024])))
                        cell[rows[lo : lo + 1024]] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])
    return run


def search(vectors: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """query_id, qh (the query's hash), vec_id, score, verified: the best of every block that a query was sent to."""
    rows, asked = materialize(usable(vectors)), usable(queries).dropDuplicates(["vec_id", "embedding"])
    asked = materialize(asked.withColumn("qh", F.xxhash64("vec_id", "embedding")))
    n = rows.count()
    size = max(BLOCK, -(-n // PIVOTS))
    wanted = -(-n // size)
    pivots: dict[int, list] = {}
    if wanted > 1:
        for r in rows.orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(wanted).collect():  # PIVOTS rows at most
            pivots.setdefault(r.dim, []).append(r.embedding)
    held = {dim: np.array(p) for dim, p in pivots.items()}
    cells = materialize(rows.mapInArrow(_nearest_pivot(held), "vec_id long, embedding array<double>, dim int, cell long"))
    many = {(r.dim, r.cell): r["count"] for r in cells.groupBy("dim", "cell").count().collect()}  # a row a pivot
    if not many:
        return rows.sparkSession.createDataFrame([], FOUND)
    first, at = {}, 0
    for key, count in sorted(many.items()):
        first[key] = (at, -(-count // size))
        at += first[key][1]
    table = rows.sparkSession.createDataFrame([(*k, start, parts) for k, (start, parts) in first.items()], "dim int, cell long, start long, parts long")
    # a row's part comes from its number, not from its content, so equal rows spread
    blocks = materialize(cells.join(F.broadcast(table), ["dim", "cell"]).select("vec_id", "embedding", "dim", (F.col("start") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))).alias("block")))
    # a query starts at its nearest pivot among those with rows enough
    full: dict[int, list[int]] = {}
    for dim, cell in sorted(many):
        if many[dim, cell] > 4 * top:
            full.setdefault(dim, []).append(cell)
    rich = {dim: held[dim][c] for dim, c in full.items() if dim in held}
    starts = rows.sparkSession.createDataFrame([(dim, k, *first[dim, c]) for dim, cs in full.items() for k, c in enumerate(cs if dim in held else [-1])] or [(0, 0, 0, 1)], "dim int, cell long, start long, parts long")
    homes = asked.mapInArrow(_nearest_pivot(rich), "vec_id long, embedding array<double>, dim int, qh long, cell long").withColumn("cell", F.greatest("cell", F.lit(0))).join(F.broadcast(starts), ["dim", "cell"], "left")
    homes = homes.select("vec_id", "embedding", "qh", (F.col("start") + F.pmod(F.col("qh"), F.col("parts"))).alias("block"))
    begun = materialize(homes.where("block IS NOT NULL").groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_home(top), HOME))
    directory: dict[int, list] = {}
    for r in begun.where("block IS NOT NULL").select("block", "dim", "low", "high").toLocalIterator():  # a row a block
        directory.setdefault(r.dim, []).append((r.block, np.frombuffer(r.low, np.float32), np.frombuffer(r.high, np.float32)))
    ranges = {dim: (np.array([x[0] for x in d]), np.array([x[1] for x in d]), np.array([x[2] for x in d])) for dim, d in directory.items()}
    radius = begun.where("query_id IS NOT NULL").select(F.col("query_id").alias("vec_id"), "qh", "radius")
    known = asked.where(F.col("dim").isin([int(d) for d in ranges])).join(radius, ["vec_id", "qh"], "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    sent = materialize(known.select("vec_id", "embedding", "dim", "qh", "radius").mapInArrow(_route(ranges), "vec_id long, embedding array<double>, dim int, qh long, radius double, block long"))
    sets = materialize(sent.groupBy("block").count().select("block", F.ceil(F.col("count") / QUERIES).cast("int").alias("sets")))  # a row a block
    left = sent.join(F.broadcast(sets), "block").select("block", "vec_id", "embedding", "qh", "radius", F.expr("cast(pmod(qh, sets) AS int) AS part"))
    right = blocks.join(F.broadcast(sets), "block").select("block", "vec_id", "embedding", F.expr("explode(sequence(0, sets - 1)) AS part"))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(top), FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest rows of each query, by Euclidean distance."""
    order = Window.partitionBy("query_id", "qh").orderBy("score", "vec_id")
    return search(vectors, queries, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
