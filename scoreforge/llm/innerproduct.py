"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz residual bounds.

Vectors become whole numbers and are range-partitioned by descending length into blocks.
Queries meet the longest vectors first, which gives each a threshold: its k-th best score there.  As
<q, c> <= |q| |c|, a query can pass by every block whose longest vector is shorter than threshold / |q|;
queries are therefore dealt to blocks by that quotient, and a block of queries meets a prefix of the vector blocks.

In a cell (query block, vector block) vectors are taken by descending length in chunks, until no query
can gain.  Both sides are rotated by the singular vectors of all vectors, strongest first, so that the first coordinates hold
most of a product: the partial sum over them plus the product of the residual lengths bounds the whole.  What the
bounds leave is scored exactly in whole numbers.  A query's best of all its cells are its result.

Defined cases: null vectors and vectors with null or non-finite components take no part; a shorter
vector counts as ended by zeros, an empty one scores 0; a row with a null id is a candidate that
loses ties; repeated rows are rows of their own, each query row gets its own result; components and scores
saturate at the long range; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

NONE = np.iinfo(np.int64).min
#: Products of vectors below this length are exact in double arithmetic, in any order of summation.
EXACT_LENGTH = float(1 << 26)
SLACK = 1e-10


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, ended by zeros up to ``dims``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(sizes) * dims:
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def usable(vector: Column) -> Column:
    """Whether a vector has components only that are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, vector, length): floor(scale * x) of every usable vector."""
    parts = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), parts.alias("vector"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(squares))


def rotation(rows: DataFrame, dims: int, partials: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of all vectors and their energies, strongest first, from sums of outer products.

    The driver gets at most ``partials`` matrices of dims x dims.
    """
    schema = "part int, gram binary"

    def outer(batches):
        gram = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column("vector"), dims).astype(np.float64)
            gram += x.T @ x
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % partials], pa.int32()),
                                          "gram": pa.array([gram.tobytes()], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g, np.float64) for g in table.column("gram").to_pylist())
        return pa.table({"part": table.column("part")[:1], "gram": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("vector").mapInArrow(outer, schema).groupBy("part").applyInArrow(added, schema).collect()
    gram = sum(np.frombuffer(r["gram"], np.float64) for r in found).reshape(dims, dims)
    values, turned = np.linalg.eigh(gram / max(1.0, np.abs(gram).max()))
    order = np.argsort(-values)
    return turned[:, order], np.maximum(values[order], 0)


def stages(energy: np.ndarray) -> list[int]:
    """Numbers of leading coordinates that hold half and nine tenths of the squared length."""
    if not len(energy) or energy.sum() <= 0:
        return []
    held = np.cumsum(energy) / energy.sum()
    cuts = {int(np.searchsorted(held, share)) + 1 for share in (0.5, 0.9)}
    return sorted(c for c in cuts if c < len(energy))


class Side:
    """Vectors of one side of a cell: whole numbers, rotated coordinates, residual lengths after each stage."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray, cuts: list[int]):
        self.small = not len(whole) or float(np.abs(whole).astype(np.float64).max()) * np.sqrt(whole.shape[1]) < EXACT_LENGTH
        self.whole = whole
        self.plain = whole.astype(np.float64)
        self.length = np.sqrt((self.plain * self.plain).sum(axis=1))
        self.turned = self.plain @ turn
        ends = np.cumsum((self.turned * self.turned)[:, ::-1], axis=1)[:, ::-1] if len(cuts) else self.turned
        self.rest = [np.sqrt(ends[:, c]) for c in cuts]

    def products(self, i, other: "Side", j) -> np.ndarray:
        """Exact inner products of all rows ``i`` with all rows ``j``."""
        if self.small and other.small:
            return np.rint(self.plain[i] @ other.plain[j].T).astype(np.int64)
        return _saturated(self.whole[i].astype(object) @ other.whole[j].astype(object).T)

    def pairs(self, i, other: "Side", j) -> np.ndarray:
        """Exact inner products of row i[k] with row j[k]."""
        if self.small and other.small:
            return np.rint(np.einsum("ij,ij->i", self.plain[i], other.plain[j])).astype(np.int64)
        return _saturated((self.whole[i].astype(object) * other.whole[j].astype(object)).sum(axis=1))


def _saturated(values: np.ndarray) -> np.ndarray:
    low, high = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    return np.array([min(max(int(v), low), high) for v in values.ravel()], np.int64).reshape(values.shape)


class Best:
    """The k best (score, smaller id first) of each query; ``floor`` is the k-th score or a threshold known before."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.query = self.place = self.score = np.zeros(0, np.int64)
        self.queries = queries

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray, rank: np.ndarray):
        """``rank`` orders the places of the cell by id, and so equal scores."""
        query, place, score = (np.concatenate(x) for x in ((self.query, query), (self.place, place), (self.score, score)))
        order = np.lexsort((rank[place], -score, query))
        query, place, score = query[order], place[order], score[order]
        first = np.searchsorted(query, np.arange(self.queries))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.place, self.score = query[keep], place[keep], score[keep]
        last = np.arange(len(query)) - first[query] == self.k - 1
        np.maximum.at(self.floor, query[last], score[last])


def search(queries: Side, own: np.ndarray, vectors: Side, rows: np.ndarray, rank: np.ndarray, floor: np.ndarray,
           k: int, cuts: list[int], chunk: int = 1024) -> Best:
    """Best vectors of each query with scores of ``floor`` or more.

    ``vectors`` come by descending length; ``own`` and ``rows`` tell a query's own row; ``rank`` orders ids.
    """
    best = Best(len(own), k, floor)
    for a in range(0, len(rows), chunk):
        at = np.arange(a, min(a + chunk, len(rows)))
        slack = SLACK * queries.length * vectors.length[a] + SLACK
        active = np.flatnonzero(queries.length * vectors.length[a] + slack >= best.floor)
        if not len(active):
            break                              # no later vector is longer
        for part in np.array_split(active, len(active) // 1024 + 1):
            for found in _survivors(queries, part, vectors, at, best.floor, slack, cuts, own, rows, rank, k):
                best.add(*found, rank)
    return best


def _survivors(queries, part, vectors, at, floor, slack, cuts, own, rows, rank, k):
    need = (floor[part].astype(np.float64) - slack[part])[:, None]
    alive = None
    if cuts:
        c = cuts[0]
        bound = queries.turned[part, :c] @ vectors.turned[at, :c].T + queries.rest[0][part][:, None] * vectors.rest[0][at]
        alive = bound >= need
    if alive is not None and alive.mean() < 0.1:
        i, j = np.nonzero(alive)
        i, j = part[i], at[j]
        for before, (c, rest_q, rest_v) in zip(cuts, list(zip(cuts, queries.rest, vectors.rest))[1:]):
            partial = np.einsum("ij,ij->i", queries.turned[i, :c], vectors.turned[j, :c])
            stay = partial + rest_q[i] * rest_v[j] >= floor[i].astype(np.float64) - slack[i]
            i, j = i[stay], j[stay]
        score = queries.pairs(i, vectors, j)
        good = (score >= floor[i]) & (own[i] != rows[j])
        yield i[good], j[good], score[good]
        return
    by_id = at[np.argsort(rank[at], kind="stable")]
    score = queries.products(part, vectors, by_id)
    good = (score >= floor[part][:, None]) & (own[part][:, None] != rows[by_id])
    many = good.sum(axis=1) > 4 * k
    if many.any():                             # columns go by id: a stable order keeps the right ones of equal scores
        order = np.argsort(np.where(good[many], ~score[many], np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
        kept = np.zeros_like(good[many])
        np.put_along_axis(kept, order, True, axis=1)
        good[many] &= kept
    i, j = np.nonzero(good)
    yield part[i], by_id[j], score[i, j]


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


def _rank(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, null))] = np.arange(len(ids))
    return rank


def _thresholds(shared, dims: int, k: int):
    """Each query's k-th best score among the longest vectors."""
    schema = "row long, vec_id long, vector array<long>, length double, floor long, cutoff double"

    def run(batches):
        rows, whole, turn, cuts = shared.value
        head = Side(whole, turn, cuts)
        for batch in batches:
            own = batch.column("row").to_numpy()
            side = Side(matrix(batch.column("vector"), dims), turn, cuts)
            found = search(side, own, head, rows, np.arange(len(rows)), np.full(len(own), NONE), k, cuts)
            with np.errstate(divide="ignore", invalid="ignore"):
                cutoff = np.where((side.length > 0) & (found.floor > NONE), found.floor / side.length, -np.inf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.floor), pa.array(cutoff)], names=[*batch.schema.names, "floor", "cutoff"])
    return run, schema


def _cell(shared, dims: int, k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        turn, cuts = shared.value
        if not queries.num_rows or not vectors.num_rows:
            return _RESULT.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors, [("length", "descending"), ("row", "ascending")]))
        ids, null = _ids(vectors.column("vec_id"))
        own, rows = queries.column("row").to_numpy(), vectors.column("row").to_numpy()
        found = search(Side(matrix(queries.column("vector"), dims), turn, cuts), own,
                       Side(matrix(vectors.column("vector"), dims), turn, cuts), rows, _rank(ids, null),
                       queries.column("floor").to_numpy(), k, cuts)
        return pa.table([pa.array(own[found.query]), queries.column("vec_id").take(pa.array(found.query)),
                         vectors.column("vec_id").take(pa.array(found.place)), pa.array(found.score)], schema=_RESULT)
    return run


_RESULT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
RESULT = "query_row long, query_id long, vec_id long, score long"


def _numbered(df: DataFrame, blocks: int, name: str, *order: Column) -> DataFrame:
    """``df`` written in ``blocks`` ranges of ``order``, each row with the number of its block."""
    out = df.repartitionByRange(max(1, blocks), *order).withColumn("block", F.spark_partition_id())
    return materialise(out, name)


def top_products(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
                 scale: int = 1024, block: int = 8192, query_block: int = 8192, head: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that ``queries`` (of ``vec_id``) picks.

    ``head`` longest vectors and one matrix of dims x dims are broadcast; the driver gets one length per
    block.  A cell holds about ``block`` vectors and ``query_block`` queries.
    """
    spark = vectors.sparkSession
    found = materialise(whole_vectors(vectors, vec_id, vector, scale)
                        .withColumn("is_query", F.coalesce(queries, F.lit(False))), "products-whole")
    sums = found.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"),
                     F.sum(F.col("is_query").cast("long")).alias("queries")).first()
    if not sums["n"] or not sums["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, sums["dims"])
    turn, energy = rotation(found, dims)
    cuts = stages(energy)
    table = _numbered(found.withColumn("row", F.monotonically_increasing_id()), -(-sums["n"] // block), "products-vectors",
                      F.col("length").desc(), F.col("vec_id").asc_nulls_last(), F.col("row"))
    longest = table.orderBy(F.col("length").desc(), F.col("row")).limit(head).select("row", "vector").toArrow()
    shared = spark.sparkContext.broadcast(
        (longest.column("row").to_numpy(), matrix(longest.column("vector"), dims), turn, cuts))
    run, schema = _thresholds(shared, dims, k)
    asked = table.where("is_query").select("row", "vec_id", "vector", "length").mapInArrow(run, schema)
    asked = _numbered(asked, -(-sums["queries"] // query_block), "products-queries", F.col("cutoff"), F.col("row"))

    lengths = {r["block"]: r["top"] for r in table.groupBy("block").agg(F.max("length").alias("top")).collect()}
    cutoffs = {r["block"]: r["least"] for r in asked.groupBy("block").agg(F.min("cutoff").alias("least")).collect()}
    side_v, side_q = sorted(lengths), sorted(cutoffs)
    tops = np.array([lengths[b] for b in side_v])              # descending
    least = np.array([cutoffs[a] for a in side_q])             # ascending
    meets_q = [(b, int(np.searchsorted(least, top * (1 + SLACK) + SLACK, side="right"))) for b, top in zip(side_v, tops)]
    meets_v = [(a, int(np.searchsorted(-tops, -(low * (1 - np.sign(low) * SLACK) - SLACK), side="right")))
               for a, low in zip(side_q, least)]
    place_q, place_v = {a: i for i, a in enumerate(side_q)}, {b: i for i, b in enumerate(side_v)}
    q_side = spark.createDataFrame([(a, place_q[a], n) for a, n in meets_v], "block int, a int, upto int")
    v_side = spark.createDataFrame([(b, place_v[b], n) for b, n in meets_q], "block int, b int, upto int")
    prefix = F.explode(F.expr("sequence(0, upto - 1)"))
    left = asked.join(q_side.where("upto > 0"), "block").select("a", prefix.alias("b"), "row", "vec_id", "vector", "floor")
    right = table.join(v_side.where("upto > 0"), "block").select(prefix.alias("a"), "b", "row", "vec_id", "vector", "length")
    turned = spark.sparkContext.broadcast((turn, cuts))
    cells = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_cell(turned, dims, k), RESULT)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
