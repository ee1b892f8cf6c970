"""Operator 5: approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lograft.llm.common import unit_hash
from lograft.session import stored

# Bounds of what is fitted on a sample, and of the blocks that are compared in one task.
SAMPLE_ROWS = 20_000
CENTROIDS = 32
CALIBRATION_QUERIES = 128
ENTRIES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024
HELD_QUERIES = 20_000


@dataclass
class MultiIndex:
    """Centroids of both vector halves; a cell is a pair of them, ``first * len(second) + second``."""

    dim: int
    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.dim // 2
        return _squared(vectors[:, :half], self.first), _squared(vectors[:, half:], self.second)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.distances(vectors)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def traverse(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Cells in the order of the summed distance of their two centroids, by a heap over sorted halves."""
        rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        heap, seen = [(first[rows[0]] + second[columns[0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(rows[i] * len(columns) + columns[j])
            for ni, nj in ((i + 1, j), (i, j + 1)):
                if ni < len(rows) and nj < len(columns) and (ni, nj) not in seen:
                    seen.add((ni, nj))
                    heapq.heappush(heap, (first[rows[ni]] + second[columns[nj]], ni, nj))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _centroids(points: np.ndarray, most: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows of the (hash-ordered) sample."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= most:
        return distinct
    centers = points[np.linspace(0, len(points) - 1, most).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squared(points, centers).argmin(1)
        n = np.bincount(nearest, minlength=most)
        for k in np.flatnonzero(n):
            centers[k] = points[nearest == k].mean(0)
    return centers


def valid(vector: Column) -> Column:
    """Not NULL, not zero, and no component NULL or not finite."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(wide, lambda v: v != 0), F.lit(False))


def fit_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> MultiIndex | None:
    """Centroids from at most ``sample_rows`` vectors, those with the smallest hash of id. None without vectors."""
    keyed = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    sample = keyed.orderBy(unit_hash(F.lit("index"), F.col("vec_id")), "vec_id").limit(sample_rows).toPandas()
    if not len(sample):
        return None
    sizes = sample["vector"].map(len)
    dim = int(sizes.mode().min())
    points = np.stack(sample["vector"][sizes == dim].to_list())
    half = dim // 2
    return MultiIndex(dim, _centroids(points[:, :half], centroids), _centroids(points[:, half:], centroids))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def index_rows(vectors: DataFrame, index: MultiIndex) -> DataFrame:
    """Every vector of the index's dimension with its cell; the vector as the bytes of its doubles."""
    rows = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.size("vector") == index.dim)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim)
            data = [row.tobytes() for row in np.ascontiguousarray(x, np.float64)]
            cells = pa.array(index.assign(x).astype(np.int32)) if len(x) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), cells, pa.array(data, pa.binary())], names=["vec_id", "cell", "vector"]
            )

    return rows.mapInArrow(run, "vec_id long, cell int, vector binary")


def _nearest(
    queries: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, entry_ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k nearest entries but itself: (row, entry rows, exact distances), ties to smaller ids.

    The product form only preselects, with all that rounding could bring in; the
    distances that count are taken from the differences.
    """
    rough = _squared(queries, entries)
    rough[query_ids[:, None] == entry_ids[None]] = np.inf
    slack = 1e-9 * ((queries * queries).sum(1).max(initial=0) + (entries * entries).sum(1).max(initial=0))
    for i in range(len(queries)):
        near = rough[i]
        if len(near) > k:
            rows = np.flatnonzero((near <= np.partition(near, k - 1)[k - 1] + slack) & np.isfinite(near))
        else:
            rows = np.flatnonzero(np.isfinite(near))
        exact = np.sqrt(((entries[rows] - queries[i]) ** 2).sum(1))
        order = np.lexsort((entry_ids[rows], exact))[:k]
        yield i, rows[order], exact[order]


FOUND = "query_id long, vec_id long, cell int, score double"
FOUND_ARROW = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("cell", pa.int32()), ("score", pa.float64())]
)


class _Best:
    """The k nearest of each query so far, over all that a task compares."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query: int, ids: Iterable[int], cells: Iterable[int], scores: Iterable[float]) -> None:
        more = list(zip(map(float, scores), map(int, ids), map(int, cells), strict=True))
        self.found[query] = sorted(self.found.get(query, []) + more)[: self.k]

    def flush(self) -> pa.RecordBatch:
        rows = [(q, v, c, s) for q, best in self.found.items() for s, v, c in best]
        self.found = {}
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        arrays = [pa.array(x, f.type) for x, f in zip(columns, FOUND_ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=FOUND_ARROW)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """Nearest first by query, over all tasks' rows; cut before the shuffle too."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def brute_force(entries: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The exact answer for a bounded set of queries, which goes to every task."""
    dim = queries.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            cells = batch.column("cell").to_numpy()
            x = _matrix(batch.column("vector"), dim)
            for i, rows, scores in _nearest(queries, query_ids, x, ids, k):
                best.add(int(query_ids[i]), ids[rows], cells[rows], scores)
        yield best.flush()

    return top_k(entries.mapInArrow(run, FOUND), k)


def calibrated_budget(
    entries: DataFrame, queries: DataFrame, index: MultiIndex, counts: np.ndarray, k: int, recall: float
) -> int:
    """How many entries a query's cells must hold so that the sampled queries reach the recall.

    At most 128 queries are answered by brute force over all entries; the answer is
    the ``recall`` quantile of the entries that lie in the cells up to each true neighbour's.
    """
    sample = queries.orderBy(unit_hash(F.lit("calibrate"), F.col("vec_id"))).limit(CALIBRATION_QUERIES).toPandas()
    if not len(sample):
        return 0
    ids = sample["vec_id"].to_numpy(np.int64)
    x = np.frombuffer(b"".join(sample["vector"]), np.float64).reshape(-1, index.dim)
    position = {}
    for query, first, second in zip(ids.tolist(), *index.distances(x), strict=True):
        order = np.fromiter(index.traverse(first, second), np.int64)
        position[query] = np.empty(index.cells, np.int64)
        position[query][order] = np.cumsum(counts[order])
    needed = [position[r["query_id"]][r["cell"]] for r in brute_force(entries, ids, x, k).collect()]
    return int(np.quantile(needed, recall, method="higher")) if needed else 0


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, index: MultiIndex | None = None
) -> DataFrame:
    """The k nearest of each query among ``vectors``: query_id, rank, vec_id, score.

    Both take ``vec_id`` and ``vector`` (an array of numbers); other columns are
    left out. Nearness is the Euclidean distance in double precision, ties go to
    the smaller id, and rows with the query's own id are no candidates. Vectors that are NULL, zero, of another
    dimension than most, or hold NULLs or non-finite numbers take no part; nor do NULL ids.
    Repeated rows are candidates each; of queries with one id the smallest vector counts.

    The index is fitted on a bounded sample, but holds every row. A query visits
    cells by the summed distance of their centroids until they hold enough
    entries (:func:`calibrated_budget`), and all entries there are
    compared exactly. A cell is cut into blocks of entries and of queries, so a
    cell with a third of all rows is many blocks; a task keeps k rows a query.
    """
    taking_part = vectors.where(valid(F.col("vector")) & F.col("vec_id").isNotNull())
    index = index or fit_index(taking_part)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = stored(index_rows(taking_part, index), "entries")
    asked = queries.where(valid(F.col("vector")) & F.col("vec_id").isNotNull())
    asked = asked.groupBy("vec_id").agg(F.min(F.col("vector").cast("array<double>")).alias("vector"))
    asked = stored(index_rows(asked, index), "queries")
    counts = np.zeros(index.cells, np.int64)
    for row in entries.groupBy("cell").count().collect():  # one row a cell at most
        counts[row["cell"]] = row["count"]
    budget = max(calibrated_budget(entries, asked, index, counts, k, recall), 20 * k)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visited = []
            for first, second in zip(*index.distances(_matrix(batch.column("vector"), index.dim)), strict=True):
                held, cells = 0, []
                for cell in index.traverse(first, second):
                    if counts[cell]:
                        cells.append(cell)
                        held += counts[cell]
                    if held >= budget:
                        break
                visited.append(cells)
            columns = [batch.column("vec_id"), batch.column("vector"), pa.array(visited, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "cells"])

    visits = stored(asked.mapInArrow(visit, "vec_id long, vector binary, cells array<int>"), "visits")
    probes = visits.select("vec_id", "vector", F.explode("cells").alias("cell"))
    asking = np.zeros(index.cells, np.int64)
    for row in probes.groupBy("cell").count().collect():
        asking[row["cell"]] = row["count"]

    def blocks(sizes: np.ndarray, each: int) -> Column:
        per_cell = F.array(*(F.lit(int(n)) for n in np.maximum(-(-sizes // each), 1)))
        return F.element_at(per_cell, F.col("cell") + 1)

    of_entries, of_queries = blocks(counts, ENTRIES_PER_BLOCK), blocks(asking, QUERIES_PER_BLOCK)
    own = F.pmod(F.xxhash64("vec_id"), F.col("own_blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))

    def dealt(rows: DataFrame, own_blocks: Column, other_blocks: Column, query: bool) -> DataFrame:
        rows = rows.withColumns({"own_blocks": own_blocks, "other_blocks": other_blocks})
        rows = rows.select("vec_id", "vector", "cell", own.alias("own"), others.alias("other"))
        names = ("other", "own") if query else ("own", "other")
        return rows.select(
            "vec_id",
            "vector",
            "cell",
            F.col(names[0]).alias("entry_block"),
            F.col(names[1]).alias("query_block"),
            F.lit(query).alias("is_query"),
        )

    wanted = entries.where(F.element_at(F.array(*(F.lit(bool(n)) for n in asking)), F.col("cell") + 1))
    both = dealt(wanted, of_entries, of_queries, False).unionByName(dealt(probes, of_queries, of_entries, True))
    keys = ("cell", "entry_block", "query_block")
    both = both.repartition(*keys).sortWithinPartitions(*keys, "is_query")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, entry_rows, x, ids = _Best(k), None, [], None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "is_query")]
            change = np.zeros(batch.num_rows, bool)
            for column in columns:
                change[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                part, at = batch.slice(lo, hi - lo), tuple(int(c[lo]) for c in columns[:3])
                if at != key:
                    key, entry_rows, x = at, [], None
                if not columns[3][lo]:
                    entry_rows.append(part)
                    continue
                if not entry_rows:
                    continue
                if x is None:
                    x = np.concatenate([_matrix(p.column("vector"), index.dim) for p in entry_rows])
                    ids = np.concatenate([p.column("vec_id").to_numpy() for p in entry_rows])
                asked_ids = part.column("vec_id").to_numpy()
                for i, rows, scores in _nearest(_matrix(part.column("vector"), index.dim), asked_ids, x, ids, k):
                    best.add(int(asked_ids[i]), ids[rows], [at[0]] * len(rows), scores)
                if len(best.found) > HELD_QUERIES:
                    yield best.flush()
        yield best.flush()

    found = top_k(both.mapInArrow(compare, FOUND), k)
    return found.select("query_id", "rank", "vec_id", "score")
