"""Operator 7: approximate nearest neighbours by a forest of random-projection trees.

Trees of random hyperplanes are fitted on a bounded sample; every distinct vector is then put into a leaf of every
tree. A query walks all trees through one shared priority queue, nearest cells first, until enough candidates are
in the leaves it has opened. Leaves and the queries that open them meet in one task each, where candidates are
ranked by their exact inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageflow.llm.common import cut, stored


class Forest:
    """Random-projection trees as arrays: normals, offsets and children (negative: leaf -1 - child)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normals, self.offsets, self.children, self.roots, self.leaves = [], [], [], [], []
        for _ in range(trees):
            self.leaves.append(0)
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
        self.normals = np.array(self.normals, dtype=np.float64).reshape(len(self.normals), sample.shape[1] if sample.ndim == 2 else 0)
        self.offsets = np.array(self.offsets)

    def _leaf(self) -> int:
        self.leaves[-1] += 1
        return -self.leaves[-1]

    def _grow(self, sample, rows, leaf, rng) -> int:
        if len(rows) <= leaf:
            return self._leaf()
        a, b = sample[rng.choice(rows, 2, replace=False)]
        normal = a - b
        norm = np.linalg.norm(normal)
        if norm == 0:
            return self._leaf()
        along = sample[rows] @ (normal / norm)
        offset = float(np.median(along))
        left, right = rows[along <= offset], rows[along > offset]
        if not len(left) or not len(right):
            return self._leaf()
        node = len(self.children)
        self.normals.append(normal / norm)
        self.offsets.append(offset)
        self.children.append(None)
        self.children[node] = (self._grow(sample, left, leaf, rng), self._grow(sample, right, leaf, rng))
        return node

    def place(self, tree: int, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in a tree."""
        out = np.zeros(len(vectors), dtype=np.int32)
        todo = [(self.roots[tree], np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                right = vectors[rows] @ self.normals[node] > self.offsets[node]
                todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def search(self, query: np.ndarray, counts: dict[tuple[int, int], int], enough: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of the queue that all trees share, until they hold ``enough`` rows."""
        margins = self.normals @ query - self.offsets if len(self.normals) else np.zeros(0)
        queue = [(-np.inf, t, root) for t, root in enumerate(self.roots)]
        heapq.heapify(queue)
        found, total = [], 0
        while queue and total < enough:
            priority, tree, node = heapq.heappop(queue)
            if node < 0:
                if n := counts.get((tree, -1 - node), 0):
                    found.append((tree, -1 - node))
                    total += n
                continue
            m = float(margins[node])
            left, right = self.children[node]
            heapq.heappush(queue, (max(priority, m), tree, left))
            heapq.heappush(queue, (max(priority, -m), tree, right))
        return found


def usable(v: Column) -> Column:
    """A vector takes part: not null, all components finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def inner_products(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with vectors given by component, summed from the first component to the last, whatever the leaf."""
    total = q[0] * columns[0]
    for x, column in zip(q[1:], columns[1:], strict=True):
        total += x * column
    return total


def effort(distinct: DataFrame, forest: Forest, counts: dict, probes: np.ndarray, k: int, recall: float, kind: str = "float") -> float:
    """Rows to look through so that the probes find the share ``recall`` of their k nearest distinct vectors.

    The probes' nearest come from a comparison with all rows, of which each batch hands on its own k + 1 best.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products = _matrix(batch.column(0)) @ probes.T if batch.num_rows else np.zeros((0, len(probes)))
            n = min(k + 1, len(products))
            rows = np.argpartition(-products, n - 1, axis=0)[:n].T if n else np.zeros((len(probes), 0), int)
            for i, r in enumerate(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), batch.column(0).take(pa.array(r)), pa.array(products[r, i])], ["probe", "v", "score"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"))
    top = distinct.mapInArrow(best, f"probe int, v array<{kind}>, score double").withColumn("r", F.row_number().over(order)).where((F.col("r") > 1) & (F.col("r") <= k + 1))
    near = top.toArrow()  # k rows a probe
    vectors, probe = _matrix(near.column("v").combine_chunks()), near.column("probe").to_numpy()
    cells = [forest.place(t, vectors) for t in range(len(forest.roots))]
    needed = []
    for i, q in enumerate(probes):
        seen, total = {}, 0
        for cell in forest.search(q, counts, float("inf")):
            total += counts[cell]
            seen[cell] = total
        needed += [min(seen[t, int(cells[t][j])] for t in range(len(cells))) for j in np.flatnonzero(probe == i)]
    return float(np.quantile(needed, recall)) if needed else float("inf")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, trees: int = 16, leaves: int = 64, leaf_rows: int = 4096, recall: float = 0.95, sample_rows: int = 20_000, least_rows: int = 8_000, part_rows: int = 4096, seed: int = 7
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id. A row is no candidate of its own
    vec_id. Vectors that are null, zero, or hold null or non-finite components, and rows without a vec_id, take
    no part; neither do vectors whose length differs from the most usual one. Rows that share a vec_id count once, by
    the smallest vector. Equal scores go to the smaller vec_id. Equal vectors are indexed as one, with their
    k + 1 smallest ids, which is all that a result can hold. The trees see ``sample_rows`` distinct vectors at most (those of least
    hash), all rows are indexed. A tree has about ``leaves`` leaves, or more, of ``leaf_rows`` rows. How many rows a query's
    leaves must hold, over all trees, is set by ``effort`` from the data, and ``least_rows`` at least: queries of a small table open
    all leaves. Components are compared as they are given, float or double. A leaf with many rows, or that many queries
    open, is dealt to several tasks. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    fine = raw.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    usual = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    size = usual[0]["d"] if usual else 0
    rows = stored(fine.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = stored(
        rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-distinct"
    )
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("v"), "v").select("v").limit(sample_rows).toArrow().column("v").combine_chunks()
    points = _matrix(sample) if len(sample) else np.zeros((0, size))
    shared = spark.sparkContext.broadcast(Forest(points, trees, max(4, len(points) // max(leaves, total // leaf_rows)), seed))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            points = _matrix(batch.column(0))
            for tree in range(len(forest.roots)):
                leaves = forest.place(tree, points) if len(points) else np.zeros(0, np.int32)
                same = pa.array(np.full(len(leaves), tree, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([same, pa.array(leaves), *batch.columns], ["tree", "leaf", "v", "ids"])

    placed = stored(distinct.select("v", "ids").mapInArrow(index, f"tree int, leaf int, v array<{kind}>, ids array<long>"), "ann-index")
    counts = {(r["tree"], r["leaf"]): r["count"] for r in placed.groupBy("tree", "leaf").count().collect()}  # as many rows as the forest has leaves
    known = spark.sparkContext.broadcast(counts)
    enough = max(least_rows, effort(distinct.select("v"), shared.value, counts, points[:100], k, recall, kind))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes = shared.value, known.value
        for batch in batches:
            points = _matrix(batch.column(1))
            at, tree, leaf, part = [], [], [], []
            for i in range(len(points)):
                for t, l in forest.search(points[i], sizes, enough):
                    for p in range(-(-sizes[t, l] // part_rows)):
                        at.append(i)
                        tree.append(t)
                        leaf.append(l)
                        part.append(p)
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), batch.column(0).take(where), batch.column(1).take(where)],
                ["tree", "leaf", "part", "query_id", "q"],
            )

    asked = rows.where(queries).select("vec_id", "v").repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id").mapInArrow(walk, f"tree int, leaf int, part int, query_id long, q array<{kind}>")
    asked = stored(asked, "ann-asked")
    several = [(t, l, -(-n // part_rows)) for (t, l), n in counts.items() if n > part_rows]
    if several:
        table = pa.table({"tree": pa.array([x[0] for x in several], pa.int32()), "leaf": pa.array([x[1] for x in several], pa.int32()), "parts": pa.array([x[2] for x in several], pa.int32())})
        parts = placed.join(F.broadcast(spark.createDataFrame(table)), ["tree", "leaf"], "left")
        placed = parts.withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        placed = placed.withColumn("part", F.lit(0))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        query, vec, score = [], [], []
        if left.num_rows and right.num_rows:
            q, v = _matrix(left.column("q").combine_chunks()), _matrix(right.column("v").combine_chunks())
            own, ids, columns = left.column("query_id").to_numpy(), right.column("ids").to_pylist(), np.ascontiguousarray(v.T)
            for i in range(len(q)):
                products = inner_products(q[i], columns)
                if len(products) > k + 1:
                    best = np.flatnonzero(products >= np.partition(products, -k - 1)[-k - 1])
                else:
                    best = np.arange(len(products))
                flat = sorted((-products[j], x) for j in best for x in ids[j] if x != own[i])[:k]
                query += [own[i]] * len(flat)
                vec += [x for _, x in flat]
                score += [-s for s, _ in flat]
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ["tree", "leaf", "part"]
    # Where very many queries open a leaf, they are dealt to chunks, each of which meets the leaf's rows.
    chunks = asked.groupBy(*keys).agg(F.ceil(F.count("*") / part_rows).alias("chunks")).where(F.col("chunks") > 1)
    chunks = stored(chunks, "ann-chunks")
    asked = asked.join(chunks, keys, "left").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.coalesce("chunks", F.lit(1)))).drop("chunks")
    placed = placed.join(chunks, keys, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    keys = [*keys, "chunk"]
    found = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cut(one).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
