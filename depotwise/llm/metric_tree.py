"""Exact search for the highest inner products with a paged M-tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.llm.common import mix
from depotwise.session import materialise

SCALE = 1024
PAGE = 256  # entries of a node
TREE = 8192  # vectors of one tree; every task that searches holds one at a time
QUERY_BLOCK = 1024  # queries that meet a tree together
TASKS = 10_000  # that search, at most


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, and all components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


class Tree:
    """Pages of routing entries. An entry has a centre, a radius that covers all below it, the distance to
    its page's own centre, and bounds on the lengths of the vectors below.

    With d(q, p) known for a page's centre p, an entry at stored distance t from p and of radius r has
    no vector nearer to q than |d(q, p) - t| - r. As 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, that bounds the
    scores below it before its own distance is computed; so does Cauchy-Schwarz on the longest vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.points = vectors.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.levels: list[dict[str, np.ndarray]] = []
        self.build()

    def build(self) -> None:
        """Bulk load: vectors are dealt to the nearest of some seeds, in turn inside each part, until parts
        fill a page; then the pages' centres are dealt the same way, up to one root page."""
        centres, radius, longest = self.points, np.zeros(len(self.ids)), np.sqrt(self.squares)
        while True:
            groups = self.partition(np.arange(len(centres)), centres)
            order = np.concatenate(groups)
            sizes = np.array([len(g) for g in groups])
            first = np.r_[0, np.cumsum(sizes)]
            means = np.stack([centres[g].mean(axis=0) for g in groups])
            parent = np.linalg.norm(centres[order] - np.repeat(means, sizes, axis=0), axis=1)
            level = {"order": order, "first": first, "parent": parent, "radius": radius[order], "longest": longest[order], "centre": centres[order]}
            self.levels.append(level)
            radius = np.maximum.reduceat(parent + level["radius"], first[:-1])
            longest = np.maximum.reduceat(level["longest"], first[:-1])
            centres = means
            if len(groups) == 1:
                self.root = means[0]
                return

    def partition(self, members: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
        if len(members) <= PAGE:
            return [members]
        n = min(PAGE // 2, -(-len(members) // (PAGE // 2)))
        seeds = members[np.argsort(mix(members.astype(np.uint64)))[:n]]
        products = points[members] @ points[seeds].T
        nearest = np.argmax(2 * products - np.einsum("ij,ij->i", points[seeds], points[seeds])[None, :], axis=1)
        parts = [members[nearest == k] for k in range(n)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # equal points: cut by number
            parts = np.array_split(members, -(-len(members) // PAGE))
        return [g for p in parts for g in self.partition(p, points)]

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) other than `own`; `floor`: a k-th best score that is known already."""
        q = query.astype(np.float64)
        length = float(np.sqrt(q @ q))
        best: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        heap = [(-np.inf, top, 0, float(np.linalg.norm(q - self.root)))]
        while heap:
            bound, depth, page, distance = heapq.heappop(heap)
            limit = best[0][0] if len(best) == k else floor
            if limit is not None and -bound < limit:
                break
            level = self.levels[depth]
            a, z = level["first"][page], level["first"][page + 1]
            reach = np.maximum(np.abs(distance - level["parent"][a:z]) - level["radius"][a:z] - 1e-6 * (1 + distance), 0)
            longest = level["longest"][a:z]
            above = np.minimum((length**2 + longest**2 - reach**2) / 2, length * longest) + 1e-6 * (1 + length * longest)
            keep = np.flatnonzero(above >= limit) + a if limit is not None else np.arange(a, z)
            if not len(keep):
                continue
            if depth == 0:
                rows = level["order"][keep]
                scores, ids = self.vectors[rows] @ query, self.ids[rows]
                fit = ids != own if limit is None else (ids != own) & (scores >= limit)
                scores, ids = scores[fit], ids[fit]
                for i in np.lexsort((ids, -scores))[:k].tolist():
                    entry = (int(scores[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                continue
            apart = np.linalg.norm(level["centre"][keep] - q, axis=1)
            reach = np.maximum(apart - level["radius"][keep] - 1e-6 * (1 + apart), 0)
            longest = level["longest"][keep]
            above = np.minimum((length**2 + longest**2 - reach**2) / 2, length * longest) + 1e-6 * (1 + length * longest)
            for child, d, bound in zip(level["order"][keep].tolist(), apart.tolist(), above.tolist(), strict=True):
                if limit is None or bound >= limit:
                    heapq.heappush(heap, (-bound, depth - 1, child, d))
        return best


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal dimension as rows of integers."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def top_inner_products(df: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `df` (vec_id, embedding) with the highest inner product
    for each row whose vec_id is divisible by `every`, on integers floor(1024 x); ties go to the smaller id.

    Exact. Vectors are dealt over trees of about TREE by a hash, so trees are of like size and any group
    of copies is spread; each tree meets the queries in blocks, and the lists of at most k per query and
    tree are merged by a sum that Spark combines before the exchange. Trees times query blocks rows of
    work; a tree is built once for all blocks of its task.

    Vectors that are null or empty or hold a null or a component that is not finite take no part, nor do
    rows without an id, and vectors of different dimension never meet. Rows that repeat an id are
    candidates each; for a query with that id they are its own. No rows: no rows. Other columns are ignored."""
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("raw")).where(F.col("id").isNotNull() & usable(F.col("raw")))
    rows = materialise(rows.select("id", quantised(F.col("raw")).alias("v"), F.size("raw").alias("dim")), "vectors")
    n = rows.count()
    trees = max(1, -(-n // TREE))
    queries = rows.where(F.col("id") % every == 0).select("id", "v", "dim").dropDuplicates(["id", "v"])
    n_blocks = max(1, -(-n // every // QUERY_BLOCK))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list("id").alias("q_ids"), F.flatten(F.collect_list("v")).alias("q_v"))
    pages = rows.withColumn("tree", F.pmod(F.xxhash64("id", "v"), F.lit(trees)))
    pages = pages.groupBy("dim", "tree").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                dim, number = batch.column("dim")[i].as_py(), batch.column("tree")[i].as_py()
                if held[0] != (dim, number):
                    ids = batch.column("ids")[i].values.to_numpy()
                    held = ((dim, number), Tree(ids, batch.column("flat")[i].values.to_numpy().reshape(-1, dim)))
                q_ids = batch.column("q_ids")[i].values.to_numpy()
                q_rows = batch.column("q_v")[i].values.to_numpy().reshape(-1, dim)
                out = [(q, -v, s) for q, row in zip(q_ids.tolist(), q_rows, strict=True) for s, v in held[1].search(row, q, k, None)]
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    pages = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = pages.join(blocks, ["dim", "block"]).select("dim", "tree", "block", "ids", "flat", "q_ids", "q_v")
    # a few large rows: dealt to as many tasks, which Spark would take for small partitions to merge
    met = met.repartition(min(TASKS, trees * n_blocks), "dim", "tree", "block").sortWithinPartitions("dim", "tree")
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
