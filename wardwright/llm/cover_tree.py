"""Exact inner-product top k: a dual-tree search over cover trees that index queries and data together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table
from wardwright.session import settle

STEP = 1.3  # radii shrink by this factor from one level to the next
LEAF = 32  # points that are compared without further splitting
TREE = 2048  # points of one tree, about
BUNDLE = 8  # trees that a task holds while queries pass by
TOP_SAMPLE = 2048  # vectors that the upper levels are made from
TOP_CELLS = 256  # nodes of the upper levels at most
_EXACT = float(1 << 53)  # below this, sums of products of whole numbers are exact in double precision


class CoverTree:
    """A cover tree over the rows of a matrix of whole numbers, made level by level from the top.

    The children of a node stand further apart than the node's scale and between them cover its points within that
    scale; the node's own point is its first child. Few points left over by a level stay in leaves under their parent's
    point. Points are put in tree order, so every node is a range (`order`: the row a point came from); `radius` is the exact distance
    from a node's point to its farthest. A node's children are numbered one after the other.
    """

    def __init__(self, points: np.ndarray, nodes: np.ndarray | None = None, radius: np.ndarray | None = None):
        self.points, self.order = points.astype(np.float64), np.arange(len(points))
        if nodes is None:
            nodes, radius = self._grow()
        self.nodes = nodes
        self.center, self.start, self.end, self.child, self.kids = nodes.T.tolist()
        self.radius = radius.tolist()
        self.norms = np.sqrt((self.points**2).sum(1))

    def _grow(self) -> tuple[np.ndarray, np.ndarray]:
        squares = (self.points**2).sum(1)
        gaps = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * self.points @ self.points.T, 0))
        nodes: list[list[int]] = []  # point, start, end, first child, number of children
        radii: list[float] = []
        order: list[int] = []

        def opened(center: int, inside: np.ndarray) -> int:
            nodes.append([center, 0, len(inside), 0, 0])
            radii.append(float(gaps[center, inside].max()))
            return len(nodes) - 1

        # An explicit stack: levels may be many where points lie far apart.
        stack = [(opened(0, self.order), self.order)] if len(self.points) else []
        while stack:
            node, inside = stack.pop()
            nodes[node][1:3] = len(order), len(order) + len(inside)
            center, radius = nodes[node][0], radii[node]
            if len(inside) <= LEAF or radius == 0:
                order += inside.tolist()
                continue
            parts, rest, at = [], inside, center
            while len(rest):
                near = gaps[at, rest] <= radius / STEP
                near |= rest == at
                parts.append((at, rest[near]))
                rest = rest[~near]
                at = rest[0] if len(rest) else at
            groups = [parts[0], *(p for p in parts[1:] if len(p[1]) > LEAF // 4)]
            small = [p[1] for p in parts[1:] if len(p[1]) <= LEAF // 4]
            loose = np.concatenate(small) if small else np.zeros(0, np.int64)
            groups += [(center, loose[k : k + LEAF]) for k in range(0, len(loose), LEAF)]
            nodes[node][3:] = len(nodes), len(groups)
            stack += reversed([(opened(*group), group[1]) for group in groups])
        self.order = np.array(order, np.int64)
        self.points = self.points[self.order]
        place = np.empty(len(order), np.int64)
        place[self.order] = np.arange(len(order))
        made = np.array(nodes, np.int64).reshape(-1, 5)
        made[:, 0] = place[made[:, 0]]
        return made, np.array(radii)

    def children(self, node: int) -> range:
        return range(self.child[node], self.child[node] + self.kids[node])

    def cells(self, most: int) -> list[int]:
        """The nodes of the deepest level that has at most `most`: rows of `points` that stand for a cell each."""
        level = [0] if self.center else []
        while True:
            below = [k for n in level for k in (self.children(n) or [n])]
            if below == level or len(below) > most:
                return sorted({self.center[n] for n in level})
            level = below


class Best:
    """The best candidates of each query so far, and the score a further one must reach."""

    def __init__(self, k: int, bounds: np.ndarray):
        self.k, self.bounds = k, bounds.astype(np.float64)
        self.found: list[list[tuple[int, int, int, int]]] = [[] for _ in bounds]  # score, -id, tree, place

    def offer(self, query: int, rows: list[tuple[int, int, int, int]]) -> None:
        best = sorted(self.found[query] + rows, reverse=True)[: self.k]
        self.found[query] = best
        if len(best) == self.k:
            self.bounds[query] = max(self.bounds[query], best[-1][0])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where sums stay below 2^53, else in 64-bit integers."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


def _bound(product, norm_q, radius_q, norm_d, radius_d):
    """What products of points under two nodes cannot exceed; a little more than rounding could take away."""
    return product + norm_q * radius_d + norm_d * radius_q + radius_q * radius_d + 1e-6 * (norm_q + radius_q) * (norm_d + radius_d) + 1


def search(queries: CoverTree, data: CoverTree, ids: np.ndarray, number: int, best: Best) -> int:
    """Go down both trees at once and offer every candidate that may be among the best of a query; the number of node pairs
    looked at. `ids`: the smallest id of each data point, in tree order.

    No product of points below two nodes exceeds that of their centers plus what the covering radii allow. A pair of
    nodes is left out if that is less than the worst k-th score of the queries below the one.
    """
    if not len(queries.points) or not len(data.points):
        return 0
    stack, seen = [(0, 0)], 0
    while stack:
        q, d = stack.pop()
        seen += 1
        qs, qe, ds, de = queries.start[q], queries.end[q], data.start[d], data.end[d]
        cq, cd = queries.center[q], data.center[d]
        rq, rd, nd = queries.radius[q], data.radius[d], data.norms[cd]
        if _bound(queries.points[cq] @ data.points[cd], queries.norms[cq], rq, nd, rd) < best.bounds[qs:qe].min():
            continue
        q_kids, d_kids = queries.children(q), data.children(d)
        if q_kids and (rq > rd or not d_kids):
            stack += [(k, d) for k in q_kids]
            continue
        if not q_kids:  # each query of a leaf by itself, with no radius of its own
            each = _bound(queries.points[qs:qe] @ data.points[cd], queries.norms[qs:qe], 0.0, nd, rd) >= best.bounds[qs:qe]
            if not each.any():
                continue
        if d_kids:
            # The nearest child last, so that it is searched first and raises the bounds.
            nearness = data.points[[data.center[k] for k in d_kids]] @ queries.points[cq]
            stack += [(q, d_kids[k]) for k in np.argsort(nearness).tolist()]
            continue
        rows = qs + np.flatnonzero(each)
        scores = product(queries.points[rows], data.points[ds:de])
        hit = scores >= best.bounds[rows, None]
        for k in np.flatnonzero(hit.any(1)).tolist():
            at = np.flatnonzero(hit[k])
            best.offer(int(rows[k]), [(int(scores[k, j]), -int(ids[ds + j]), number, ds + int(j)) for j in at])
    return seen


# --- packed trees ------------------------------------------------------------

def _narrow(values: np.ndarray) -> tuple[str, bytes]:
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return kind, values.astype(kind).tobytes()


PACKED = "side string, cell int, part long, n int, kind string, points binary, nodes binary, radius binary, ids array<array<long>>, vids array<long>"


def _packed(rows: list[tuple], side: str, cell: int, part: int) -> dict:
    """A tree and what belongs to its points, in tree order."""
    tree = CoverTree(np.array([r[0] for r in rows], np.int64))
    kind, points = _narrow(tree.points.astype(np.int64))
    return {"side": side, "cell": cell, "part": part, "n": len(rows), "kind": kind, "points": points, "nodes": tree.nodes.astype("<i4").tobytes(),
            "radius": np.array(tree.radius).tobytes(), "ids": [rows[k][1] for k in tree.order], "vids": [rows[k][2] for k in tree.order]}


def _unpacked(row: dict) -> CoverTree:
    return CoverTree(np.frombuffer(row["points"], row["kind"]).reshape(row["n"], -1), np.frombuffer(row["nodes"], "<i4").reshape(-1, 5), np.frombuffer(row["radius"]))


def _pack(schema: pa.Schema):
    """Rows sorted by side, cell and part -> one packed row per part. A part has some TREE rows, as parts are dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            sides, cells, parts, points, ids, vids = (batch.column(c).to_pylist() for c in ("side", "cell", "part", "q", "ids", "vid"))
            for row in zip(zip(sides, cells, parts), points, ids, vids):
                if row[0] != key and rows:
                    yield pa.RecordBatch.from_pylist([_packed(rows, *key)], schema=schema)
                    rows = []
                key = row[0]
                rows.append(row[1:])
        if rows:
            yield pa.RecordBatch.from_pylist([_packed(rows, *key)], schema=schema)

    return run


FOUND = "query long, score long, ids array<long>, same boolean"


def _searched(k: int, schema: pa.Schema):
    """Bundles of packed data trees, each followed by the packed queries that come to it -> the best candidates of each query.

    `bounds` of a query row are scores that its queries have k candidates for already; such a row has met part 0 of its own cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, data = None, []
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(len(batch))):
                if row["bundle"] != bundle:
                    bundle, data = row["bundle"], []
                tree = _unpacked(row)
                if row["side"] == "data":
                    data.append((tree, row["ids"], np.array([i[0] for i in row["ids"]]), (row["cell"], row["part"])))
                    continue
                met = (row["cell"], 0) if row["bounds"] else None
                best = Best(k, np.array([-np.inf if b is None else b for b in row["bounds"] or [None] * row["n"]]))
                for number, (other, _, first, where) in enumerate(data):
                    if where != met:
                        search(tree, other, first, number, best)
                out = []
                for place, query in enumerate(row["vids"]):
                    own = tree.points[place : place + 1]
                    square = int(product(own, own)[0, 0])
                    for score, _, number, at in best.found[place]:
                        other = data[number][0].points[at : at + 1]
                        # Two vectors are equal if their product is the square of both.
                        out.append({"query": query, "score": score, "ids": data[number][1][at], "same": score == square == int(product(other, other)[0, 0])})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _first(rows: DataFrame, k: int, by: list, key: str) -> DataFrame:
    """The first k rows per key. Tasks keep k per key before anything is shuffled."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("_rank") <= k).drop("_rank")


def quantised(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; NULL for a vector that is null, holds a null or non-finite component, or whose
    squared length reaches 2^62, so that scores of it might not fit 64 bits."""
    v = F.col(embedding)
    large = F.aggregate(v, F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0))) >= float(1 << 62)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e15)) | large
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products among all rows but itself, ties to
    smaller ids; all of them if there are fewer.

    Equal vectors are one point with their k + 1 smallest ids, which are all that can be reported, so a vector with a third of all rows is a
    point. The upper levels of the cover tree are made from at most 2,048 points, spread by hash; every point goes to the
    nearest cell, queries and data alike, and cells are cut by hash into parts of some 2,048 points with a tree each. A part of
    queries first meets one part of its own cell. With the scores found it then asks for the other cells that can hold
    better ones by their covering radii, and goes down all their trees. Queries that a bundle of trees cannot help any more emit nothing.

    Vectors that are null, hold null or non-finite components, or whose squared length reaches 2^62 after scaling, and rows
    without an id, take no part. Rows that repeat id and vector count once; rows that repeat an id with
    another vector are rows of their own, and candidates for each other. Vectors of unequal length are filled up with zeros. An
    empty table gives no rows. Other columns are left out.
    """
    spark = prepare(vectors.sparkSession)
    rows = (vectors.select(F.col(key).cast("long").alias("id"), is_query.alias("asks"), quantised(embedding, scale).alias("q"))
            .where("id IS NOT NULL AND q IS NOT NULL"))
    size = max(1, rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0])
    rows = settle(rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("q")))).distinct(), "vectors")
    ids = _first(rows.select("q", "id"), k + 1, [F.col("id")], "q").groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asking = rows.where("asks").select("q").distinct().withColumn("_asks", F.lit(True))
    points = settle(ids.join(asking, "q", "left").select(
        F.monotonically_increasing_id().alias("vid"), "q", "ids", F.coalesce("_asks", F.lit(False)).alias("asks")), "points")
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().astype(np.float64).reshape(len(column), size)

    upper = CoverTree(matrix(points.orderBy(F.xxhash64("q"), "vid").limit(TOP_SAMPLE).select("q").toArrow().column("q").combine_chunks()))
    cells = upper.points[upper.cells(min(TOP_CELLS, max(1, n // TREE)))]
    sent = spark.sparkContext.broadcast(cells)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch.column("q"))
            gaps = np.maximum((q**2).sum(1)[:, None] + (centers**2).sum(1) - 2 * q @ centers.T, 0)
            cell = gaps.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(gaps.min(1)))],
                                             names=[*batch.schema.names, "cell", "gap"])

    placed = settle(points.mapInArrow(routed, "vid long, q array<long>, ids array<long>, asks boolean, cell int, gap double"), "placed-points")
    # A row per cell, so at most TOP_CELLS.
    per_cell = settle(placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_asks"), F.max("gap").alias("radius")), "cells")
    radii = np.full(len(cells), -1.0)
    for cell, radius in per_cell.select("cell", "radius").collect():
        radii[cell] = radius
    sides = F.explode(F.when(F.col("asks"), F.array(F.lit("data"), F.lit("query"))).otherwise(F.array(F.lit("data")))).alias("side")
    parts = F.ceil(F.when(F.col("side") == "data", F.col("n")).otherwise(F.col("n_asks")) / TREE)
    dealt = (placed.join(per_cell, "cell").select("vid", "q", "ids", "cell", "n", "n_asks", sides)
             .select("side", "cell", F.pmod(F.xxhash64("q"), parts).alias("part"), "q", "ids", "vid"))
    trees = settle(dealt.repartition("side", "cell", "part").sortWithinPartitions("side", "cell", "part")
                   .mapInArrow(_pack(spark.createDataFrame([], PACKED).toArrow().schema), PACKED), "trees")

    columns = ["side", "cell", "part", "n", "kind", "points", "nodes", "radius", "ids", "vids"]
    found_type = spark.createDataFrame([], FOUND).toArrow().schema

    def searched(data: DataFrame, queries: DataFrame, label: str) -> DataFrame:
        met = data.withColumn("bounds", F.lit(None).cast("array<double>")).unionByName(queries).repartition("bundle")
        return settle(met.sortWithinPartitions("bundle", "side", "cell", "part").mapInArrow(_searched(k + 1, found_type), FOUND), label)

    data, queries = trees.where("side = 'data'").select(*columns), trees.where("side = 'query'").select(*columns)
    home = F.col("cell").cast("string").alias("bundle")
    seeds = searched(data.where("part = 0").select(*columns, home), queries.select(*columns, home, F.lit(None).cast("array<double>").alias("bounds")), "seeds")
    worst = settle(seeds.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("bound")), "worst-scores")
    members = queries.select("cell", "part", F.posexplode("vids").alias("place", "query"))
    bounds = (members.join(worst, "query", "left").groupBy("cell", "part")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bound"))), lambda x: x["bound"]).alias("bounds")))
    bounded = settle(queries.join(bounds, ["cell", "part"]), "bounded-queries")
    reach = spark.sparkContext.broadcast((cells, radii))

    @F.pandas_udf("array<int>")
    def cells_for(pack: pd.DataFrame) -> pd.Series:
        """Cells that can hold a better candidate for some query of a packed row, by covering radii."""
        centers, radius = reach.value
        norms = np.sqrt((centers**2).sum(1))
        out = []
        for row in pack.to_dict("records"):
            tree = _unpacked(row)
            point, r = tree.points[tree.center[0]], tree.radius[0]
            least = min(-np.inf if b is None or np.isnan(b) else b for b in row["bounds"])
            out.append(np.flatnonzero((radius >= 0) & (_bound(centers @ point, np.linalg.norm(point), r, norms, radius) >= least)).astype(np.int32))
        return pd.Series(out)

    bundle = F.concat_ws(":", F.col("cell"), F.floor(F.col("part") / BUNDLE)).alias("bundle")
    targets = data.select(F.col("cell").alias("target"), bundle).distinct()
    asking = bounded.withColumn("target", F.explode(cells_for(F.struct("kind", "points", "nodes", "radius", "n", "bounds")))).join(targets, "target")
    others = searched(data.select(*columns, bundle), asking.select(*columns, "bundle", "bounds"), "candidates")
    top = _first(seeds.unionByName(others), k + 1, [F.desc("score"), F.col("ids")[0]], "query")
    # At most k + 1 vectors of at most k + 1 ids; of the ids, the first k + 1 by score and id.
    each = F.flatten(F.transform(F.collect_list(F.struct("score", "ids", "same")), lambda c: F.transform(c["ids"], lambda i: F.struct(
        (-c["score"]).alias("minus"), i.alias("vec_id"), c["same"].alias("same")))))
    best = settle(top.groupBy("query").agg(F.slice(F.array_sort(each), 1, k + 1).alias("best")), "best")
    asked = settle(rows.where("asks").select("id", "q").join(points.where("asks").select("q", F.col("vid").alias("query")), "q").select("id", "query"), "asked")
    others_only = F.slice(F.filter("best", lambda c: ~(c["same"] & (c["vec_id"] == F.col("id")))), 1, k)
    return (asked.join(best, "query").select("id", F.posexplode(others_only).alias("place", "c"))
            .select(F.col("id").alias("query_id"), (F.col("place") + 1).alias("rank"), "c.vec_id", (-F.col("c.minus")).alias("score")))


def op12_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
