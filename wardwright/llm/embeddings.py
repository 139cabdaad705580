"""Near-duplicate embeddings: a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table
from wardwright.llm.graph import components
from wardwright.session import settle


@dataclass
class Tree:
    """One tree in arrays: node k splits by directions[k] at cuts[k] into children[k]; leaves have children -1
    and a number of their own."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaf: np.ndarray


def grow(sample: np.ndarray, leaf_rows: int, spill: float, rng: np.random.Generator, depth: int = 24) -> Tree:
    """Split the sample along a random direction, again and again, points within `spill` of the cut going to both
    sides, until a node has `leaf_rows` points or a split no longer parts them. Of the places between the third and
    the seventh tenth the cut takes the one with the fewest points within `spill`, so that it does not run through a
    dense group, whose points would all go both ways."""
    directions, cuts, children, leaf, leaves = [], [], [], [], 0
    work = [(np.arange(len(sample)), 0, -1, 0)]
    while work:
        rows, level, parent, side = work.pop()
        node = len(cuts)
        if parent >= 0:
            children[parent][side] = node
        direction = rng.normal(size=sample.shape[1])
        direction /= np.linalg.norm(direction)
        directions.append(direction), children.append([-1, -1])
        place = sample[rows] @ direction
        ordered = np.sort(place)
        places = np.quantile(ordered, np.linspace(0.3, 0.7, 41))
        inside = np.searchsorted(ordered, places + spill, "right") - np.searchsorted(ordered, places - spill, "left")
        cut = float(places[np.lexsort((np.abs(np.arange(41) - 20), inside))[0]])
        left, right = rows[place <= cut + spill], rows[place > cut - spill]
        cuts.append(cut)
        if len(rows) <= leaf_rows or level >= depth or max(len(left), len(right)) > 0.9 * len(rows):
            leaf.append(leaves)
            leaves += 1
        else:
            leaf.append(-1)
            work += [(left, level + 1, node, 0), (right, level + 1, node, 1)]
    return Tree(np.array(directions), np.array(cuts), np.array(children), np.array(leaf))


def leaves_of(tree: Tree, points: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, leaf) pairs: all leaves that each point falls into."""
    out_points, out_leaves = [], []
    work = [(0, np.arange(len(points)))]
    while work:
        node, rows = work.pop()
        if not len(rows):
            continue
        if tree.leaf[node] >= 0:
            out_points.append(rows), out_leaves.append(np.full(len(rows), tree.leaf[node]))
            continue
        place = points[rows] @ tree.directions[node]
        work += [(tree.children[node][0], rows[place <= tree.cuts[node] + spill]), (tree.children[node][1], rows[place > tree.cuts[node] - spill])]
    return np.concatenate(out_points), np.concatenate(out_leaves)


def fit_forest(vectors: DataFrame, trees: int, spill: float, leaf_rows: int, sample_rows: int, seed: int) -> list[Tree]:
    """Grow the trees over at most `sample_rows` vectors (16 MB), taken by the order of a hash of their content.
    More vectors than the sample make the leaves fuller, not the trees deeper."""
    count = vectors.count()
    rows = vectors.orderBy("key", "key2").limit(sample_rows).select("vec").toArrow().column("vec").to_pylist()
    points = _unit(np.array(rows, np.float64)) if rows else np.zeros((0, 1))
    share = max(1.0, count / max(1, len(points)))
    rng = np.random.default_rng(seed)
    return [grow(points, max(8, int(leaf_rows / share)), spill, rng) for _ in range(trees)] if len(points) else []


def _unit(points: np.ndarray) -> np.ndarray:
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _deal(forest: list[Tree], spill: float):
    """Each vector once per leaf it falls into, with all its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            points = _unit(_matrix(rows.column("vec")))
            found = [(at, number << 32 | leaf) for number, tree in enumerate(forest) for at, leaf in [leaves_of(tree, points, spill)]]
            point, leaf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            order = np.lexsort((leaf, point))
            point, leaf = point[order], leaf[order]
            ends = np.cumsum(np.bincount(point, minlength=rows.num_rows))
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(leaf, pa.int64()))
            wide = pa.table([*rows.columns, held], [*rows.schema.names, "leaves"])
            for at in range(0, len(point), 4096):
                part = wide.take(pa.array(point[at : at + 4096])).append_column("leaf", pa.array(leaf[at : at + 4096], pa.int64()))
                yield from part.to_batches()

    return run


def _padded(column: pa.ListArray, below: int) -> np.ndarray:
    """The leaves of each row that are numbered below a leaf, padded with -1."""
    values, lengths = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    owner = np.repeat(np.arange(len(column)), lengths)
    keep = values < below
    values, owner = values[keep], owner[keep]
    count = np.bincount(owner, minlength=len(column))
    out = np.full((len(column), max(1, int(count.max(initial=0)))), -1, np.int64)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = values
    return out


def _group_links(rows: pa.Table, least: float, block: int = 1024) -> list[np.ndarray]:
    """Links within one part of a leaf, or between two parts of it, as rows (node, other, more).

    A pair that meets in several leaves belongs to the first of them, so that the counts add up without
    any list of pairs. Of the links only as many are given as connect the nodes.
    """
    first = {c: rows.column(c)[0].as_py() for c in ("leaf", "a", "b")}
    node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
    vec, leaves = _matrix(rows.column("vec").combine_chunks()), _padded(rows.column("leaves").combine_chunks(), first["leaf"])
    norm = np.linalg.norm(vec, axis=1)
    part = rows.column("part").to_numpy()
    left = np.flatnonzero(part == first["a"])
    right = np.flatnonzero(part == first["b"])
    same = first["a"] == first["b"]
    more, pairs = np.zeros(len(node), np.int64), []
    for at in range(0, len(left), block):
        for to in range(at if same else 0, len(right), block):
            i, j = left[at : at + block], right[to : to + block]
            cosine = vec[i] @ vec[j].T / norm[i][:, None] / norm[j][None, :]
            x, y = np.nonzero(cosine >= least)
            x, y = i[x], j[y]
            if same:
                ahead = x < y
                x, y = x[ahead], y[ahead]
            step = max(1, (1 << 22) // leaves.shape[1] ** 2)
            for k in range(0, len(x), step):
                u, v = x[k : k + step], y[k : k + step]
                mine = leaves[u]
                met = ((mine[:, :, None] == leaves[v][:, None, :]) & (mine >= 0)[:, :, None]).any(axis=(1, 2))
                u, v = u[~met], v[~met]
                np.add.at(more, u, copies[v])
                np.add.at(more, v, copies[u])
                pairs.append((u, v))
    if not pairs:
        return []
    u, v = (np.concatenate([q[k] for q in pairs]) for k in (0, 1))
    low = np.arange(len(node))
    while len(u):
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            break
        low = new
    linked, counted = np.flatnonzero(low != np.arange(len(node))), np.flatnonzero(more)
    return [np.stack([node[linked], node[low[linked]], np.zeros(len(linked), np.int64)], axis=1),
            np.stack([node[counted], node[counted], more[counted]], axis=1)]


def _compare(least: float):
    """The links of each group, from rows that come sorted by group."""
    group_keys = ("leaf", "label", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _chained(batches):
            rows = pa.Table.from_batches([batch]) if batch is not None else None
            rows = rows if rest is None else rest if rows is None else pa.concat_tables([rest, rows]).combine_chunks()
            if rows is None or not rows.num_rows:
                continue
            change = np.zeros(rows.num_rows - 1, bool)
            for key in group_keys:
                values = rows.column(key).to_numpy()
                change |= values[1:] != values[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            ends = np.append(starts[1:], rows.num_rows)
            whole = len(starts) if batch is None else len(starts) - 1  # the last group may go on in the next batch
            links = [x for s, e in zip(starts[:whole], ends[:whole]) if e - s > 1 for x in _group_links(rows.slice(s, e - s), least)]
            if links:
                found = np.concatenate(links)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], ["node", "other", "more"])
            rest = None if batch is None else rows.slice(starts[whole])

    return run


def _chained(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(vectors: DataFrame, least: float, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    trees: int = 4, spill: float = 0.012, leaf_rows: int = 200, sample_rows: int = 1 << 15,
                    part_rows: int = 2000, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of equal, non-null labels whose cosine in double precision is `least` or more are linked when a leaf of
    any tree holds both; `n_links` counts the other vectors a vector is linked with, `component_id` is the smallest id
    reachable, `kept` marks it. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing.
    Equal vectors of a label are folded to one before the search, and count as links of each other.

    The forest is fitted on a bounded sample and then every vector goes down every tree. The vectors of a label in a leaf
    are compared in parts of `part_rows`, so no task holds more than two parts of a leaf, however full it is.
    Rows with a null id are not linked and have a null component; repeated rows count as copies.
    An empty table gives an empty result; other columns are not carried.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"), F.col(label).alias("label"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
             & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
             & F.exists("vec", lambda x: F.coalesce(x != 0, F.lit(False))))
    keyed = rows.withColumns({"key": F.when(sound, F.xxhash64("label", "vec")), "key2": F.when(sound, F.xxhash64(F.lit(17), "vec", "label"))})
    ids = settle(keyed.select("vec_id", "key", "key2"), "vector-keys")
    sole = settle(keyed.where("key IS NOT NULL").groupBy("key", "key2").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"), F.any_value("label").alias("label")), "distinct-vectors")
    sizes = [r[0] for r in sole.select(F.size("vec").alias("n")).distinct().collect()]
    found = None
    # Vectors of different lengths have no cosine; each length has its own forest.
    for size in sorted(sizes):
        part = sole.where(F.size("vec") == size)
        forest = fit_forest(part, trees, spill, leaf_rows, sample_rows, seed)
        links = _forest_links(part, forest, least, spill, part_rows)
        found = links if found is None else found.union(links)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = settle(found, "vector-links")
    counts = found.where("node = other").groupBy("node").agg(F.sum("more").alias("more"))
    roots = components(found.where("node <> other").select("node", "other"))
    classes = settle(sole.select("key", "key2", "node", "copies").join(counts, "node", "left").join(roots, "node", "left").select(
        "key", "key2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")), "vector-classes")
    return ids.join(classes, ["key", "key2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def _forest_links(part: DataFrame, forest: list[Tree], least: float, spill: float, part_rows: int) -> DataFrame:
    kind, numbers = (part.schema[c].dataType.simpleString() for c in ("label", "vec"))
    dealt = settle(part.select("node", "copies", "label", "vec").mapInArrow(
        _deal(forest, spill), f"node long, copies long, label {kind}, vec {numbers}, leaves array<long>, leaf long"), "leaf-rows")
    # How many parts a leaf's label needs, from a count that is folded before it is shuffled.
    counted = dealt.groupBy("leaf", "label").count().where("count > 1")
    parts = settle(counted.select("leaf", "label", F.ceil(F.col("count") / part_rows).cast("int").alias("parts")), "leaf-parts")
    placed = dealt.join(parts, ["leaf", "label"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A part meets itself and every other part once; a leaf of one part has the single task (0, 0).
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least(k, F.col("part")).alias("a"), F.greatest(k, F.col("part")).alias("b")))
    tasks = placed.withColumn("meet", F.explode(meets)).select(
        "node", "copies", "label", "vec", "leaves", "leaf", "part", "meet.a", "meet.b")
    keys = ["leaf", "label", "a", "b"]
    return tasks.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_compare(least), "node long, other long, more long")


def op8_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)
