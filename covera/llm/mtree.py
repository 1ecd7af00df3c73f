"""Exact top-k search by inner product over an M-tree.

Index.  Equal vectors are one entry with its smallest ids: with k neighbours
asked for, the k + 1 smallest ids of a vector are all that any query can want
(it may be one of them itself).  Pivots from a bounded sample (``PIVOTS`` at
most) are the routing objects of the top level; every entry goes to its
nearest pivot, and a pivot with many entries is cut into shards of about
``SHARD``.  A shard is built into nodes of several levels, at most ``FAN``
children each: routing object, covering radius, distance to the parent's
routing object, greatest norm; a leaf is a page of at most ``PAGE`` entries
with their distances to its routing object.  The nodes are a table in the
checkpoint folder, one row each.

Search.  By the triangle inequality d(q, x) >= |d(q, p) - d(p, x)|, and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 turns a least distance into a greatest
score; q.x <= q.p + |q| r is a second bound of a node with radius r.  The
search is best first: a priority queue holds the nodes by the score that they
may still reach, each with the queries that it may serve.  A child is passed over by its stored parent distance before
its routing object is measured, then by the measured distance; entries of a
page are passed over by their stored distances before they are scored.  Every
query first reads the shard that promises most; its k-th score there is the
mark that the other shards have to reach.

Vectors without structure cannot be told apart by distance: on such data
nearly all pairs are scored.  :func:`search_tree` returns the number it scored.

Scores are integers; they are exact while the sums of the products' absolute
values stay below 2 ** 53, and vectors for which they might not fail the job.

Defined cases: vectors that are null or hold null or non-finite components
take no part, nor do rows without vec_id; shorter vectors count as padded with
zeros; equal rows count once; a vec_id with several vectors asks with the
least of them; ties go to the smaller vec_id; with fewer than k
candidates all are returned; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covera.session import cut_lineage

PIVOTS, SHARD, PAGE, FAN, BLOCK = 4_096, 16_384, 128, 16, 2_048
#: A node: its children are the rows from ``child`` on; a leaf has none and holds entries.
_NODE_SCHEMA = ("shard long, node int, child int, children int, radius double, parent double, norm double, routing binary, "
                "ids array<array<bigint>>, vectors binary, distances binary")
_NODE_NAMES = [c.split()[0] for c in _NODE_SCHEMA.split(", ")]


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every valid vector, as integers."""
    x = F.col("v0")
    valid = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v0"))
    return rows.where(F.col("vec_id").isNotNull() & valid).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(arrays, dim: int) -> np.ndarray:
    out = np.zeros((len(arrays), dim))
    for i, a in enumerate(arrays):
        out[i, :len(a)] = a
    return out


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _split(vectors: np.ndarray, rows: np.ndarray, size: int, fan: int, rng) -> list[np.ndarray]:
    """At most ``fan`` parts of ``rows``, by the nearest of some sampled members; halves where distance tells nothing apart."""
    seeds = vectors[rng.choice(rows, min(fan, max(2, -(-2 * len(rows) // size))), replace=False)]
    nearest = _far(vectors[rows], seeds).argmin(1)
    parts = [rows[nearest == s] for s in range(len(seeds)) if (nearest == s).any()]
    return parts if len(parts) > 1 else np.array_split(rows, 2)


def build_tree(vectors: np.ndarray, pivot: np.ndarray, size: int, fan: int, seed: int) -> list[dict]:
    """The nodes of a shard, the root (around ``pivot``) first; the children of a node are consecutive."""
    rng = np.random.default_rng(seed)
    nodes = [{"rows": np.arange(len(vectors)), "routing": pivot, "parent": 0.0}]
    at = 0
    while at < len(nodes):
        node = nodes[at]
        rows, routing = node.pop("rows"), node["routing"]
        far = np.sqrt(((vectors[rows] - routing) ** 2).sum(1))
        node |= {"node": at, "radius": far.max(), "norm": np.sqrt((vectors[rows] ** 2).sum(1).max()), "child": len(nodes),
                 "children": 0, "members": rows, "distances": far}
        if len(rows) > size:
            node |= {"members": rows[:0], "distances": far[:0]}
            for part in _split(vectors, rows, size, fan, rng):
                # The member nearest to the mean is the routing object.
                near = vectors[part[np.argmin(((vectors[part] - vectors[part].mean(0)) ** 2).sum(1))]]
                nodes.append({"rows": part, "routing": near, "parent": np.sqrt(((near - routing) ** 2).sum())})
                node["children"] += 1
        at += 1
    return nodes


@dataclass
class Tree:
    """The nodes of one shard as arrays."""

    routing: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    norm: np.ndarray
    child: np.ndarray
    children: np.ndarray
    pages: list            # per node: None, or (vectors, squares, distances, ids, first id)


def read_tree(frame: pd.DataFrame, dim: int) -> Tree:
    frame = frame.sort_values("node")
    pages = []
    for ids, raw, far in zip(frame["ids"], frame["vectors"], frame["distances"]):
        if not len(ids):
            pages.append(None)
            continue
        vectors = np.frombuffer(raw, np.int64).reshape(-1, dim).astype(float)
        pages.append((vectors, (vectors * vectors).sum(1), np.frombuffer(far, np.float64), [list(i) for i in ids],
                      np.array([i[0] for i in ids], np.int64)))
    column = lambda c: frame[c].to_numpy()
    return Tree(np.stack([np.frombuffer(r, np.float64) for r in frame["routing"]]), column("radius"), column("parent"),
                column("norm"), column("child"), column("children"), pages)


def _most(qq, norm, low):
    """The greatest score at a distance of at least ``low``, for vectors of at most ``norm``."""
    low = np.maximum(low, 0.0)
    return (qq + norm * norm - low * low) / 2.0


def search_tree(tree: Tree | None, queries: np.ndarray, marks: np.ndarray, k: int) -> tuple[list[list], int]:
    """(the best k entries of every query as (score, ids), scored pairs); entries below ``marks`` may be left out.

    The queries share the queue: a node waits with the queries that it may still serve, and by the best promise
    it makes to one of them.  What it does for a query depends on that query's own marks and bounds only.
    """
    count = len(queries)
    if tree is None or not count:
        return [[] for _ in range(count)], 0
    qq = (queries * queries).sum(1)
    size = np.sqrt(qq)
    top = np.full((count, k), -np.inf)                 # scores, best first, and which entry they are of
    first = np.full((count, k), np.iinfo(np.int64).max)
    who = np.full((count, k), -1, np.int64)
    entries, scored, turn = [], 0, 0
    everyone = np.arange(count)
    root = np.sqrt(((queries - tree.routing[0]) ** 2).sum(1))
    waiting = [(-np.inf, turn, 0, everyone, root, np.full(count, np.inf))]
    while waiting:
        _, _, at, rows, reach, promise = heapq.heappop(waiting)
        # The mark, or the k-th score so far.  Scores are whole: half a unit absorbs rounding.
        floor = np.maximum(marks[rows], top[rows, -1]) - 0.5
        still = promise >= floor
        rows, reach, floor = rows[still], reach[still], floor[still]
        if not len(rows):
            continue
        page = tree.pages[at]
        if page is None:
            kids = np.arange(tree.child[at], tree.child[at] + tree.children[at])
            # By the distance to the parent, without a look at the routing objects.
            low = np.abs(reach[:, None] - tree.parent[kids][None, :]) - tree.radius[kids][None, :]
            kids = kids[(_most(qq[rows][:, None], tree.norm[kids][None, :], low) >= floor[:, None]).any(0)]
            if not len(kids):
                continue
            inner = queries[rows] @ tree.routing[kids].T
            far = np.sqrt(np.maximum(qq[rows][:, None] + (tree.routing[kids] ** 2).sum(1)[None, :] - 2.0 * inner, 0.0))
            bound = np.minimum(_most(qq[rows][:, None], tree.norm[kids][None, :], far - tree.radius[kids][None, :]),
                               inner + size[rows][:, None] * tree.radius[kids][None, :])
            serves = bound >= floor[:, None]
            for j in np.flatnonzero(serves.any(0)).tolist():
                mine, turn = serves[:, j], turn + 1
                heapq.heappush(waiting, (-float(bound[mine, j].max()), turn, int(kids[j]), rows[mine], far[mine, j], bound[mine, j]))
            continue
        vectors, squares, distances, ids, least = page
        low = reach[:, None] - distances[None, :]
        alive = (qq[rows][:, None] + squares[None, :] - low * low) / 2.0 >= floor[:, None]
        scored += int(alive.sum())
        score = np.where(alive, queries[rows] @ vectors.T, -np.inf)
        better = (score >= floor[:, None]).any(1)
        if not better.any():
            continue
        rows, score = rows[better], score[better]
        every = np.concatenate([top[rows], score], 1)
        name = np.concatenate([first[rows], np.broadcast_to(least, score.shape)], 1)
        order = np.lexsort((name, -every), axis=1)[:, :k]
        index = np.concatenate([who[rows], np.broadcast_to(len(entries) + np.arange(len(ids)), score.shape)], 1)
        top[rows], first[rows], who[rows] = (np.take_along_axis(x, order, 1) for x in (every, name, index))
        entries += ids
    found = [[(int(s), entries[w]) for s, w in zip(top[i], who[i]) if s > -np.inf] for i in range(count)]
    return found, scored


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row that ``is_query`` selects."""
    spark = vectors.sparkSession
    rows = cut_lineage(quantised(vectors, scale))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    same = Window.partitionBy("_h", "v").orderBy("vec_id")
    few = rows.distinct().withColumn("_h", F.xxhash64("v")).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1)
    entries = cut_lineage(few.groupBy("_h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(PIVOTS, -(-total // SHARD))
    drawn = entries.orderBy(F.xxhash64(F.lit(seed), "_h")).limit(wanted).select("v").collect()
    pivots = _matrix([r[0] for r in drawn], dim)

    def assign(batches):
        for b in batches:
            at = _far(_matrix(b.column("v").to_pylist(), dim), pivots).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64))], names=["_h", "v", "ids", "pivot"])

    placed = cut_lineage(entries.mapInArrow(assign, "_h long, v array<bigint>, ids array<bigint>, pivot long"))
    # A pivot with many entries is cut into shards by hash.
    cuts = {r["pivot"]: -(-r["n"] // SHARD) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = [(p, c) for p in sorted(cuts) for c in range(cuts[p])]
    firsts = {p: i for i, (p, c) in reversed(list(enumerate(shards)))}
    first = F.element_at(F.array(*[F.lit(firsts.get(p, 0)) for p in range(len(pivots))]), (F.col("pivot") + 1).cast("int"))
    cut = F.element_at(F.array(*[F.lit(cuts.get(p, 1)) for p in range(len(pivots))]), (F.col("pivot") + 1).cast("int"))
    placed = placed.withColumn("shard", (first + F.pmod(F.xxhash64("_h"), cut)).cast("long"))

    def build(key, group):
        pivot, x, ids = pivots[shards[key[0]][0]], _matrix(group["v"].tolist(), dim), [list(map(int, i)) for i in group["ids"]]
        out = []
        for n in build_tree(x, pivot, PAGE, FAN, seed):
            members = n["members"]
            out.append((key[0], n["node"], n["child"], n["children"], n["radius"], n["parent"], n["norm"],
                        np.asarray(n["routing"], float).tobytes(), [ids[m] for m in members],
                        x[members].astype(np.int64).tobytes(), n["distances"].tobytes()))
        return pd.DataFrame(out, columns=_NODE_NAMES)

    pages = cut_lineage(placed.groupBy("shard").applyInPandas(build, _NODE_SCHEMA))
    # Of a shard: the greatest distance of an entry to the pivot and the greatest norm, from its root.
    spans = pages.where("node = 0").select("shard", F.col("radius").alias("r"), F.col("norm").alias("m")).collect()
    if max(s["m"] for s in spans) ** 2 >= 2.0 ** 53:
        raise ValueError("scores may be too large for exact integers")
    reach, norm = np.zeros(len(shards)), np.zeros(len(shards))
    for s in spans:
        reach[s["shard"]], norm[s["shard"]] = s["r"], s["m"]
    pivot_of = np.array([p for p, _ in shards])

    def promises(q):
        far = _far(q, pivots)[:, pivot_of]
        low = np.maximum(far - reach[None, :], 0.0)
        return ((q * q).sum(1)[:, None] + (norm ** 2)[None, :] - low * low) / 2.0, far

    def slices(batches):
        # Few queries at once: each is measured against every shard.
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield b.slice(at, 256)

    def homes(batches):
        for b in slices(batches):
            _, far = promises(_matrix(b.column("v").to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far.argmin(1).astype(np.int64))],
                                             names=["query_id", "v", "mark", "shard"])

    def others(batches):
        for b in slices(batches):
            most, far = promises(_matrix(b.column("v").to_pylist(), dim))
            mark = b.column("mark").to_numpy(zero_copy_only=False)
            hit = most >= mark[:, None] - 0.5
            hit[np.arange(len(hit)), far.argmin(1)] = False
            i, s = np.nonzero(hit)
            part = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.astype(np.int64))], names=["query_id", "v", "mark", "shard"])

    def meet(key, queries, group):
        found = []
        if not len(queries) or not len(group):
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        best, _ = search_tree(read_tree(group, dim), _matrix(queries["v"].tolist(), dim), queries["mark"].to_numpy(float), k + 1)
        for q, entries_of in zip(queries["query_id"], best):
            mine = sorted((-s, i) for s, ids in entries_of for i in ids if i != q)[:k]
            found += [(q, i, -s) for s, i in mine]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def search(asked):
        """Queries meet the nodes of their shard in blocks."""
        asked = cut_lineage(asked)
        blocks = asked.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        blocks = blocks.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        left = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
        right = pages.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return left.select("query_id", "v", "mark", "shard", "block").groupBy("shard", "block").cogroup(
            right.select(*_NODE_NAMES, "block").groupBy("shard", "block")).applyInPandas(
            meet, "query_id long, vec_id long, score long")

    kinds = "query_id long, v array<bigint>, mark double, shard long"
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn(
        "mark", F.lit(float("-inf")))
    near = cut_lineage(search(queries.mapInArrow(homes, kinds)))
    marks = near.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    queries = queries.join(marks, "query_id", "left").select(
        "query_id", "v", F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(F.col("mark")).alias("mark"))
    far = search(queries.mapInArrow(others, kinds))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
