"""SimHash near-dedup with vantage-point trees.

1. Every whole text gets a 64-bit SimHash of its word shingles (Arrow batches
   in Python workers, one document at a time, long ones in blocks).
2. Equal fingerprints are one point.  Points within 3 bits agree to within
   one bit in their lower or their upper half, so there is a vantage-point
   tree over each half.  A node sends a point inside or outside by its
   Hamming distance d to the vantage point; a link spans a node's boundary
   only if both distances are within the radius of it (triangle bound), so
   inside points near the boundary are also sent outside, as visitors.
   Where a half cannot tell points apart, a node measures all 64 bits with
   radius 3.
3. The routing trees are fitted on a bounded sample of points (at most
   ``SAMPLE``, and at most a quarter of them) and route every point to the
   leaves where its links may be.  A leaf of more than ``MOST`` points is dealt
   to several tasks, every block of its points against every other.  A task
   goes on splitting its points in the same way and compares exactly what is
   left.  It returns the links as a
   forest, at most one row per point, so a group of n near copies does not
   turn into n * n rows.
4. Connected components come from alternating large-star and small-star
   joins on those rows, written to the checkpoint folder in every round.

Defined cases: a null text is an empty one; a text without words has the
fingerprint zero and is linked like any other; repeated rows share a point;
a null doc_id never names a component while another id is there; no rows
give no rows; further columns play no part.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.session import cut_lineage

LOW, HIGH, ALL = 0x00000000FFFFFFFF, 0xFFFFFFFF00000000, 0xFFFFFFFFFFFFFFFF
#: Points in the sample that fits the routing trees, and points that a leaf should hold.
SAMPLE, LEAF = 65_536, 1_024
BLOCK = 32_768
#: Points of a leaf that meet in one task; larger leaves are dealt out as blocks against blocks.
MOST = 65_536


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: bit set if set in over half the XXH64 (seed 42) of the word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(b" ".join(words), 42), "big")
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    total, count = len(words) - shingle + 1, np.zeros(64, np.int64)
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        hashes = b"".join([digest(line[s:e - 1], 42) for s, e in zip(starts[a:b], starts[a + shingle:b + shingle])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: list[str], shingle: int = 3) -> DataFrame:
    """The ``key`` columns and ``_fp`` (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array(fps)], names=[*key, "_fp"])

    narrow = docs.select(*key, F.col("text").cast("string").alias("_text"))
    types = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in key) + ", _fp long")


def _split(points: np.ndarray, mask: int, radius: int, rng) -> tuple | None:
    """The best (vantage, mu) of a few vantage points: least rows in the larger side, its visitors counted."""
    best, n = None, len(points)
    for v in points[rng.integers(0, n, 4)]:
        d = np.bitwise_count((points ^ v) & np.uint64(mask))
        upto = np.cumsum(np.bincount(d, minlength=66))
        for mu in range(0, 64):
            inside = upto[mu]
            visitors = inside - (upto[mu - radius] if mu >= radius else 0)
            cost = max(inside, n - inside + visitors)
            if 0 < inside < n and (best is None or cost < best[0]):
                best = (cost, v, mu)
    return best


def _node(points: np.ndarray, mask: int, reach: int, rng):
    """A node that splits the points well: over the half first, else over all bits; None if neither does."""
    for m, r in ((mask, min(1, reach)), (ALL, reach)):
        found = _split(points, m, r, rng)
        if found and found[0] <= 0.9 * len(points):
            return np.uint64(m), r, found[1], found[2]
    return None


def fit_tree(points: np.ndarray, mask: int, reach: int, least: int, seed: int = 0):
    """A routing tree as nested tuples; a leaf is None."""
    rng = np.random.default_rng(seed)

    def grow(p):
        node = _node(p, mask, reach, rng) if len(p) > least else None
        if node is None:
            return None
        inside = np.bitwise_count((p ^ node[2]) & node[0]) <= node[3]
        return (*node, grow(p[inside]), grow(p[~inside]))

    return grow(np.asarray(points, np.uint64))


def _sides(node, home: np.ndarray, visit: np.ndarray):
    """What goes inside and outside: ((home, visitors), (home, visitors))."""
    mask, r, v, mu = node[:4]
    d = np.bitwise_count((home ^ v) & mask).astype(np.int16)
    e = np.bitwise_count((visit ^ v) & mask).astype(np.int16)
    inside = d <= mu
    out = np.concatenate([visit[e > mu - r], home[inside & (d > mu - r)]])
    return (home[inside], visit[e <= mu + r]), (home[~inside], out)


def route(tree, points: np.ndarray, first: int = 0):
    """(leaf number, home points, visitors) of every leaf that the points reach."""
    none, number, stack = points[:0], first, [(tree, points, points[:0])]
    while stack:
        node, home, visit = stack.pop()
        if node is None:
            if len(home) or len(visit):
                yield number, home, visit
            number += 1
            continue
        a, b = _sides(node, home, visit) if len(home) or len(visit) else ((none, none), (none, none))
        stack.append((node[5], *b))
        stack.append((node[4], *a))


def leaves(tree) -> int:
    return 1 if tree is None else leaves(tree[4]) + leaves(tree[5])


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable number for 0..n-1 under the links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, la, lb)
        np.minimum.at(label, lb, la)
        while not np.array_equal(nxt := label[label], label):
            label = nxt


def leaf_links(home: np.ndarray, visit: np.ndarray, mask: int, reach: int, least: int = 512):
    """Links home-home and home-visitor within ``reach`` bits, as a forest: two arrays of points."""
    rng = np.random.default_rng(len(home))
    points = np.concatenate([home, visit])
    ends_a, ends_b, stack = [], [], [(home, visit)]
    while stack:
        h, v = stack.pop()
        if not len(h):
            continue
        node = _node(h, mask, reach, rng) if len(h) > least else None
        if node is not None:
            stack.extend(_sides(node, h, v))
            continue
        own = np.concatenate([h, v])
        la, lb, step = [], [], max(1, 4_000_000 // len(own))
        for at in range(0, len(h), step):
            i, j = np.nonzero(np.bitwise_count(h[at:at + step, None] ^ own[None, :]) <= reach)
            i += at
            later = j > i
            # Of this block's links only a forest is kept.
            label = components(len(own), i[later], j[later])
            rest = np.nonzero(label != np.arange(len(own)))[0]
            la.append(label[rest])
            lb.append(rest)
        la, lb = np.concatenate(la), np.concatenate(lb)
        ends_a.append(own[la])
        ends_b.append(own[lb])
    if not ends_a:
        return points[:0], points[:0]
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = components(len(names), at[:len(a)], at[len(a):])
    rest = np.nonzero(label != np.arange(len(names)))[0]
    return names[label[rest]], names[rest]


def deal(sent: DataFrame, most: int = MOST) -> DataFrame:
    """(leaf, a, b, _fp, home) of ``sent`` (leaf, _fp, home): the tasks of every leaf, none with more than two blocks.

    A leaf's points at home are cut into blocks of about ``most`` by hash, and
    so are its visitors.  Task (a, b) has the home blocks a and b, or with b
    beyond the home blocks the home block a and a block of visitors; so every
    pair at home and every home point with every visitor meet.  A leaf of one
    block each is one task.
    """
    sizes = sent.groupBy("leaf").agg(F.ceil(F.count_if("home") / most).alias("_homes"),
                                     F.ceil(F.count_if(~F.col("home")) / most).alias("_visits"))
    rows = sent.join(sizes, "leaf").where("_homes > 0")
    small = rows.where("_homes = 1 AND _visits <= 1").select("leaf", F.lit(0).cast("long").alias("a"),
                                                            F.lit(0).cast("long").alias("b"), "_fp", "home")
    large = rows.where("_homes > 1 OR _visits > 1").withColumn(
        "_own", F.pmod(F.xxhash64(F.lit(8), "_fp"), F.when(F.col("home"), F.col("_homes")).otherwise(F.col("_visits"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    at_home = F.transform(upto(F.col("_homes") + F.col("_visits")), lambda x: F.when(
        x < F.col("_own"), task(x, F.col("_own"))).otherwise(task(F.col("_own"), x)))
    visiting = F.transform(upto(F.col("_homes")), lambda x: task(x, F.col("_homes") + F.col("_own")))
    return small.unionByName(large.select("leaf", F.explode(F.when(F.col("home"), at_home).otherwise(visiting)).alias("_t"), "_fp", "home")
                             .select("leaf", "_t.a", "_t.b", "_fp", "home"))


def links(points: DataFrame, reach: int = 3, sample: int = SAMPLE, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """(a, b): links among the distinct ``_fp`` of ``points`` whose closure is that of all pairs within ``reach``.

    ``points`` has one row per fingerprint.  ``reach`` is at most 3: beyond
    that the two halves may differ by two bits each.
    """
    if not 0 <= reach <= 3:
        raise ValueError("reach must be 0 to 3")
    total = points.count()
    share = min(0.25, sample / max(1, total))
    drawn = F.pmod(F.xxhash64(F.lit(5), "_fp"), F.lit(1 << 20)) < int(share * (1 << 20))
    got = np.array([r[0] for r in points.where(drawn).select("_fp").limit(2 * sample).collect()], np.int64).view(np.uint64)
    got.sort()
    least = max(16, int(leaf * share))
    trees = [(mask, fit_tree(got, mask, reach, least)) for mask in (LOW, HIGH)]
    firsts = [0, leaves(trees[0][1])]

    def send(batches):
        for b in batches:
            fps, parts = b["_fp"].to_numpy(np.int64).view(np.uint64), []
            for (_, tree), first in zip(trees, firsts):
                for number, home, visit in route(tree, fps, first):
                    parts.append((np.full(len(home) + len(visit), number), np.concatenate([home, visit]),
                                  np.repeat([True, False], [len(home), len(visit)])))
            if parts:
                leaf_no, point, at_home = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"leaf": leaf_no, "_fp": point.view(np.int64), "home": at_home})

    def meet(key, group):
        fps, at_home = group["_fp"].to_numpy(np.int64).view(np.uint64), group["home"].to_numpy(bool)
        a, b = leaf_links(fps[at_home], fps[~at_home], LOW if key[0] < firsts[1] else HIGH, reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = cut_lineage(points.select("_fp").mapInPandas(send, "leaf long, _fp long, home boolean"))
    return deal(sent, most).groupBy("leaf", "a", "b").applyInPandas(meet, "a long, b long")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the least of its component."""
    edges = cut_lineage(edges.where(F.col("a") != F.col("b"))
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    while True:
        # Large star: every larger neighbour is linked to the least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: all smaller neighbours and the node itself are linked to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        edges = cut_lineage(small.distinct())
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def group_of(points: DataFrame, reach: int = 3, **kw) -> DataFrame:
    """(_fp, root) for every row of ``points`` (one per fingerprint)."""
    stars = star_components(links(points, reach, **kw))
    return points.join(stars, points["_fp"] == stars["node"], "left").select(
        *points.columns, F.coalesce("root", "_fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 3, **kw) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    rows = cut_lineage(fingerprints(docs, ["doc_id"], shingle))
    points = cut_lineage(rows.groupBy("_fp").agg(F.min("doc_id").alias("least")))
    grouped = group_of(points, reach, **kw)
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "root").select("_fp", "component_id")
    return rows.join(named, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, reach: int = 3, **kw) -> DataFrame:
    """The rows of ``docs`` with one row of each group: that of the least doc_id, ties by the row's hash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), "doc_id", "text", F.xxhash64(row).alias("_row_hash"))
    rows = cut_lineage(fingerprints(keyed, ["doc_id", "_row_hash"], shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row_hash")).alias("first")
    points = cut_lineage(rows.groupBy("_fp").agg(first))
    grouped = group_of(points, reach, **kw)
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first._row_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash"))
    # Rows equal in all columns share a key: one of them stays.
    chosen = keyed.select("_row", "doc_id", "_row_hash").join(kept, same, "left_semi")
    return chosen.dropDuplicates(["doc_id", "_row_hash"]).select("_row.*")
