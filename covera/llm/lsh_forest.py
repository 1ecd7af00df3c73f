"""MinHash near-dedup by an LSH forest.

A document is its set of word shingles (64-bit hashes).  Documents of equal
sets are one point, named by one of their rows.

1. ``ORDERS`` sorted orders of the same signature: order t starts with columns
   of its own.  Two points of similarity s share the first ``DEPTH`` values of
   one order with chance s ** DEPTH; that no order has them together has the
   chance (1 - s ** DEPTH) ** ORDERS, 8e-6 at s = 0.85.  Points with the same
   first values are a region of that order.
2. Inside a region the order goes on with further values, so a point's
   neighbours are those of the longest common prefix.  Regions are cut into
   blocks of consecutive points that overlap: a small region is one block, a
   dense one is resolved at the depth where its neighbours are.  A block
   compares all its points, by signature bytes.  A pair passes if its estimate
   is within five standard errors of the threshold.
3. What dense regions leave open is met exactly: where the points of a region
   are not yet in one component, those outside its largest component are held
   against all of the region, blocks against blocks, one task each.
4. Components of the passing pairs are clusters.  Their texts are read again,
   once, as sets, and every cluster is resolved in the same two steps on them:
   blocks along one order first, the rest afterwards.  Intersections of a
   block come from products of its membership matrix.
5. Connected components of the confirmed links.

Joins whose sides grow with the input are merge joins at every size.  Every
step keeps links as a forest: a group of n near copies gives about n
rows, not n * n.  Blocks hold ``BLOCK`` points and an eighth more.

Defined cases: a null text is an empty one; texts without words have the empty
set and stay alone; texts with fewer words than a shingle are one shingle, the
whole sequence; equal sets are one class whatever their ids; a null id never
names a class while another id is there; repeated rows keep their class; no
rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.llm.common import ordered_scan
from covera.llm.simhash import components, star_components
from covera.session import cut_lineage

ORDERS, DEPTH, DEEP = 16, 4, 8
HASHES = ORDERS * DEEP
BLOCK = 2048
#: Shingles whose hash columns are worked on at once, and cells of a membership matrix.
PIECE, CELLS = 1 << 16, 1 << 22
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct XXH64 hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    total = len(words) - width + 1
    hashes = np.fromiter((digest(line[a:b - 1]) for a, b in zip(starts, starts[width:])), np.uint64, total)
    return np.unique(hashes)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` minima per non-empty set."""
    rng = np.random.default_rng(11)
    factor = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    summand = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    out = np.empty((len(sets), HASHES), np.uint64)
    first = 0
    while first < len(sets):
        end, size = first, 0
        while end < len(sets) and (end == first or size + len(sets[end]) <= PIECE):
            size += len(sets[end])
            end += 1
        shingles = np.concatenate(sets[first:end])
        starts = np.cumsum([0] + [len(s) for s in sets[first:end - 1]])
        room = np.empty_like(shingles)
        for i in range(HASHES):
            np.multiply(shingles, factor[i], out=room)
            room += summand[i]
            out[first:end, i] = np.minimum.reduceat(room, starts)
        first = end
    return out


def sketch(docs: DataFrame, key: str = "doc_id", width: int = 3) -> DataFrame:
    """``key``, _hash (of the text), n (size of the set), d1, d2 (its digest), sig (a byte per hash) and
    orders: (prefix, rest) per order, the first ``DEPTH`` values as one number and the next, shortened, as another."""
    rows = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
                       F.xxhash64("text").alias("_hash"))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column("_text").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            least = _mix(minima([sets[i] for i in full])) if len(full) else np.empty((0, HASHES), np.uint64)
            digest = np.zeros((len(sets), 2), np.uint64)
            for i in full:
                raw = sets[i].tobytes()
                digest[i] = xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)
            per_order = least.reshape(-1, ORDERS, DEEP)
            prefix = np.broadcast_to(np.arange(ORDERS, dtype=np.uint64), per_order.shape[:2])
            rest = np.zeros(per_order.shape[:2], np.uint64)
            for i in range(DEPTH):
                prefix = _mix(prefix * np.uint64(31) + per_order[:, :, i])
            for i in range(DEPTH, DEEP):
                rest = (rest << np.uint64(16)) | (per_order[:, :, i] >> np.uint64(48))
            keys = np.zeros((len(sets), 2 * ORDERS), np.int64)
            keys[full] = np.concatenate([prefix, rest], axis=1).view(np.int64)
            sig = np.zeros((len(sets), HASHES), np.uint8)
            sig[full] = (least >> np.uint64(56)).astype(np.uint8)
            offsets = np.arange(len(sets) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("_hash"), pa.array(n), *[pa.array(digest[:, j].view(np.int64)) for j in (0, 1)],
                 _binary(sig), pa.ListArray.from_arrays(offsets * (2 * ORDERS), pa.array(keys.ravel()))],
                names=[key, "_hash", "n", "d1", "d2", "sig", "orders"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, _hash long, n long, d1 long, d2 long, sig binary, "
                                "orders array<long>")


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _groups(batches, keys: list[str]):
    """Record batches sorted by ``keys``, dealt out group by group as tables."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(c[a] for c in cols)
            if held and here != name:
                yield held
                held = []
            name = here
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def forest(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of a-b, at most one per point."""
    label = components(size, a, b)
    rest = np.flatnonzero(label != np.arange(size))
    return label[rest], rest


# --- the two comparisons ---------------------------------------------------------------------------

def alike_by_signature(payload: list[bytes], n: np.ndarray, percent: int):
    """A function of two index arrays: which pairs have an estimate near the threshold, and sizes that allow it."""
    sig = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), HASHES)
    s = percent / 100
    least = HASHES * s - 5 * np.sqrt(HASHES * s * (1 - s))

    def compare(i, j):
        same = np.zeros((len(i), len(j)), np.int16)
        for c in range(HASHES):
            same += sig[i, c][:, None] == sig[j, c][None, :]
        small, large = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
        return (same >= least) & (100 * small >= percent * large)

    return compare


def alike_by_set(payload: list[bytes], n: np.ndarray, percent: int):
    """The same on full sets, exactly: products of the membership matrix, some columns at a time."""
    sets = [np.frombuffer(p, np.uint64) for p in payload]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[shingle] > 1
    owner, shingle = owner[shared], shingle[shared]
    _, shingle = np.unique(shingle, return_inverse=True)
    by_column = np.argsort(shingle, kind="stable")
    owner, shingle = owner[by_column], shingle[by_column]
    width = max(64, CELLS // len(sets))
    columns = int(shingle[-1]) + 1 if len(shingle) else 0

    def compare(i, j):
        both = np.zeros((len(i), len(j)))
        for first in range(0, columns, width):
            a, b = np.searchsorted(shingle, (first, first + width))
            member = np.zeros((len(sets), min(width, columns - first)), np.float32)
            member[owner[a:b], shingle[a:b] - first] = 1
            both += member[i] @ member[j].T
        return 100 * both >= percent * (n[i][:, None] + n[j][None, :] - both)

    return compare


# --- groups of any size, in blocks -------------------------------------------------------------------

def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grp, id, part, parts) of ``rows`` (grp, place, id): consecutive points of every group of two or more.

    ``part`` is the block of the point; the first eighth of a block belongs to the one before as well.
    Small groups are numbered without a sort; large ones by a range-partitioned scan, so none is gathered.
    """
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = cut_lineage(rows.join(sizes, "grp"))
    small = sized.where(F.col("size") <= block).select("grp", "id", F.lit(0).cast("long").alias("part"),
                                                      F.lit(1).cast("long").alias("parts"))
    if sized.where(F.col("size") > block).isEmpty():
        return small
    placed = ordered_scan(sized.where(F.col("size") > block), [F.col("grp"), F.col("place"), F.col("id")], index="_at")
    # Global positions: a group's own begin at its least one.
    start = placed.groupBy("grp").agg(F.min("_at").alias("_start"))
    at = placed.join(start, "grp").withColumn("_at", F.col("_at") - F.col("_start"))
    part = F.expr(f"_at div {block}")
    again = (F.col("_at") % block < block // 8) & (part > 0)
    parts = F.expr(f"(size + {block - 1}) div {block}")
    large = at.select("grp", "id", F.explode(F.when(again, F.array(part, part - 1)).otherwise(F.array(part))).alias("part"),
                      parts.alias("parts"))
    return small.unionByName(large)


def rest(dealt: DataFrame, stars: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grp, id, part, side): what the blocks of large groups (rows of :func:`blocks`) leave open, blocks against blocks.

    In a group whose points are not all in one component, side 1 are the points outside its largest
    component and side 0 all its points; every block of the one meets every block of the other.
    """
    many = dealt.select("grp", "id", "parts").distinct()
    named = cut_lineage(many.join(stars, many["id"] == stars["node"], "left").select(
        "grp", "id", "parts", F.coalesce("root", "id").alias("_in")))
    sizes = named.groupBy("grp", "_in").agg(F.count(F.lit(1)).alias("_c"))
    major = sizes.groupBy("grp").agg(F.max_by("_in", F.struct("_c", "_in")).alias("_major"),
                                     F.expr("sum(_c) - max(_c)").alias("_minor")).where("_minor > 0")
    mixed = named.join(major, "grp")
    minor_parts = F.expr(f"(_minor + {block - 1}) div {block}")
    deal = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), parts)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    everyone = mixed.withColumn("_i", deal(F.col("parts"), 1)).withColumn("_j", upto(minor_parts)).withColumn("side", F.lit(0))
    minors = mixed.where("_in != _major").withColumn("_j", deal(minor_parts, 2)).withColumn("_i", upto(F.col("parts"))) \
        .withColumn("side", F.lit(1))
    return everyone.unionByName(minors).select("grp", "id", (F.col("_i") * minor_parts + F.col("_j")).alias("part"), "side")


def compare_blocks(rows: DataFrame, alike, percent: int) -> DataFrame:
    """Links (grp, a, b), as a forest per block, of ``rows`` (grp, part, side, id, n, payload).

    Side -1: all pairs of the block; otherwise the points of side 1 against all.
    """
    keys = ["grp", "part"]

    def run(batches):
        for held in _groups(batches, keys):
            table = pa.Table.from_batches(held)
            ids, place = np.unique(table["id"].to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            n = table["n"].to_numpy()[place]
            payload = table["payload"].to_pylist()
            compare = alike([payload[k] for k in place], n, percent)
            sides = table["side"].to_numpy()
            # A point of side 1 is in side 0 of another part or of this one: it stands on the side it has here.
            ones = np.unique(table["id"].to_numpy()[sides == 1])
            left = np.flatnonzero(np.isin(ids, ones)) if len(ones) else np.arange(len(ids))
            a, b = np.nonzero(compare(left, np.arange(len(ids))))
            a = left[a]
            apart = a != b
            x, y = forest(len(ids), a[apart], b[apart])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), table["grp"][0].as_py())), pa.array(ids[x]),
                                                  pa.array(ids[y])], names=["grp", "a", "b"])

    names = ["grp", "part", "side", "id", "n", "payload"]
    # A stated number of partitions: these rows are few bytes and much work.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select(*names).repartition(tasks, *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "grp long, a long, b long"))


def resolve(rows: DataFrame, payload_of, alike, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of every group of ``rows`` (grp, place, id), whatever its size.

    ``payload_of`` gives (grp, part, side, id, n, payload) for (grp, id, part, side).
    """
    dealt = cut_lineage(blocks(rows, block))
    first = payload_of(dealt.select("grp", "id", "part", F.lit(-1).alias("side")))
    links = cut_lineage(compare_blocks(first, alike, percent))
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return links.select("a", "b")
    # The links of large groups say what is still open there.
    known = links.join(large.select("grp").distinct(), "grp", "left_semi").select("a", "b")
    open_ = cut_lineage(rest(large, star_components(known), block))
    return links.select("a", "b").unionByName(cut_lineage(compare_blocks(payload_of(open_), alike, percent)).select("a", "b"))


def set_table(rows: DataFrame, width: int) -> DataFrame:
    """(id, n, payload): the sets of ``rows`` (id, n, _text)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array(sets, pa.binary())],
                                             names=["id", "n", "payload"])

    return rows.mapInArrow(run, "id long, n long, payload binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", width: int = 3, percent: int = 85,
                    block: int = BLOCK) -> DataFrame:
    """``key``, n_shingles, component_id and kept of every row of ``docs``."""
    rows = cut_lineage(sketch(docs, key, width))
    full = rows.where("n > 0")
    # One row names the points of its set; a null id only if there is no other.
    first = F.struct(F.col(key).isNull().alias("_none"), F.col(key).alias("_key"), F.col("_hash"))
    points = cut_lineage(full.groupBy("d1", "d2").agg(
        F.min(first).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("orders").alias("orders"))
        .withColumn("id", F.monotonically_increasing_id()))

    prefixes = points.select("id", F.posexplode(F.slice("orders", 1, ORDERS)).alias("_t", "grp"), "orders").select(
        "grp", F.element_at("orders", F.col("_t") + (ORDERS + 1)).alias("place"), "id")
    signature = points.select("id", "n", F.col("sig").alias("payload"))
    near = resolve(prefixes, lambda d: d.join(signature.hint("merge"), "id"), alike_by_signature, percent, block)
    stars = star_components(near)
    member = stars.select(F.col("node").alias("id"), F.col("root").alias("grp")).unionByName(
        stars.select(F.col("root").alias("id"), F.col("root").alias("grp")).distinct())
    place = F.struct(F.element_at("orders", 1).alias("p"), F.element_at("orders", ORDERS + 1).alias("q")).alias("place")
    clustered = cut_lineage(member.join(points.select("id", "n", "first", place), "id"))

    # The texts of the clusters are read once and kept as sets.
    texts = docs.select(F.col(key).alias("_key"), F.xxhash64("text").alias("_hash"), F.col("text").cast("string").alias("_text"))
    named = clustered.select("id", "n", F.col("first._key").alias("_k"), F.col("first._hash").alias("_h"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    found = texts.join(named.hint("merge"), same).groupBy("id").agg(F.any_value("n").alias("n"), F.any_value("_text").alias("_text"))
    sets = cut_lineage(set_table(found, width))
    order = clustered.select("grp", "place", "id")
    links = resolve(order, lambda d: d.join(sets, "id"), alike_by_set, percent, block)
    linked = star_components(links)
    classes = points.join(linked, points["id"] == linked["node"], "left").select(
        "d1", "d2", F.coalesce("root", "id").alias("root"), "first")
    names = classes.groupBy("root").agg(F.min("first").alias("least"))
    named = classes.join(names, "root").select("d1", "d2", F.col("least._key").alias("component_id"))
    out = full.join(named, ["d1", "d2"]).select(key, F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
