"""Mixing sources to target weights with pivotal dependent rounding.

Every source gets a target number of words.  A document of a source with
target t and size s is wanted t / s times; the whole part is taken outright
and the fraction is rounded so that the words taken stay near the target.

Rounding: two documents with fractional copies p, q and sizes a, b meet.
Words are moved from one to the other, the direction drawn so that both
expectations stay as they are, until one of the two is 0 or 1.  The other
one meets the next document.  a * p + b * q never changes, hence a source
misses its target by less than the one document that is left at its end.

The pairs are met in a reduction tree: a node takes FAN neighbours in the
source's order, settles all but at most one of them, and hands that residual
to the next level.  A node's group never exceeds FAN rows, however large the
source; every level is written to the checkpoint folder, which cuts the
lineage.  Random numbers are hashes of the seed and the two positions, so
reruns agree.

Defined cases: a null text has size 0, and so takes 0 words; a null source is
a source of its own and sorts last; a source without words has target 0;
repeated rows are documents of their own; no rows give no rows; other columns
are kept out of the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covera.llm.common import WORD, let, ordered_scan, uniform
from covera.session import cut_lineage

FAN = 32
#: A copy count this near to a whole number is one (rounding errors of doubles).
NEAR = 1e-9


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, docs, source_size, target: from rows with source and size.

    Sources in code point order (null last) weigh ``weights``, repeating.
    They share ``share`` times all sizes by weight; no target exceeds
    ``most`` times its source, and what exceeds it is shared again by weight.
    In the order of cap / weight the capped sources are a prefix, so one
    ordered scan finds the common words per weight of the rest.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    per = ordered_scan(per, [F.col("source").asc_nulls_last()], index="source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap"))
    per = per.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    total = share * float(whole["size"] or 0)
    scan = ordered_scan(per, [F.col("_ratio"), F.col("source_no")], sums=("_cap", "_w"), index="_at")
    level = (F.lit(total) - F.col("_cap_before")) / (F.lit(float(whole["w"] or 0)) - F.col("_w_before"))
    first = scan.withColumn("_level", level).where(F.col("_ratio") > F.col("_level")).agg(
        F.min_by("_level", "_at").alias("level")).first()["level"]
    target = F.col("_cap") if first is None else F.least(F.col("_cap"), F.col("_w") * F.lit(float(first)))
    return scan.select("source", "source_no", "docs", "source_size", target.alias("target"))


def _meet(seed: int):
    """The pivotal step as a fold over an array of (i, s, p); the state holds the residual and what is settled."""
    settled = "array<struct<i:bigint,take:int>>"

    def one(i, take):
        return F.array(F.struct(i.alias("i"), take.cast("int").alias("take")))

    def snap(p):
        return F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)

    def step(acc, x):
        up = F.least(1 - acc["p"], x["p"] * x["s"] / acc["s"])
        down = F.least(acc["p"], (1 - x["p"]) * x["s"] / acc["s"])

        def moved(m):
            # Up with probability down / (up + down): both expectations stay.
            return F.when(uniform(F.lit(seed), acc["i"], x["i"]) * (m["up"] + m["down"]) < m["down"], m["up"]) \
                .otherwise(-m["down"])

        def after(d):
            p, q = snap(acc["p"] + d["d"]), snap(x["p"] - d["d"] * acc["s"] / x["s"])
            return let(F.struct(p.alias("p"), q.alias("q")), settle)

        def settle(v):
            p_open, q_open = (v["p"] > 0) & (v["p"] < 1), (v["q"] > 0) & (v["q"] < 1)
            none = F.array().cast(settled)
            return F.struct(
                F.when(p_open, acc["i"]).when(q_open, x["i"]).otherwise(F.lit(-1).cast("long")).alias("i"),
                F.when(p_open, acc["s"]).when(q_open, x["s"]).otherwise(F.lit(0.0)).alias("s"),
                F.when(p_open, v["p"]).when(q_open, v["q"]).otherwise(F.lit(0.0)).alias("p"),
                F.concat(acc["done"], F.when(p_open, none).otherwise(one(acc["i"], v["p"])),
                         F.when(q_open, none).otherwise(one(x["i"], v["q"]))).alias("done"))

        met = let(F.struct(up.alias("up"), down.alias("down")),
                  lambda m: let(F.struct(moved(m).alias("d")), after))
        alone = F.struct(x["i"].alias("i"), x["s"].alias("s"), x["p"].alias("p"), acc["done"].alias("done"))
        return F.when(acc["i"] < 0, alone).otherwise(met)

    start = F.struct(F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("p"),
                     F.array().cast(settled).alias("done"))
    return start, step


def pivotal_round(items: DataFrame, seed: int, most_items: int) -> DataFrame:
    """(src, i, take) with take 0 or 1 for items (src, i, s, p), 0 < p < 1, s > 0; i counts from 0 per src."""
    start, step = _meet(seed)
    settled, rest, span = [], items.select("src", "i", "s", "p"), 1
    while True:
        span *= FAN
        last = span >= most_items
        nodes = rest.groupBy("src", F.expr(f"i div {span}").alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("i", "s", "p"))).alias("met"))
        nodes = cut_lineage(nodes.select("src", F.aggregate("met", start, step).alias("r")))
        settled.append(nodes.select("src", F.explode("r.done").alias("d")).select("src", "d.i", "d.take"))
        rest = nodes.where(F.col("r.i") >= 0).select("src", "r.i", "r.s", "r.p")
        if last:
            break
    settled.append(rest.select("src", "i", (uniform(F.lit(seed), "src", "i") < F.col("p")).cast("int").alias("take")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def copies(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
           row_hash: str | None = None) -> DataFrame:
    """doc_id, source, _h, size, source_size, target and copies (0, 1 or 2 at ``most`` = 2) of every row.

    ``_h`` is the column ``row_hash`` of the input, or a hash of the text.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       (F.xxhash64("text") if row_hash is None else F.col(row_hash)).alias("_h"))
    # Large documents first, so that small ones settle what large ones leave over.
    numbered = ordered_scan(rows, [F.col("source").asc_nulls_last(), F.col("size").desc(),
                                   F.xxhash64(F.lit(seed), "doc_id", "_h"), F.col("doc_id"), F.col("_h")])
    targets = source_targets(numbered, weights, share, most)
    firsts = numbered.groupBy(F.col("source").alias("_fs")).agg(F.min("_g").alias("_first"))
    targets = cut_lineage(targets.join(firsts, F.col("source").eqNullSafe(F.col("_fs"))).withColumnRenamed("source", "_source")
                          .drop("_fs"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (numbered.join(targets, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_want", wanted)
            .withColumn("_want", F.when(F.abs(F.col("_want") - F.round("_want")) < NEAR, F.round("_want"))
                        .otherwise(F.col("_want")))
            .withColumn("i", F.col("_g") - F.col("_first")))
    frac = F.col("_want") - F.floor("_want")
    items = rows.where((F.col("size") > 0) & (frac > 0)).select(
        F.col("source_no").alias("src"), "i", F.col("size").cast("double").alias("s"), frac.alias("p"))
    most_items = targets.agg(F.max("docs")).first()[0] or 0
    taken = pivotal_round(items, seed, most_items).select(F.col("src").alias("source_no"), "i", "take")
    return rows.join(taken, ["source_no", "i"], "left").select(
        "doc_id", "source", "_h", "size", "source_size", "target",
        (F.floor("_want") + F.coalesce("take", F.lit(0))).cast("int").alias("copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return copies(docs, **kw).select("doc_id", "size", "source_size", "target",
                                     (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), "doc_id", "source", "text", F.xxhash64(row).alias("_hash"))
    wanted = copies(keyed, row_hash="_hash", **kw).groupBy(F.col("doc_id").alias("_id"), "_h").agg(
        F.sum("copies").alias("_n")).where("_n > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    # Rows equal in all columns share a key and are counted together there.
    once = keyed.select("_row", "doc_id", "_hash").join(wanted, same).dropDuplicates(["doc_id", "_hash"])
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
