"""Association rules: J1-J7, K5.

Transactions (J1) are rows; each of the five item columns gives at most one
item, and a null gives none.  So an itemset is a choice of columns plus one
value per chosen column, and its support is a grouped count: the rows are
first reduced to distinct (segment, five values) with counts, then every
non-empty column subset is expanded from that small table (a hand-made
grouping-sets expand, 31 subsets) and summed.  No one-hot matrix is built.

Rule order (it matters for sequential correction): itemsets by size, then by
their items in column order (values compared as text); inside an itemset,
larger antecedents first, then by antecedent items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covera.operators.joins import checked_broadcast
from covera.operators.outliers import SEG, with_segment
from covera.session import cut_lineage

# The item columns, in the order items are listed.
ITEM_COLS = ["USAGE", "TYPE_VEHICLE", "MAKE", "SEX", "INSR_TYPE"]
N_ITEMS = len(ITEM_COLS)


def _subsets(n: int = N_ITEMS):
    return [m for m in range(1, 1 << n)]


def _items_of(mask_col, prefix: str = ""):
    """Array of (pos, col, value) structs for the columns in the mask, in column order."""
    return F.filter(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(1 << i).alias("bit"), F.lit(c).alias("col"),
                 F.col(f"{prefix}{c}").alias("value"))
        for i, c in enumerate(ITEM_COLS)]), lambda s: s["bit"].bitwiseAND(mask_col) != 0)


def transactions(df: DataFrame) -> DataFrame:
    """(is_zero, five item columns as text, cnt): the distinct baskets."""
    seg = with_segment(df)
    return seg.groupBy(SEG, *[F.col(c).cast("string").alias(c) for c in ITEM_COLS]).agg(
        F.count(F.lit(1)).alias("cnt"))


def frequent_itemsets(df: DataFrame, min_support: float = 0.1) -> DataFrame:
    """(is_zero, mask, five values (null = column not in set), cnt, support, size)."""
    return itemsets_of(transactions(df), min_support)


def itemsets_of(baskets: DataFrame, min_support: float) -> DataFrame:
    """J2 from the distinct baskets with their counts."""
    n_seg = baskets.groupBy(SEG).agg(F.sum("cnt").alias("_n"))
    expanded = baskets.select(SEG, "cnt", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mask"), *[
            (F.col(c) if (m >> i) & 1 else F.lit(None).cast("string")).alias(c) for i, c in enumerate(ITEM_COLS)])
        for m in _subsets()])).alias("s")).select(SEG, "cnt", "s.*")
    # A null value in a chosen column is no item: drop that (basket, subset) pair.
    present = F.lit(True)
    for i, c in enumerate(ITEM_COLS):
        present = present & ((F.col("mask").bitwiseAND(F.lit(1 << i)) == 0) | F.col(c).isNotNull())
    sets = expanded.where(present).groupBy(SEG, "mask", *ITEM_COLS).agg(F.sum("cnt").alias("cnt"))
    # Two-row side (one per segment).
    out = sets.join(F.broadcast(n_seg), SEG).withColumn("support", F.col("cnt") / F.col("_n"))
    return (out.where(F.col("support") >= F.lit(min_support))
               .withColumn("size", F.bit_count("mask").cast("int")).drop("_n"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.9975) -> DataFrame:
    """J3 + J4: every split of a frequent itemset into antecedent -> consequent.

    Output: is_zero, seq, antecedents map, consequent map, antecedent_support,
    consequent_support, support, confidence, lift.  Antecedent and consequent
    supports come from equi-joins on the (mask, values) key of the subset.
    """
    big = itemsets.where(F.col("size") >= 2)
    # Enumerate proper non-empty subsets of each itemset's mask.
    subset_pairs = [(w, a) for w in _subsets() for a in _subsets() if (a & w) == a and a != w]
    pair_tab = [F.struct(F.lit(w).alias("w"), F.lit(a).alias("a")) for w, a in subset_pairs]
    splits = (big.withColumn("_p", F.explode(F.filter(F.array(*pair_tab), lambda p: p["w"] == F.col("mask"))))
              .select(SEG, F.col("mask").alias("w_mask"), *[F.col(c).alias(f"w_{c}") for c in ITEM_COLS],
                      F.col("cnt").alias("w_cnt"), F.col("support").alias("support"), F.col("size").alias("w_size"),
                      F.col("_p.a").alias("a_mask")))
    splits = splits.withColumn("c_mask", F.col("w_mask").bitwiseXOR(F.col("a_mask")))
    for i, c in enumerate(ITEM_COLS):
        bit = F.lit(1 << i)
        splits = splits.withColumn(f"a_{c}", F.when(F.col("a_mask").bitwiseAND(bit) != 0, F.col(f"w_{c}")))
        splits = splits.withColumn(f"c_{c}", F.when(F.col("c_mask").bitwiseAND(bit) != 0, F.col(f"w_{c}")))
    sets = itemsets.select(SEG, "mask", *ITEM_COLS, "cnt", "support")
    sp, ante, cons = splits.alias("sp"), sets.alias("A"), sets.alias("C")

    def on(side, prefix):
        return [F.col(f"sp.{SEG}") == F.col(f"{side}.{SEG}"), F.col(f"sp.{prefix}_mask") == F.col(f"{side}.mask")] + [
            F.col(f"sp.{prefix}_{c}").eqNullSafe(F.col(f"{side}.{c}")) for c in ITEM_COLS]

    # Antecedent and consequent are frequent (every subset of a frequent set is).
    j = sp.join(ante, on("A", "a")).join(cons, on("C", "c"))
    rules = j.select(
        F.col(f"sp.{SEG}").alias(SEG), "sp.w_mask", "sp.a_mask", "sp.w_size",
        *[F.col(f"sp.w_{c}").alias(f"w_{c}") for c in ITEM_COLS],
        F.col("A.support").alias("antecedent_support"), F.col("C.support").alias("consequent_support"),
        F.col("sp.support").alias("support"), (F.col("sp.w_cnt") / F.col("A.cnt")).alias("confidence"))
    rules = rules.withColumn("lift", F.col("confidence") / F.col("consequent_support"))
    rules = rules.where(F.col("confidence") >= F.lit(min_confidence))
    w_items = _items_of(F.col("w_mask"), "w_")
    a_items = _items_of(F.col("a_mask"), "w_")
    c_items = _items_of(F.col("c_mask"), "w_")
    order = Window.partitionBy(SEG).orderBy(
        F.col("w_size"), F.transform(w_items, lambda s: F.struct(s["pos"], s["value"])),
        F.bit_count("a_mask").desc(), F.transform(a_items, lambda s: F.struct(s["pos"], s["value"])))
    # The rule list per segment is short (bounded by the itemset count); one window per segment.
    return rules.withColumn("c_mask", F.col("w_mask").bitwiseXOR(F.col("a_mask"))).select(
        SEG, (F.row_number().over(order) - 1).alias("seq"),
        F.map_from_entries(F.transform(a_items, lambda s: F.struct(s["col"], s["value"]))).alias("antecedents"),
        F.map_from_entries(F.transform(c_items, lambda s: F.struct(s["col"], s["value"]))).alias("consequent"),
        "antecedent_support", "consequent_support", "support", "confidence", "lift")


def perfect_rules(rules: DataFrame) -> DataFrame:
    """J7."""
    return rules.where(F.col("confidence") == 1.0)


RULE_SCHEMA = "is_zero boolean, seq int, antecedents map<string,string>, consequent map<string,string>, confidence double"


def rules_frame(spark, rules: list[tuple]) -> DataFrame:
    """Hand-set rules (is_zero, seq, antecedents, consequent, confidence) as a rule table."""
    text = lambda items: {c: str(v) for c, v in items.items()}
    return spark.createDataFrame([(bool(z), int(s), text(a), text(c), float(p)) for z, s, a, c, p in rules], RULE_SCHEMA)


def _programs(rules: DataFrame, min_confidence: float, cols: list[str]) -> DataFrame:
    """One row per segment: its rules in order, as an array.

    Q8: a multi-item consequent uses its first item in column order.  The list
    is bounded by the frequent itemsets (at most 1 / support of every choice of
    columns), not by the rows.
    """
    places = F.array(*[F.struct(F.lit(i).alias("at"), F.element_at("consequent", F.lit(c)).alias("value"))
                       for i, c in enumerate(cols)])
    target = F.get(F.filter(places, lambda x: x["value"].isNotNull()), F.lit(0))
    step = F.struct(F.col("seq").cast("int").alias("seq"), F.array(*[F.element_at("antecedents", F.lit(c)) for c in cols]).alias("when"),
                    target["at"].alias("at"), target["value"].alias("value"),
                    (F.col("confidence") >= F.lit(min_confidence)).alias("corrects"))
    return (rules.withColumn("_step", step).where(F.col("_step.at").isNotNull())
            .groupBy(F.col(SEG).alias("_rule_seg")).agg(F.sort_array(F.collect_list("_step")).alias("_rules")))


def _fold(values, rules, width: int):
    """The values after all rules, and the rules that were missed: one pass over the array of rules."""
    empty = F.array().cast("array<int>")

    def step(state, rule):
        match = F.lit(True)
        for i in range(width):
            wanted = F.get(rule["when"], F.lit(i))
            match = match & (wanted.isNull() | F.coalesce(F.get(state["v"], F.lit(i)) == wanted, F.lit(False)))
        miss = match & ~F.get(state["v"], rule["at"]).eqNullSafe(rule["value"])
        put = F.transform(state["v"], lambda x, i: F.when(i == rule["at"], rule["value"]).otherwise(x))
        return F.struct(F.when(miss & rule["corrects"], put).otherwise(state["v"]).alias("v"),
                        F.when(miss, F.concat(state["missed"], F.array(rule["seq"]))).otherwise(state["missed"]).alias("missed"))

    start = F.struct(values.alias("v"), empty.alias("missed"))
    return F.aggregate(F.coalesce(rules, F.array().cast("array<struct<seq:int,when:array<string>,at:int,value:string,corrects:boolean>>")),
                       start, step)


def folded_baskets(df: DataFrame, rules: DataFrame, min_confidence: float, cols: list[str] = ITEM_COLS) -> DataFrame:
    """(is_zero, given, cnt, v, missed): every distinct basket, what the rules make of it, and the rules it misses."""
    texts = F.array(*[F.col(c).cast("string") for c in cols])
    baskets = with_segment(df).groupBy(SEG, texts.alias("given")).agg(F.count(F.lit(1)).alias("cnt"))
    # At most one row per segment.
    programs = F.broadcast(_programs(rules, min_confidence, cols))
    rows = baskets.join(programs, baskets[SEG] == programs["_rule_seg"], "left")
    return rows.select(SEG, "given", "cnt", _fold(F.col("given"), F.col("_rules"), len(cols)).alias("_f")).select(
        SEG, "given", "cnt", "_f.v", "_f.missed")


def as_table(spark, rules) -> DataFrame:
    return rules if isinstance(rules, DataFrame) else rules_frame(spark, rules)


def rule_stage(df: DataFrame, rules, min_confidence: float = 0.9975, cols: list[str] = ITEM_COLS) -> DataFrame:
    """J5 + J6 (K5): correct the misses of confident rules.

    ``rules`` is a rule table (or a list of hand-set rules).  Rules run in
    sequence (each sees the corrections of the ones before) and compare values
    as text on both sides (Q7); a null consequent cell counts as a miss.  They
    run over the distinct baskets; rows of a changed basket take its values by
    a join.  Neither the plan nor its columns grow with the rules.
    """
    out = with_segment(df)
    table = as_table(df.sparkSession, rules)
    if table.isEmpty():
        return out
    # Read twice: for the baskets, and for the rows.
    out = cut_lineage(out)
    types = dict(out.dtypes)
    changed = cut_lineage(folded_baskets(out, table, min_confidence, cols).where("v != given").select(
        F.col(SEG).alias("_seg"), F.col("given").alias("_given"), F.col("v").alias("_v")))
    changed = checked_broadcast(changed, changed.count())
    key = F.array(*[F.col(c).cast("string") for c in cols])
    joined = out.withColumn("_key", key).join(changed, (F.col(SEG) == F.col("_seg")) & (F.col("_key") == F.col("_given")), "left")

    def value(i, c):
        new = F.get(F.col("_v"), F.lit(i))
        return F.when(~new.eqNullSafe(F.get(F.col("_given"), F.lit(i))), new.cast(types[c])).otherwise(F.col(c)).alias(c)

    at = {c: i for i, c in enumerate(cols)}
    return joined.select(*[value(at[c], c) if c in at else F.col(c) for c in out.columns])


def rule_misses(df: DataFrame, rules, min_confidence: float = 0.9975, cols: list[str] = ITEM_COLS) -> DataFrame:
    """J5 counts: (segment, seq, misses) for every rule."""
    table = as_table(df.sparkSession, rules)
    missed = (folded_baskets(df, table, min_confidence, cols).select(SEG, "cnt", F.explode("missed").alias("seq"))
              .groupBy(F.col(SEG).alias("_seg"), F.col("seq").alias("_seq")).agg(F.sum("cnt").alias("_n")))
    every = table.select(SEG, F.col("seq").cast("int").alias("seq"))
    joined = every.join(missed, (F.col(SEG) == F.col("_seg")) & (F.col("seq") == F.col("_seq")), "left")
    return joined.select(F.when(F.col(SEG), "INSR_ZERO").otherwise("ELSE").alias("segment"), "seq",
                         F.coalesce("_n", F.lit(0)).cast("long").alias("misses"))


# --- Itemsets over any columns -------------------------------------------------------------------

def wide_baskets(df: DataFrame, cols: list[str]) -> DataFrame:
    """(is_zero, items): every row's items ``column=value``, sorted; a null gives none."""
    items = F.array_compact(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cols]))
    return with_segment(df).select(SEG, F.array_sort(items).alias("items"))


def frequent_baskets(baskets: DataFrame, least: DataFrame) -> DataFrame:
    """(is_zero, items, cnt): the distinct baskets once items below ``least`` (is_zero, _n, _least) are left out."""
    single = baskets.select(SEG, F.explode("items").alias("x")).groupBy(SEG, "x").agg(F.count(F.lit(1)).alias("cnt"))
    # At most columns / support items per segment, one row per segment.
    kept = single.join(F.broadcast(least), SEG).where("cnt >= _least").groupBy(SEG).agg(F.collect_list("x").alias("_kept"))
    return (baskets.join(F.broadcast(kept), SEG).select(SEG, F.array_intersect("items", "_kept").alias("items"))
            .where(F.size("items") > 0).groupBy(SEG, "items").agg(F.count(F.lit(1)).alias("cnt")))


def wide_itemsets(df: DataFrame, cols: list[str], min_support: float) -> DataFrame:
    """J2 for wide data: (is_zero, items, cnt, support) of all frequent itemsets over any columns.

    The five columns of :func:`frequent_itemsets` have 31 choices, which one
    expansion counts; over many columns only what is frequent may be extended.
    Rows are first counted as distinct baskets of frequent items.  A frequent
    set then has its tails, what its baskets hold after its last item, as
    counted distinct rows; every level takes one item of the tail into the set.
    All steps are sums that tasks add up before they shuffle, so what is
    shuffled follows the distinct tails and not the rows, and no task holds the
    tails of an item.
    """
    baskets = cut_lineage(wide_baskets(df, cols))
    least = cut_lineage(baskets.groupBy(SEG).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_least", F.ceil(F.lit(float(min_support)) * F.col("_n"))))
    rows = frequent_baskets(baskets, least).select(SEG, F.array().cast("array<string>").alias("items"), F.col("items").alias("_tail"), "cnt")
    levels = []
    while True:
        grown = cut_lineage(rows.select(SEG, "items", "_tail", "cnt", F.posexplode("_tail").alias("_at", "_x")).select(
            SEG, F.concat("items", F.array("_x")).alias("items"), F.expr("slice(_tail, _at + 2, size(_tail))").alias("_tail"),
            "cnt").groupBy(SEG, "items", "_tail").agg(F.sum("cnt").alias("cnt")))
        found = cut_lineage(grown.groupBy(SEG, "items").agg(F.sum("cnt").alias("cnt")).join(F.broadcast(least), SEG).where(
            "cnt >= _least").select(SEG, "items", "cnt", (F.col("cnt") / F.col("_n")).alias("support")))
        n = found.count()
        if n == 0:
            break
        levels.append(found)
        sets = checked_broadcast(found.select(SEG, "items"), n)
        rows = grown.where(F.size("_tail") > 0).join(sets, [SEG, "items"], "left_semi")
    if not levels:
        return df.sparkSession.createDataFrame([], f"{SEG} boolean, items array<string>, cnt long, support double")
    out = levels[0]
    for found in levels[1:]:
        out = out.unionByName(found)
    return cut_lineage(out)


def wide_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """J3 + J4 for :func:`wide_itemsets`: every split of an itemset, consequents of several items included."""
    # Bit i of the mask sends item i to the antecedent; neither side is empty.
    splits = itemsets.where(F.size("items") >= 2).withColumn(
        "_mask", F.explode(F.expr("sequence(1L, shiftleft(1L, size(items)) - 2)")))
    part = lambda bit: F.expr(f"filter(items, (x, i) -> getbit(_mask, i) = {bit})")
    splits = splits.select(SEG, part(1).alias("antecedents"), part(0).alias("consequent"), "cnt", "support")
    side = lambda name: itemsets.select(SEG, F.col("items").alias(name), F.col("cnt").alias(f"_{name}_cnt"),
                                        F.col("support").alias(f"_{name}_support"))
    # Every subset of a frequent itemset is frequent, so both sides are found.
    joined = splits.join(side("antecedents"), [SEG, "antecedents"]).join(side("consequent"), [SEG, "consequent"])
    confidence = F.col("cnt") / F.col("_antecedents_cnt")
    return joined.withColumn("confidence", confidence).where(F.col("confidence") >= F.lit(min_confidence)).select(
        SEG, "antecedents", "consequent", F.col("_antecedents_support").alias("antecedent_support"),
        F.col("_consequent_support").alias("consequent_support"), "support", "confidence",
        (F.col("confidence") / F.col("_consequent_support")).alias("lift"))
