import random
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from covera.operators import outliers, rules
from covera.operators.rules import ITEM_COLS
from tests.conftest import policy_rows, row


def basket_rows(spark):
    rs = []
    i = 0
    for usage, tv, make, sex, it, n in [("GC", "Truck", "A", 0, 1202, 30), ("GC", "Truck", "B", 1, 1202, 10),
                                        ("P", "Bus", "A", 0, 1201, 20), ("P", "Truck", None, 1, 1202, 15),
                                        ("GC", "Bus", "A", 0, 1202, 1)]:
        for _ in range(n):
            rs.append(row(OBJECT_ID=i, USAGE=usage, TYPE_VEHICLE=tv, MAKE=make, SEX=sex, INSR_TYPE=it, _row_id=i))
            i += 1
    return policy_rows(spark, rs)


def brute_itemsets(pdf, min_support):
    out = {}
    n = len(pdf)
    for size in range(1, 6):
        for cols in combinations(ITEM_COLS, size):
            part = pdf.dropna(subset=list(cols))
            for vals, cnt in part.groupby(list(cols)).size().items():
                vals = vals if isinstance(vals, tuple) else (vals,)
                if cnt / n >= min_support:
                    out[tuple(sorted(zip(cols, map(str, vals))))] = cnt
    return out


def test_itemsets_match_brute_force(spark):
    df = basket_rows(spark)
    pdf = df.toPandas()
    pdf = pdf[pdf.INSURED_VALUE != 0]
    for c in ["SEX", "INSR_TYPE"]:
        pdf[c] = pdf[c].astype(str)
    got = rules.frequent_itemsets(df, 0.1).toPandas()
    got_sets = {tuple(sorted((c, r[c]) for c in ITEM_COLS if r[c] is not None)): r.cnt for _, r in got.iterrows()}
    assert got_sets == brute_itemsets(pdf, 0.1)


def test_rules_confidence_and_sequential_correction(spark):
    df = basket_rows(spark)
    r = rules.association_rules(rules.frequent_itemsets(df, 0.1), 0.99).toPandas()
    for _, x in r.iterrows():
        assert x.confidence >= 0.99
        assert abs(x.lift - x.confidence / x.consequent_support) < 1e-12
    hand = [(False, 0, {"USAGE": "P"}, {"TYPE_VEHICLE": "Truck"}, 0.999),
            (False, 1, {"TYPE_VEHICLE": "Truck"}, {"INSR_TYPE": "1202"}, 0.999),
            (False, 2, {"USAGE": "GC"}, {"SEX": "1"}, 0.5)]          # below threshold: counted only
    out = rules.rule_stage(df, hand).toPandas()
    assert (out[out.USAGE == "P"].TYPE_VEHICLE == "Truck").all()
    assert (out[out.TYPE_VEHICLE == "Truck"].INSR_TYPE == 1202).all()   # sees the first rule's fixes
    misses = {(m.seq): m.misses for m in rules.rule_misses(df, hand).collect()}
    assert misses == {0: 20, 1: 20, 2: 31}


def sequential(baskets, hand, min_confidence):
    """Plain fold: every rule in turn over every basket."""
    missed = {seq: 0 for _, seq, *_ in hand}
    for b in baskets:
        for zero, seq, ante, cons, conf in hand:
            if zero != b["zero"] or any(b[c] != v for c, v in ante.items()):
                continue
            col = next(c for c in ITEM_COLS if c in cons)
            if b[col] != cons[col]:
                missed[seq] += 1
                if conf >= min_confidence:
                    b[col] = cons[col]
    return baskets, missed


def test_five_thousand_rules_equal_the_sequential_fold(spark):
    rng = random.Random(7)
    pick = {"USAGE": [f"u{i}" for i in range(12)], "TYPE_VEHICLE": [f"t{i}" for i in range(12)],
            "MAKE": [f"m{i}" for i in range(12)] + [None], "SEX": ["0", "1", "2"], "INSR_TYPE": ["1201", "1202", "1204"]}
    hand = []
    for seq in range(5000):
        cols = rng.sample(ITEM_COLS, rng.randint(2, 4))
        cut = rng.randint(1, len(cols) - 1)
        some = {c: rng.choice([v for v in pick[c] if v]) for c in cols}
        hand.append((False, seq, {c: some[c] for c in cols[:cut]}, {c: some[c] for c in cols[cut:]}, rng.choice((0.5, 0.999))))
    baskets = [{c: rng.choice(v) for c, v in pick.items()} for _ in range(120)]
    df = policy_rows(spark, [row(OBJECT_ID=i, _row_id=i, **{c: int(v) if c in ("SEX", "INSR_TYPE") else v for c, v in b.items()})
                             for i, b in enumerate(baskets)])
    table = rules.rules_frame(spark, hand)
    out = {r["OBJECT_ID"]: r for r in rules.rule_stage(df, table).collect()}
    misses = {r["seq"]: r["misses"] for r in rules.rule_misses(df, table).collect()}
    expected, missed = sequential([{**b, "zero": False} for b in baskets], hand, 0.9975)
    for i, b in enumerate(expected):
        assert [None if out[i][c] is None else str(out[i][c]) for c in ITEM_COLS] == [b[c] for c in ITEM_COLS]
    assert misses == missed and sum(missed.values()) > 500
    size = lambda t: len(rules.rule_stage(df, t)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(table) - size(rules.rules_frame(spark, hand[:3]))) < 200


def test_thousands_of_merges_resolve_in_order(spark):
    rng = random.Random(3)
    steps = [(False, "USAGE", i, f"u{rng.randrange(300)}", f"u{rng.randrange(300)}") for i in range(3000)]
    df = policy_rows(spark, [row(OBJECT_ID=i, USAGE=f"u{i}" if i else None, _row_id=i) for i in range(300)])
    out = {r["OBJECT_ID"]: r["USAGE"] for r in outliers.apply_merges(df, steps).collect()}
    for i in range(1, 300):
        cur = f"u{i}"
        for _, _, _, old, new in steps:
            cur = new if cur == old else cur
        assert out[i] == cur
    assert out[0] is None and outliers.apply_merges(df, []).count() == 300


def test_wide_itemsets_and_rules_match_brute_force(spark):
    rng = random.Random(5)
    names = [f"c{i:02d}" for i in range(12)]
    rows = [{c: rng.choice(["a", "a", "a", f"v{i % 3}", None]) for i, c in enumerate(names)} for _ in range(160)]
    df = spark.createDataFrame([(0.0 if i % 2 else 9.0, *[r[c] for c in names]) for i, r in enumerate(rows)],
                               "INSURED_VALUE double, " + ", ".join(f"{c} string" for c in names))
    got = rules.wide_itemsets(df, names, 0.25)
    expected = {}
    for zero in (False, True):
        part = [frozenset(f"{c}={r[c]}" for c in names if r[c] is not None) for i, r in enumerate(rows) if bool(i % 2) == zero]
        level = {frozenset([x]) for b in part for x in b}
        while level:
            counts = {s: sum(s <= b for b in part) for s in level}
            level = {s for s, n in counts.items() if n / len(part) >= 0.25}
            expected.update({(zero, s): (counts[s], len(part)) for s in level})
            level = {a | b for a in level for b in level if len(a | b) == len(a) + 1}
    assert {(r["is_zero"], frozenset(r["items"])): r["cnt"] for r in got.collect()} == {k: n for k, (n, _) in expected.items()}
    assert max(len(s) for _, s in expected) >= 3
    found = rules.wide_rules(got, 0.4).collect()
    brute = {}
    for (zero, s), (n, total) in expected.items():
        for size in range(1, len(s)):
            for ante in map(frozenset, combinations(s, size)):
                if n / expected[zero, ante][0] >= 0.4:
                    brute[zero, ante, s - ante] = (n / expected[zero, ante][0]) / (expected[zero, s - ante][0] / total)
    mine = {(r["is_zero"], frozenset(r["antecedents"]), frozenset(r["consequent"])): r["lift"] for r in found}
    assert set(mine) == set(brute) and all(abs(mine[k] - brute[k]) < 1e-9 for k in mine)
    assert any(len(c) > 1 for _, _, c in mine)


def test_wide_itemsets_extend_counted_baskets(spark):
    """A column whose values are all rare adds nothing to what is extended: 600 rows are 4 counted baskets."""
    rows = [(9.0, "a" if i % 2 else "b", "x" if i % 3 else None, f"n{i}") for i in range(600)]
    df = spark.createDataFrame(rows + [(9.0, None, None, None)], "INSURED_VALUE double, p string, q string, noise string")
    names = ["p", "q", "noise"]
    least = spark.createDataFrame([(False, 601, 61)], "is_zero boolean, _n long, _least long")
    kept = rules.frequent_baskets(rules.wide_baskets(df, names), least).collect()
    assert {tuple(r["items"]): r["cnt"] for r in kept} == {("p=a", "q=x"): 200, ("p=b", "q=x"): 200, ("p=a",): 100, ("p=b",): 100}
    got = rules.wide_itemsets(df, names, 0.1)
    assert {tuple(r["items"]): (r["cnt"], r["support"]) for r in got.collect()} == {
        k: (n, n / 601) for k, n in {("p=a",): 300, ("p=b",): 300, ("q=x",): 400, ("p=a", "q=x"): 200, ("p=b", "q=x"): 200}.items()}
    assert rules.wide_itemsets(df.where(F.lit(False)), names, 0.1).count() == 0
