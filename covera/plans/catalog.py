"""Registered queries: one per operator of the inventory, on the `policies` view.

Every query reads lineitem and part through the view, so its work grows
with the tables.  Hand-written lookups (make map, merges, rules) are the
fixture's fixed values; everything else is learnt from the data.
Computed doubles that two engines may round differently in the last bits
(averages, quantiles, statistics) are rounded to 4 places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covera.functions.columns import begin_year, make_key, month_index
from covera.operators import clean, encode, impute, outliers, rules, state, stats
from covera.operators.quantiles import exact_quantiles, value_ranks
from covera.plans.processor import PolicyProcessorModel, ProcessorParams
from covera.session import cut_lineage, lineage_scope
from covera.schema import CORE_TYPES
from covera.session import ensure_checkpoint_dir
from covera.plans import summaries
from covera.sources import fixtures, policy_io
from covera.sources.fixtures import FIXTURE_MAKE_MAP, FIXTURE_MERGES, FIXTURE_RULES, FIXTURE_TIE, make_map_table

TIE = FIXTURE_TIE
SEG = outliers.SEG
# Fixed value: on the fixture the temporal split is at year 12 (the view's years run 07..13).
SPLIT_YEAR = 12
R = 4


def policies(spark, sf) -> DataFrame:
    """The policy view; the session's ``covera.input.splits`` deals a one-row-group input to more tasks."""
    splits = spark.conf.get("covera.input.splits", None)
    return fixtures.policies(spark, sf, int(splits) if splits else None)


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/covera-io/{name}-{uuid.uuid4().hex}"


def _r(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, R)
    return col.alias(name or c) if isinstance(c, str) or name else col


# The closed fixture map has at most two rows per map entry.
LOOKUP_ROWS = 2 * len(FIXTURE_MAKE_MAP)


def _lookup(spark):
    return clean.make_lookup(make_map_table(spark))


def k1_train(spark, sf, keep: bool = False) -> DataFrame:
    """Base clean (train).  ``keep`` materialises it once for queries that reuse it."""
    out = clean.base_clean(policies(spark, sf), _lookup(spark), True, TIE, LOOKUP_ROWS)
    return cut_lineage(out) if keep else out


def k1_infer(spark, sf) -> DataFrame:
    return clean.base_clean(policies(spark, sf), _lookup(spark), False, TIE, LOOKUP_ROWS)


def _impute_table(k1):
    t = cut_lineage(impute.learn_impute_table(k1, stored=True))
    return t, t.count()


def _k2_train(spark, sf, keep: bool = False, k1=None):
    k1 = k1 if k1 is not None else k1_train(spark, sf, keep=True)
    t, n = _impute_table(k1)
    out = impute.full_clean(k1, t, True, table_rows=n)
    return cut_lineage(out) if keep else out


def _k2_and_caps(spark, sf):
    """Full clean (train) and the learnt caps: medians and caps from one quantile pass."""
    k1 = k1_train(spark, sf, keep=True)
    qt = outliers.fit_quantiles(k1)
    t = cut_lineage(impute.learn_impute_table(k1, qt["impute"]))
    scalar, by_type = outliers.learn_caps(k1, 0.99, qt["caps"])
    by_type = cut_lineage(by_type)
    return impute.full_clean(k1, t, True, table_rows=t.count()), outliers.scalar_caps_dict(scalar), by_type, by_type.count()


def fixture_model(spark, sf) -> PolicyProcessorModel:
    """Learnt impute table, defaults and caps; hand-set merges and rules."""
    # The base clean goes when the model has learnt from it.
    with lineage_scope(spark):
        k1 = k1_train(spark, sf, keep=True)
        qt = outliers.fit_quantiles(k1)
        imp = cut_lineage(impute.learn_impute_table(k1, qt["impute"]), keep=True)
        scalar, by_type = outliers.learn_caps(k1, 0.99, qt["caps"])
        by_type = cut_lineage(by_type, keep=True)
        return PolicyProcessorModel(
            TIE, ProcessorParams(), _lookup(spark), LOOKUP_ROWS, imp, imp.count(),
            impute.defaults_dict(impute.learn_defaults(k1, qt["defaults"])), outliers.scalar_caps_dict(scalar),
            by_type, by_type.count(), list(FIXTURE_MERGES), list(FIXTURE_RULES))


KEYS = ["OBJECT_ID", *TIE]


# --- A / B: sources and scalar functions --------------------------------------------------
def a1_policies(spark, sf):
    return policies(spark, sf)


def b1_month_index(spark, sf):
    p = policies(spark, sf)
    return p.select(*KEYS, "INSR_BEGIN", "INSR_END", month_index("INSR_BEGIN").alias("START_MNTH"),
                    month_index("INSR_END").alias("END_MNTH"),
                    (month_index("INSR_END") - month_index("INSR_BEGIN")).alias("DURATION"),
                    begin_year("INSR_BEGIN").alias("BEGIN_YEAR"))


def b3_object_age(spark, sf):
    k1 = k1_train(spark, sf)
    from covera.functions.columns import object_age
    return k1.select(*KEYS, "START_MNTH", "PROD_YEAR", object_age("START_MNTH", "PROD_YEAR").alias("OBJECT_AGE"))


def b4_make_key(spark, sf):
    p = policies(spark, sf)
    return p.select("MAKE", make_key("MAKE").alias("MAKE_KEY")).groupBy("MAKE", "MAKE_KEY").agg(
        F.count(F.lit(1)).alias("n"))


def b5_make_closure(spark, sf):
    """Rows per make key of the data and the make that the closed map gives it."""
    keyed = policies(spark, sf).select(make_key("MAKE").alias("KEY"), "MAKE")
    return clean.standardise_make(keyed, _lookup(spark), LOOKUP_ROWS).groupBy(
        F.col("KEY").alias("MAKE_KEY"), F.col("MAKE").alias("MAKE_STD")).agg(F.count(F.lit(1)).alias("n"))


def b6_trade_plates(spark, sf):
    k1 = k1_infer(spark, sf)
    return k1.where(F.col("TYPE_VEHICLE") == "Trade plates").select(*KEYS, "CCM_TON", "SEATS_NUM", "PROD_YEAR")


def b10_segments(spark, sf):
    k1 = outliers.with_segment(k1_train(spark, sf))
    return k1.groupBy(SEG).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("OBJECT_ID").alias("objects"))


def b12_merge_chain(spark, sf):
    k1 = outliers.with_segment(k1_train(spark, sf))
    merged = outliers.apply_merges(k1.withColumn("USAGE_BEFORE", F.col("USAGE")), FIXTURE_MERGES)
    return merged.groupBy(SEG, "USAGE_BEFORE", "USAGE").agg(F.count(F.lit(1)).alias("n"))


# --- C / F1 / K1 ------------------------------------------------------------------------------
def c9_temporal_split(spark, sf):
    p = policies(spark, sf)
    return p.groupBy((begin_year("INSR_BEGIN") <= SPLIT_YEAR).alias("is_train")).agg(F.count(F.lit(1)).alias("n"))


def f1_dedup_contracts(spark, sf):
    m = clean.with_months(clean.drop_null_objects(policies(spark, sf)))
    d = clean.dedup_contracts(clean.keep_positive_duration(m), TIE)
    return d.select(*KEYS, "START_MNTH", "DURATION", "INSURED_VALUE", "SEX", "PREMIUM", "INSR_TYPE")


def k1_base_clean_train(spark, sf):
    return k1_train(spark, sf)


def k1_base_clean_inference(spark, sf):
    return k1_infer(spark, sf)


def k1_clean_metrics(spark, sf):
    return clean.base_clean_metrics(policies(spark, sf), _lookup(spark), True, TIE)


# --- D2 / E1-E4 / K2 / K3 ---------------------------------------------------------------------
_FILLS = ["CCM_TON_fill", "SEATS_NUM_fill", "PROD_YEAR_fill", "INSURED_VALUE_fill"]


def d2_impute_table(spark, sf):
    t = impute.learn_impute_table(k1_train(spark, sf))
    return t.select(*[F.round(c, R).alias(c) if c in _FILLS else F.col(c) for c in t.columns])


def d2_group_impute(spark, sf):
    k1 = k1_train(spark, sf, keep=True)
    out = impute.apply_impute(k1, *_impute_table(k1))
    return out.select(*KEYS, *[_r(c) for c in impute.IMPUTED])


def k3_defaults(spark, sf):
    d = impute.learn_defaults(k1_train(spark, sf))
    return d.select("col", _r("num_value"), "text_value")


def k2_full_clean_train(spark, sf):
    k2 = _k2_train(spark, sf)
    return k2.select(*[_r(c) if t == "double" else F.col(c) for c, t in k2.dtypes])


def k3_default_fill(spark, sf):
    k1 = k1_train(spark, sf, keep=True)
    defaults = impute.defaults_dict(impute.learn_defaults(k1, stored=True))
    t, n = _impute_table(k1)
    out = impute.full_clean(k1_infer(spark, sf), t, False, defaults, n)
    return out.select(*[_r(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def e7_null_counts(spark, sf):
    k1 = k1_train(spark, sf, keep=True)
    return impute.null_counts(impute.apply_impute(k1, *_impute_table(k1)))


# --- E5/E6/C5/C6/K4 ---------------------------------------------------------------------------
def e5_scalar_caps(spark, sf):
    scalar, _ = outliers.learn_caps(k1_train(spark, sf))
    return scalar.select(SEG, "col", _r("cap"))


def e6_type_caps(spark, sf):
    _, by_type = outliers.learn_caps(k1_train(spark, sf))
    return by_type.select(SEG, "TYPE_VEHICLE", _r("SEATS_NUM_cap"), _r("CCM_TON_cap"))


def c6_capped_rows(spark, sf):
    out = outliers.apply_caps(*_k2_and_caps(spark, sf))
    return out.select(*KEYS, SEG, "TYPE_VEHICLE", _r("PREMIUM"))


def k4_outlier_stage(spark, sf):
    out = _k4_fixture(spark, sf)
    return out.select(*KEYS, SEG, "TYPE_VEHICLE", "USAGE", "SEX", "INSR_TYPE")


def k4_cap_metrics(spark, sf):
    return outliers.cap_metrics(*_k2_and_caps(spark, sf))


# --- E8-E16 -----------------------------------------------------------------------------------
def e9_value_counts(spark, sf):
    return summaries.value_counts(policies(spark, sf).withColumn("MAKE_KEY", make_key("MAKE")), ["TYPE_VEHICLE", "MAKE_KEY"])


def e10_crosstab_objects(spark, sf):
    return summaries.cross_tab(k1_train(spark, sf), "TYPE_VEHICLE", "USAGE", "OBJECT_ID")


def e11_box_stats(spark, sf):
    seg = cut_lineage(outliers.with_segment(_k2_train(spark, sf)))
    b = summaries.box_stats(seg, "PREMIUM", [SEG, "TYPE_VEHICLE"])
    return b.select(SEG, "TYPE_VEHICLE", "n", _r("min_v"), _r("q1"), _r("median"), _r("q3"), _r("max_v"), "outside")


def e12_histogram(spark, sf):
    return summaries.histogram(k1_train(spark, sf), "PROD_YEAR")


def e13_object_state(spark, sf):
    return state.build_state(k1_train(spark, sf), TIE)


def e15_distinct(spark, sf):
    return summaries.distinct_counts(outliers.with_segment(k1_train(spark, sf)), [SEG],
                                     {"objects": "OBJECT_ID", "types": "TYPE_VEHICLE", "makes": "MAKE"})


def e16_stage_sizes(spark, sf):
    """One scan: the rows read are counted in the staged contracts."""
    k1, _, size = clean.base_clean_report(policies(spark, sf), _lookup(spark), True, TIE, LOOKUP_ROWS)
    return size.select(F.lit("raw").alias("stage"), "n").unionByName(
        summaries.stage_sizes({"base_clean": k1, "full_clean": _k2_train(spark, sf, k1=k1)}))


# --- F2-F5 / N ----------------------------------------------------------------------------------
def f2_first_policies(spark, sf):
    h = state.policy_history(k1_train(spark, sf), TIE)
    return state.first_policies(h).select(*KEYS, SEG, "START_MNTH", "DURATION", "PREMIUM")


def f3_policy_history(spark, sf):
    h = state.policy_history(k1_train(spark, sf), TIE)
    return h.select(*KEYS, SEG, "POLICY_IDX", "PREMIUM_prev", "DURATION_cum")


def n5_later_history(spark, sf):
    h = state.policy_history(k1_train(spark, sf), TIE)
    return state.later_history(h, "skip_first").select(*KEYS, SEG, "PREMIUM", "PREVIOUS_PREMIUM", "TOTAL_DURATION")


def n5_later_history_full(spark, sf):
    h = state.policy_history(k1_train(spark, sf), TIE)
    return state.later_history(h, "full").select(*KEYS, SEG, "PREMIUM", "PREVIOUS_PREMIUM", "TOTAL_DURATION")


def f5_average_ranks(spark, sf):
    seg = outliers.with_segment(k1_train(spark, sf))
    return value_ranks(seg, "PREMIUM", [SEG])


def _train_test(spark, sf):
    k1i = k1_infer(spark, sf)
    yr = F.floor(F.col("START_MNTH") / 12)
    return k1_train(spark, sf).where(yr <= SPLIT_YEAR), k1i.where(yr > SPLIT_YEAR)


def n2_split_by_state(spark, sf):
    train, test = _train_test(spark, sf)
    st = state.build_state(train, TIE)
    return state.split_by_state(test, st).select(*KEYS, SEG, "KNOWN", "PREVIOUS_PREMIUM", "TOTAL_DURATION")


def n3_fold_predictions(spark, sf):
    train, test = _train_test(spark, sf)
    st = state.build_state(train, TIE)
    pred = test.where(F.col("PREMIUM").isNotNull()).withColumn("prediction", F.col("PREMIUM") * 1.1)
    return state.fold_predictions(st, pred, TIE).select(*state.STATE_COLS)


def n4_update_with_labels(spark, sf):
    train, test = _train_test(spark, sf)
    st = state.build_state(train, TIE)
    return state.update_with_labels(st, test.where(F.col("PREMIUM").isNotNull()), TIE)


# --- I: statistics ---------------------------------------------------------------------------
_CATS = ["USAGE", "TYPE_VEHICLE", "SEX"]


def _long(spark, sf):
    seg = outliers.with_segment(k1_train(spark, sf))
    return stats.category_counts(stats.long_by_category(seg, "PREMIUM", _CATS, [SEG]), [SEG, "col"])


def i1_kruskal_h(spark, sf):
    k = stats.kruskal(_long(spark, sf), [SEG, "col"])
    return k.select(SEG, "col", "k", "N", _r("H"))


def i1_kruskal_p(spark, sf):
    k = stats.kruskal(_long(spark, sf), [SEG, "col"])
    return k.select(SEG, "col", "k", "N", _r("H"), _r("p"))


def i2_dunn_z(spark, sf):
    d = stats.dunn(_long(spark, sf), [SEG, "col"])
    return d.select(SEG, "col", "a", "b", _r("z"))


def i2_dunn_p(spark, sf):
    d = stats.dunn(_long(spark, sf), [SEG, "col"])
    return d.select(SEG, "col", "a", "b", _r("z"), _r("p"), _r("p_adj"))


def i4_mann_whitney_u(spark, sf):
    lg = _long(spark, sf)
    pairs = stats.dunn(lg, [SEG, "col"]).select(SEG, "col", "a", "b")
    mw = stats.mann_whitney(lg, [SEG, "col"], pairs)
    return mw.select(SEG, "col", "a", "b", "n_a", "n_b", _r("U1"), _r("cliff_delta"))


def i4_mann_whitney_p(spark, sf):
    lg = _long(spark, sf)
    pairs = stats.dunn(lg, [SEG, "col"]).select(SEG, "col", "a", "b")
    mw = stats.mann_whitney(lg, [SEG, "col"], pairs)
    return mw.select(SEG, "col", "a", "b", _r("U1"), _r("z"), _r("p"), _r("cliff_delta"))


def i6_similar_categories(spark, sf):
    seg = outliers.with_segment(k1_train(spark, sf))
    return stats.similar_categories(seg, "PREMIUM", _CATS, [SEG])


# --- J: rules -----------------------------------------------------------------------------------
MINE_SUPPORT = 0.01
MINE_CONFIDENCE = 0.5


def j1_transactions(spark, sf):
    return rules.transactions(k1_train(spark, sf))


def j2_frequent_itemsets(spark, sf):
    return rules.frequent_itemsets(k1_train(spark, sf), MINE_SUPPORT)


def _rule_text(c):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def j3_rules(spark, sf):
    r = rules.association_rules(rules.frequent_itemsets(k1_train(spark, sf), MINE_SUPPORT), MINE_CONFIDENCE)
    return r.select(SEG, _rule_text(F.col("antecedents")).alias("antecedents"),
                    _rule_text(F.col("consequent")).alias("consequent"),
                    _r("antecedent_support"), _r("consequent_support"), _r("support"), _r("confidence"), _r("lift"))


def j7_perfect_rules(spark, sf):
    r = rules.association_rules(rules.frequent_itemsets(k1_train(spark, sf), MINE_SUPPORT), MINE_CONFIDENCE)
    p = rules.perfect_rules(r)
    return p.select(SEG, _rule_text(F.col("antecedents")).alias("antecedents"),
                    _rule_text(F.col("consequent")).alias("consequent"), _r("support"))


def _k4_fixture(spark, sf):
    k2, scalar, by_type, n = _k2_and_caps(spark, sf)
    return outliers.outlier_stage(k2, scalar, by_type, FIXTURE_MERGES, n)


def j5_rule_misses(spark, sf):
    return rules.rule_misses(_k4_fixture(spark, sf), FIXTURE_RULES)


def j6_rule_corrected(spark, sf):
    out = rules.rule_stage(_k4_fixture(spark, sf), FIXTURE_RULES)
    return out.select(*KEYS, SEG, "USAGE", "TYPE_VEHICLE", "INSR_TYPE")


# --- K7/K8 ----------------------------------------------------------------------------------------
def k7_transform_train(spark, sf):
    out = fixture_model(spark, sf).transform(policies(spark, sf), True)
    return out.select(*[_r(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def k7_transform_inference(spark, sf):
    p = policies(spark, sf).drop("PREMIUM")
    out = fixture_model(spark, sf).transform(p, False)
    return out.select(*[_r(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def k8_quality_report(spark, sf):
    return fixture_model(spark, sf).quality_report(policies(spark, sf), True)


# --- L: encoders -----------------------------------------------------------------------------
def l1_make_frequency(spark, sf):
    f = encode.frequency_map(_k2_train(spark, sf), "MAKE")
    return f.select("MAKE", _r("freq"))


def l2_sex_ordinal(spark, sf):
    return encode.first_appearance_codes(_k2_train(spark, sf), "SEX", ["OBJECT_ID", "START_MNTH", "DURATION", *TIE])


def _encoder(k2):
    return encode.CategoricalEncoder(orderCols=["OBJECT_ID", "START_MNTH", "DURATION", *TIE]).fit(k2)


def l3_insr_onehot(spark, sf):
    k2 = _k2_train(spark, sf, keep=True)
    out = _encoder(k2).transform(k2.withColumn("INSR_TYPE_RAW", F.col("INSR_TYPE")))
    return out.select(*KEYS, "INSR_TYPE_RAW", *[c for c in out.columns if c.startswith("INSR_TYPE_") and c != "INSR_TYPE_RAW"])


def l5_encoded(spark, sf):
    """All encoded columns of every row."""
    k2 = _k2_train(spark, sf, keep=True)
    model = _encoder(k2)
    return model.transform(k2).select(*KEYS, *[_r(c) for c in model.feature_names()])


def l7_features(spark, sf):
    """Features of a model in their order, with the mean and deviation that scale them."""
    from covera.plans.models import FeatureAssembler
    k2 = _k2_train(spark, sf, keep=True)
    encoded = _encoder(k2).transform(k2)
    model = FeatureAssembler(["PREMIUM", "OBJECT_ID", "START_MNTH", "PROD_YEAR", *TIE]).fit(encoded)
    rows = [(i, n, float(m), float(sd)) for i, (n, (m, sd)) in enumerate(model.statistics().items())]
    out = spark.createDataFrame(rows, "position int, feature string, mean double, std double")
    return out.select("position", "feature", _r("mean"), _r("std"))


def l4_target_encoding(spark, sf):
    k2 = _k2_train(spark, sf)
    t = encode.target_map(k2, "TYPE_VEHICLE", "PREMIUM").select(
        F.lit("TYPE_VEHICLE").alias("col"), F.col("TYPE_VEHICLE").alias("value"), "n", _r("mean"), _r("prior"), _r("encoded"))
    u = encode.target_map(k2, "USAGE", "PREMIUM").select(
        F.lit("USAGE").alias("col"), F.col("USAGE").alias("value"), "n", _r("mean"), _r("prior"), _r("encoded"))
    return t.unionByName(u)


_SCALED = ["SEATS_NUM", "CCM_TON", "DURATION", "OBJECT_AGE", "INSURED_VALUE"]


def l6_standard_scaling(spark, sf):
    k2 = _k2_train(spark, sf, keep=True)
    k2 = k2.withColumns({c: F.col(c).cast("double") for c in _SCALED})
    return encode.PopulationScaler(_SCALED).fit(k2).transform(k2).select(*KEYS, *[_r(c) for c in _SCALED])


# --- M7 ----------------------------------------------------------------------------------------
def m7_lag_baseline_metrics(spark, sf):
    """RMSE / MAE / R2 / MAPE of 'previous premium' as the prediction of later policies."""
    h = state.later_history(state.policy_history(_k2_train(spark, sf), TIE), "full")
    from covera.plans.models import regression_metrics
    return regression_metrics(h, "PREMIUM", "PREVIOUS_PREMIUM", [SEG]).select(
        SEG, "n", _r("rmse"), _r("mae"), _r("r2"), _r("mape"))


def n1_state_from_transform(spark, sf):
    out = fixture_model(spark, sf).transform(policies(spark, sf), True)
    return state.build_state(out, TIE).select(SEG, "OBJECT_ID", _r("PREVIOUS_PREMIUM"), "TOTAL_DURATION")


# --- A1-A9, C7, C10, G: sources, sinks, plain table operations -------------------------------
def a1_csv_by_name(spark, sf):
    """The policies written as CSV in two column orders, one with more columns, and read back by name."""
    p = policies(spark, sf)
    half = F.pmod(F.col("OBJECT_ID"), F.lit(2)) == 0
    one, two = _folder(spark, "csv"), _folder(spark, "csv")
    p.where(half).write.option("header", True).csv(one)
    p.where(~half).select(F.lit("2020").alias("EFFECTIVE_YR"), *reversed(p.columns)).write.option("header", True).csv(two)
    back = policy_io.read_policies_csv(spark, [one, two])
    return back.select(*[F.col(c).cast(t) for c, t in p.dtypes])


def a2_append_store(spark, sf):
    """Two labelled batches appended to a store, and the store read back."""
    p, store = policies(spark, sf), _folder(spark, "store")
    half = F.pmod(F.col("OBJECT_ID"), F.lit(2)) == 0
    policy_io.append_labelled(p.where(half), store)
    policy_io.append_labelled(p.where(~half), store, batch="second")
    policy_io.append_labelled(p.where(~half), store, batch="second")  # replayed
    return policy_io.read_store(spark, store).select(*CORE_TYPES)


def a3_overwrite_store(spark, sf):
    """A second version of the store; the first stays."""
    p, base = policies(spark, sf), _folder(spark, "versions")
    policy_io.overwrite_store(p.where("SEX = 0"), base, "1")
    return spark.read.parquet(policy_io.overwrite_store(p, base, "2")).select(*CORE_TYPES)


def a7_state_versions(spark, sf):
    """The newest of two state versions."""
    base, st = _folder(spark, "state"), e13_object_state(spark, sf)
    policy_io.save_state(st.where("is_zero"), base, 1)
    policy_io.save_state(st, base, 2)
    return policy_io.latest_state(spark, base)


def a9_materialised(spark, sf):
    return policy_io.materialise(k1_train(spark, sf), _folder(spark, "stage"))


def c7_hand_limits(spark, sf):
    """Rows below hand-set limits; the limit on INSURED_VALUE binds the non-zero segment only."""
    seg = outliers.with_segment(k1_train(spark, sf))
    out = summaries.within_limits(seg, [("PREMIUM", 5000.0), ("SEATS_NUM", 9.0), ("INSURED_VALUE", 400000.0, ~F.col(SEG))])
    return out.select(*KEYS, SEG, "PREMIUM", "SEATS_NUM")


def c10_plain_filter(spark, sf):
    k1 = k1_train(spark, sf)
    return k1.where(F.col("TYPE_VEHICLE").isin("Truck", "Bus") & (F.col("SEATS_NUM") > 5) & F.col("INSURED_VALUE").isNotNull()) \
        .select(*KEYS, "TYPE_VEHICLE", "SEATS_NUM")


def _sorted_premiums(spark, sf):
    k1 = k1_train(spark, sf).select(*KEYS, "PREMIUM")
    return k1.orderBy(F.col("PREMIUM").desc(), *[F.col(c).asc() for c in KEYS])


def g1_largest_premiums(spark, sf):
    """The 100 largest premiums (a top-k report)."""
    return _sorted_premiums(spark, sf).limit(100)


def g2_slice(spark, sf):
    """Rows 1000 to 1099 of the order by premium (a slice)."""
    return _sorted_premiums(spark, sf).offset(1000).limit(100)


def g3_union(spark, sf):
    """The trained-on rows and the later rows as one table."""
    train, test = _train_test(spark, sf)
    cols = [*KEYS, "START_MNTH", "DURATION", "MAKE"]
    return train.select(*cols, F.lit("train").alias("part")).unionByName(test.select(*cols, F.lit("later").alias("part")))


def g6_same_rows(spark, sf):
    """Are the cleaned rows for training those for inference that have a premium and a duration?"""
    cols = ["OBJECT_ID", "START_MNTH", "DURATION", "PREMIUM", "MAKE"]
    b = k1_infer(spark, sf).where("PREMIUM IS NOT NULL AND DURATION > 0").select(*cols)
    return summaries.same_rows(k1_train(spark, sf).select(*cols), b)


QUERIES = {
    "a1_policies": a1_policies,
    "a1_csv_by_name": a1_csv_by_name,
    "a2_append_store": a2_append_store,
    "a3_overwrite_store": a3_overwrite_store,
    "a7_state_versions": a7_state_versions,
    "a9_materialised": a9_materialised,
    "c7_hand_limits": c7_hand_limits,
    "c10_plain_filter": c10_plain_filter,
    "g1_largest_premiums": g1_largest_premiums,
    "g2_slice": g2_slice,
    "g3_union": g3_union,
    "g6_same_rows": g6_same_rows,
    "l5_encoded": l5_encoded,
    "l7_features": l7_features,
    "b1_month_index": b1_month_index,
    "b3_object_age": b3_object_age,
    "b4_make_key": b4_make_key,
    "b5_make_closure": b5_make_closure,
    "b6_trade_plates": b6_trade_plates,
    "b10_segments": b10_segments,
    "b12_merge_chain": b12_merge_chain,
    "c9_temporal_split": c9_temporal_split,
    "f1_dedup_contracts": f1_dedup_contracts,
    "k1_base_clean_train": k1_base_clean_train,
    "k1_base_clean_inference": k1_base_clean_inference,
    "k1_clean_metrics": k1_clean_metrics,
    "d2_impute_table": d2_impute_table,
    "d2_group_impute": d2_group_impute,
    "k3_defaults": k3_defaults,
    "k2_full_clean_train": k2_full_clean_train,
    "k3_default_fill": k3_default_fill,
    "e7_null_counts": e7_null_counts,
    "e5_scalar_caps": e5_scalar_caps,
    "e6_type_caps": e6_type_caps,
    "c6_capped_rows": c6_capped_rows,
    "k4_outlier_stage": k4_outlier_stage,
    "k4_cap_metrics": k4_cap_metrics,
    "e9_value_counts": e9_value_counts,
    "e10_crosstab_objects": e10_crosstab_objects,
    "e11_box_stats": e11_box_stats,
    "e12_histogram": e12_histogram,
    "e13_object_state": e13_object_state,
    "e15_distinct": e15_distinct,
    "e16_stage_sizes": e16_stage_sizes,
    "f2_first_policies": f2_first_policies,
    "f3_policy_history": f3_policy_history,
    "n5_later_history": n5_later_history,
    "n5_later_history_full": n5_later_history_full,
    "f5_average_ranks": f5_average_ranks,
    "n2_split_by_state": n2_split_by_state,
    "n3_fold_predictions": n3_fold_predictions,
    "n4_update_with_labels": n4_update_with_labels,
    "i1_kruskal_h": i1_kruskal_h,
    "i1_kruskal_p": i1_kruskal_p,
    "i2_dunn_z": i2_dunn_z,
    "i2_dunn_p": i2_dunn_p,
    "i4_mann_whitney_u": i4_mann_whitney_u,
    "i4_mann_whitney_p": i4_mann_whitney_p,
    "i6_similar_categories": i6_similar_categories,
    "j1_transactions": j1_transactions,
    "j2_frequent_itemsets": j2_frequent_itemsets,
    "j3_rules": j3_rules,
    "j7_perfect_rules": j7_perfect_rules,
    "j5_rule_misses": j5_rule_misses,
    "j6_rule_corrected": j6_rule_corrected,
    "k7_transform_train": k7_transform_train,
    "k7_transform_inference": k7_transform_inference,
    "k8_quality_report": k8_quality_report,
    "l1_make_frequency": l1_make_frequency,
    "l2_sex_ordinal": l2_sex_ordinal,
    "l3_insr_onehot": l3_insr_onehot,
    "l4_target_encoding": l4_target_encoding,
    "l6_standard_scaling": l6_standard_scaling,
    "m7_lag_baseline_metrics": m7_lag_baseline_metrics,
    "n1_state_from_transform": n1_state_from_transform,
}


# --- M: models (rows-only checks) ----------------------------------------------------------------
# The registered model queries search the estimators' default grids (covera.plans.models).
# One fitted model per session and input: the model queries share it.
_FITTED: dict = {}


def _predictor(spark):
    from covera.plans.predictor import PremiumPredictor
    from covera.plans.processor import PolicyProcessor
    return PremiumPredictor(PolicyProcessor(make_map_table(spark), TIE), KEYS)


def _fitted(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = _predictor(spark).fit(policies(spark, sf).where(begin_year("INSR_BEGIN") <= SPLIT_YEAR))
    return _FITTED[key]


def m8_backtest(spark, sf):
    from covera.plans.predictor import backtest
    out = backtest(_predictor(spark), policies(spark, sf), SPLIT_YEAR, model=_fitted(spark, sf))
    return out.select("part", "n", _r("rmse"), _r("mae"), _r("r2"), _r("mape"))


def m9_model_metrics(spark, sf):
    return _fitted(spark, sf).metrics_table(spark)


def _predictions(spark, sf):
    test = policies(spark, sf).where(begin_year("INSR_BEGIN") > SPLIT_YEAR).drop("PREMIUM")
    return _fitted(spark, sf).predict_rows(test)


def m6_predictions(spark, sf):
    """A4 + M6: every test row with its prediction (null where cleaning dropped it)."""
    return _predictions(spark, sf).select(*KEYS, _r("predicted_premium"))


def m6_prediction_statistics(spark, sf):
    from covera.plans.predictor import prediction_statistics
    return prediction_statistics(_predictions(spark, sf)).select("n", _r("min"), _r("max"), _r("mean"), _r("median"))


QUERIES.update({f.__name__: f for f in (m8_backtest, m9_model_metrics, m6_predictions, m6_prediction_statistics)})


# --- Queries of covera/plans/catalog_stores.py ------------------------------------------------------
from covera.plans.catalog_stores import STORE_QUERIES  # noqa: E402

QUERIES.update(STORE_QUERIES)
