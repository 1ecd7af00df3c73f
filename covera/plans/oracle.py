"""DuckDB text of every registered query (the correctness oracle).

The base views (policies, base clean, imputation, caps) are common table
expressions; the hand-set lookups are rendered from the same fixed lists the
Spark side uses.  Same rounding (4 places) on the same columns as the
Spark queries.
"""

from __future__ import annotations

from covera.functions.columns import MONTHS
from covera.sources.fixtures import FIXTURE_MAKE_MAP, FIXTURE_MERGES, FIXTURE_RULES

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def _month(col: str) -> str:
    return (f"(TRY_CAST(split_part({col}, '-', 3) AS INTEGER) * 12 + "
            f"(NULLIF(list_position({_MONTH_LIST}, split_part({col}, '-', 2)), 0) - 1))")


def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


_MAKE_VALUES = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in FIXTURE_MAKE_MAP)
TIE_DESC = "l_linenumber DESC, l_partkey DESC, l_suppkey DESC, dup_seq DESC"
TIE_ASC = "l_linenumber, l_partkey, l_suppkey, dup_seq"
KEYS = "OBJECT_ID, l_linenumber, l_partkey, l_suppkey, dup_seq"
ORDER = f"START_MNTH, DURATION, {TIE_ASC}"

BASE = f"""
make_raw(raw, canonical) AS (VALUES {_MAKE_VALUES}),
make_lookup AS (
  SELECT k AS MAKE_KEY, arg_min(c, prio) AS MAKE_STD FROM (
    SELECT raw AS k, canonical AS c, 1 AS prio FROM make_raw
    UNION ALL SELECT canonical, canonical, 0 FROM make_raw) t
  WHERE k IS NOT NULL GROUP BY k),
policies AS MATERIALIZED (
  SELECT l_orderkey AS OBJECT_ID, l_linenumber % 3 AS SEX,
    upper(strftime(l_shipdate + to_months(144), '%d-%b-%y')) AS INSR_BEGIN,
    upper(strftime(l_shipdate + to_months(144 + l_linenumber * 3 - 3 + 6 * dup_seq), '%d-%b-%y')) AS INSR_END,
    CASE WHEN l_suppkey % 10 < 6 THEN 1202 WHEN l_suppkey % 10 < 9 THEN 1201 ELSE 1204 END AS INSR_TYPE,
    CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE WHEN l_quantity = 50 THEN NULL ELSE l_extendedprice * 10 END AS INSURED_VALUE,
    CASE WHEN l_quantity = 49 THEN NULL ELSE l_extendedprice * (0.01::DOUBLE + l_discount) END AS PREMIUM,
    CASE WHEN p_size = 7 THEN NULL ELSE CAST(1984 + p_size % 30 AS DOUBLE) END AS PROD_YEAR,
    CASE WHEN l_quantity = 48 THEN NULL ELSE CAST(1 + p_size % 12 AS DOUBLE) END AS SEATS_NUM,
    CASE WHEN p_size % 6 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size * 100 AS DOUBLE) END AS CCM_TON,
    CASE p_type WHEN 'ECONOMY' THEN 'Truck' WHEN 'STANDARD' THEN 'Automobile' WHEN 'PROMO' THEN 'Pick-up'
                WHEN 'SMALL' THEN 'Motor-cycle' WHEN 'LARGE' THEN 'Bus' ELSE 'Trade plates' END AS TYPE_VEHICLE,
    CASE p_brand WHEN 'Brand#1' THEN 'toyota' WHEN 'Brand#2' THEN 'T0Y0TA' WHEN 'Brand#3' THEN 'Land Rover'
                 WHEN 'Brand#4' THEN 'vw' WHEN 'Brand#5' THEN 'Volkswagen' WHEN 'Brand#6' THEN 'ISUSU'
                 WHEN 'Brand#7' THEN 'BAJAJI' WHEN 'Brand#8' THEN NULL WHEN 'Brand#9' THEN 'KAMZ' ELSE p_brand END AS MAKE,
    CASE WHEN l_suppkey % 10 = 0 THEN 'General Cartage' WHEN l_linestatus = 'F' THEN 'Own Goods' ELSE 'Private' END AS USAGE,
    l_linenumber, l_partkey, l_suppkey, dup_seq
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN (SELECT 0 AS dup_seq UNION ALL SELECT 1 AS dup_seq) d ON dup_seq = 0 OR l_partkey % 20 = 0),
months AS (
  SELECT *, {_month('INSR_BEGIN')} AS START_MNTH, {_month('INSR_END')} AS END_MNTH
  FROM policies WHERE OBJECT_ID IS NOT NULL),
months2 AS MATERIALIZED (SELECT *, END_MNTH - START_MNTH AS DURATION FROM months),
dedup AS MATERIALIZED (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY OBJECT_ID, START_MNTH, INSURED_VALUE, SEX, PREMIUM, INSR_TYPE
                                 ORDER BY DURATION DESC, {TIE_DESC}) AS rn
    FROM months2 WHERE DURATION > 0) t WHERE rn = 1),
"""


def _k1(name: str, source: str, train: bool) -> str:
    prem = "WHERE d.PREMIUM IS NOT NULL" if train else ""
    return f"""
{name} AS MATERIALIZED (
  SELECT d.OBJECT_ID, d.SEX, d.INSR_TYPE, d.INSURED_VALUE, d.PREMIUM,
    CASE WHEN d.TYPE_VEHICLE = 'Trade plates' AND d.PROD_YEAR IS NULL THEN 2010.0::DOUBLE ELSE d.PROD_YEAR END AS PROD_YEAR,
    CASE WHEN d.TYPE_VEHICLE = 'Trade plates' THEN 0.0::DOUBLE ELSE d.SEATS_NUM END AS SEATS_NUM,
    CASE WHEN d.TYPE_VEHICLE = 'Trade plates' THEN 0.0::DOUBLE ELSE d.CCM_TON END AS CCM_TON,
    d.TYPE_VEHICLE, COALESCE(m.MAKE_STD, 'UNKNOWN') AS MAKE, d.USAGE, d.START_MNTH, d.DURATION,
    d.l_linenumber, d.l_partkey, d.l_suppkey, d.dup_seq
  FROM {source} d LEFT JOIN make_lookup m ON upper(replace(coalesce(d.MAKE, ''), ' ', '')) = m.MAKE_KEY
  {prem}),"""


IMPUTED = ["CCM_TON", "SEATS_NUM", "PROD_YEAR", "INSURED_VALUE"]
_MISSING = {
    "CCM_TON": "coalesce({c} = 0, false)",
    "SEATS_NUM": "{c} IS NULL", "PROD_YEAR": "{c} IS NULL", "INSURED_VALUE": "{c} IS NULL",
}


def _fill(col: str, row: str = "k", tab: str = "i") -> str:
    miss = _MISSING[col].format(c=f"{row}.{col}")
    return f"CASE WHEN {miss} AND coalesce({tab}.{col}_hit, false) THEN {tab}.{col}_fill ELSE {row}.{col} END"


NUMERIC_DEFAULTS = ["SEX", "INSR_TYPE", "INSURED_VALUE", "PREMIUM", "PROD_YEAR", "SEATS_NUM", "CCM_TON",
                    "START_MNTH", "DURATION"]
MODE_DEFAULTS = ["TYPE_VEHICLE", "MAKE", "USAGE"]

_DEFAULTS = " UNION ALL ".join(
    [f"SELECT '{c}' AS col, quantile_cont({c}, 0.5)::DOUBLE AS num_value, NULL::VARCHAR AS text_value FROM k1_train"
     for c in NUMERIC_DEFAULTS] +
    [f"SELECT '{c}' AS col, NULL::DOUBLE AS num_value, (SELECT {c} FROM k1_train WHERE {c} IS NOT NULL "
     f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS text_value" for c in MODE_DEFAULTS])

_DEFAULT_ROW = "SELECT " + ", ".join(
    [f"max(num_value) FILTER (WHERE col = '{c}') AS {c}_d" for c in NUMERIC_DEFAULTS] +
    [f"max(text_value) FILTER (WHERE col = '{c}') AS {c}_d" for c in MODE_DEFAULTS]) + " FROM defaults"

_K2_COLS = ", ".join(f"{_fill(c)} AS {c}" for c in IMPUTED)
_K1_TYPES = {"SEX": "INTEGER", "INSR_TYPE": "INTEGER", "START_MNTH": "INTEGER", "DURATION": "INTEGER"}


def _default_expr(c: str) -> str:
    if c in MODE_DEFAULTS:
        return f"coalesce({c}, {c}_d)"
    return f"coalesce({c}, CAST({c}_d AS {_K1_TYPES.get(c, 'DOUBLE')}))"


LEARNT = f"""
{_k1('k1_train', 'dedup', True)}
{_k1('k1_infer', 'months2', False)}
imp AS MATERIALIZED (
  SELECT TYPE_VEHICLE, MAKE,
    count(*) FILTER (WHERE NOT coalesce(CCM_TON = 0, false)) > 0 AS CCM_TON_hit,
    avg(CCM_TON) FILTER (WHERE NOT coalesce(CCM_TON = 0, false)) AS CCM_TON_fill,
    count(SEATS_NUM) > 0 AS SEATS_NUM_hit, avg(SEATS_NUM) AS SEATS_NUM_fill,
    count(PROD_YEAR) > 0 AS PROD_YEAR_hit, quantile_cont(PROD_YEAR, 0.5)::DOUBLE AS PROD_YEAR_fill,
    count(INSURED_VALUE) > 0 AS INSURED_VALUE_hit, avg(INSURED_VALUE) AS INSURED_VALUE_fill
  FROM k1_train WHERE TYPE_VEHICLE IS NOT NULL AND MAKE IS NOT NULL GROUP BY TYPE_VEHICLE, MAKE),
imputed AS MATERIALIZED (
  SELECT k.* REPLACE ({_K2_COLS})
  FROM k1_train k LEFT JOIN imp i ON k.TYPE_VEHICLE = i.TYPE_VEHICLE AND k.MAKE = i.MAKE),
k2_train AS MATERIALIZED (
  SELECT *, START_MNTH - (PROD_YEAR - 2000.0::DOUBLE) * 12.0::DOUBLE AS OBJECT_AGE
  FROM imputed WHERE COLUMNS(*) IS NOT NULL),
defaults AS MATERIALIZED ({_DEFAULTS}),
default_row AS MATERIALIZED ({_DEFAULT_ROW}),
imputed_infer AS (
  SELECT k.* REPLACE ({_K2_COLS})
  FROM k1_infer k LEFT JOIN imp i ON k.TYPE_VEHICLE = i.TYPE_VEHICLE AND k.MAKE = i.MAKE),
k2_infer AS (
  SELECT i.* REPLACE ({", ".join(f"{_default_expr(c)} AS {c}" for c in NUMERIC_DEFAULTS + MODE_DEFAULTS)}),
    START_MNTH - (coalesce(PROD_YEAR, PROD_YEAR_d) - 2000.0::DOUBLE) * 12.0::DOUBLE AS OBJECT_AGE
  FROM imputed_infer i, default_row),
seg1 AS (SELECT *, coalesce(INSURED_VALUE = 0, false) AS is_zero FROM k1_train),
caps_scalar AS MATERIALIZED (
  SELECT is_zero, 'PREMIUM' AS col, quantile_cont(PREMIUM, 0.99)::DOUBLE AS cap FROM seg1
  WHERE PREMIUM IS NOT NULL GROUP BY is_zero
  UNION ALL
  SELECT is_zero, 'INSURED_VALUE', quantile_cont(INSURED_VALUE, 0.99)::DOUBLE FROM seg1
  WHERE NOT is_zero AND INSURED_VALUE IS NOT NULL GROUP BY is_zero),
caps_by_type AS MATERIALIZED (
  SELECT t.is_zero, t.TYPE_VEHICLE, s.SEATS_NUM_cap, c.CCM_TON_cap
  FROM (SELECT DISTINCT is_zero, TYPE_VEHICLE FROM seg1 WHERE TYPE_VEHICLE IS NOT NULL) t
  LEFT JOIN (SELECT is_zero, TYPE_VEHICLE, quantile_cont(SEATS_NUM, 0.99)::DOUBLE AS SEATS_NUM_cap FROM seg1
             WHERE SEATS_NUM IS NOT NULL GROUP BY ALL) s USING (is_zero, TYPE_VEHICLE)
  LEFT JOIN (SELECT is_zero, TYPE_VEHICLE, quantile_cont(CCM_TON, 0.99)::DOUBLE AS CCM_TON_cap FROM seg1
             WHERE CCM_TON IS NOT NULL GROUP BY ALL) c USING (is_zero, TYPE_VEHICLE)),
k2s AS (SELECT *, coalesce(INSURED_VALUE = 0, false) AS is_zero FROM k2_train),
capped AS (
  SELECT k.* FROM k2s k JOIN caps_by_type c ON k.is_zero = c.is_zero AND k.TYPE_VEHICLE = c.TYPE_VEHICLE
  WHERE coalesce(k.PREMIUM < (SELECT cap FROM caps_scalar s WHERE s.is_zero = k.is_zero AND s.col = 'PREMIUM'), false)
    AND (k.is_zero OR coalesce(k.INSURED_VALUE < (SELECT cap FROM caps_scalar s WHERE NOT s.is_zero AND s.col = 'INSURED_VALUE'), false))
    AND coalesce(k.SEATS_NUM < c.SEATS_NUM_cap, false) AND coalesce(k.CCM_TON < c.CCM_TON_cap, false)),
"""


def _merge_sql(source: str, merges=FIXTURE_MERGES, types=None) -> str:
    """The merges replayed one after the other: each replaces one value of one column in one segment."""
    types = types or {"USAGE": "VARCHAR", "TYPE_VEHICLE": "VARCHAR", "SEX": "INTEGER"}
    sql = f"SELECT * FROM {source}"
    for seg, col, _, old, new in sorted(merges, key=lambda m: m[2]):
        sql = (f"SELECT * REPLACE (CASE WHEN is_zero = {'true' if seg else 'false'} AND CAST({col} AS VARCHAR) = {_q(old)} "
               f"THEN CAST({_q(new)} AS {types[col]}) ELSE {col} END AS {col}) FROM ({sql})")
    return sql


def _rules_ctes(source: str, rules=FIXTURE_RULES, min_conf: float = 0.9975) -> tuple[str, str, list[str]]:
    """Sequential rule CTEs; returns (ctes, last name, flag names)."""
    types = {"USAGE": "VARCHAR", "TYPE_VEHICLE": "VARCHAR", "MAKE": "VARCHAR", "SEX": "INTEGER", "INSR_TYPE": "INTEGER"}
    order = ["USAGE", "TYPE_VEHICLE", "MAKE", "SEX", "INSR_TYPE"]
    ctes, prev, flags = [], source, []
    for i, (seg, seq, ante, cons, conf) in enumerate(sorted(rules, key=lambda r: (r[0], r[1]))):
        match = [f"is_zero = {'true' if seg else 'false'}"]
        match += [f"coalesce(CAST({c} AS VARCHAR) = {_q(v)}, false)" for c, v in ante.items()]
        ccol = next(c for c in order + sorted(cons) if c in cons)
        cval = cons[ccol]
        flag = f"_miss_{'INSR_ZERO' if seg else 'ELSE'}_{seq}"
        miss = " AND ".join(match) + f" AND NOT (CAST({ccol} AS VARCHAR) IS NOT DISTINCT FROM {_q(cval)})"
        name = f"rule_{i}"
        if conf >= min_conf:
            body = (f"SELECT * REPLACE (CASE WHEN {flag} THEN CAST({_q(cval)} AS {types[ccol]}) ELSE {ccol} END AS {ccol}) "
                    f"FROM (SELECT *, ({miss}) AS {flag} FROM {prev}) t")
        else:
            body = f"SELECT *, ({miss}) AS {flag} FROM {prev}"
        ctes.append(f"{name} AS ({body})")
        flags.append(flag)
        prev = name
    return ",\n".join(ctes) + ",", prev, flags


def _with(*extra: str) -> str:
    return "WITH " + BASE + LEARNT + "\n".join(extra)


def _sql(body: str, *extra: str) -> str:
    text = _with(*extra).rstrip().rstrip(",")
    return text + "\n" + body


R = 4


def _round_all(cols_types: list[tuple[str, str]]) -> str:
    return ", ".join(f"round({c}, {R}) AS {c}" if t == "double" else c for c, t in cols_types)


K1_COLS = [("OBJECT_ID", "long"), ("SEX", "int"), ("INSR_TYPE", "int"), ("INSURED_VALUE", "double"),
           ("PREMIUM", "double"), ("PROD_YEAR", "double"), ("SEATS_NUM", "double"), ("CCM_TON", "double"),
           ("TYPE_VEHICLE", "string"), ("MAKE", "string"), ("USAGE", "string"), ("START_MNTH", "int"),
           ("DURATION", "int"), ("l_linenumber", "int"), ("l_partkey", "long"), ("l_suppkey", "long"),
           ("dup_seq", "int")]


def _k1_select(src: str) -> str:
    return f"SELECT * FROM {src}"


_RULES_ON_MERGED, _RULES_LAST, _RULE_FLAGS = _rules_ctes("merged")
_MERGED = f"merged AS ({_merge_sql('capped')}),"
_SEG_K1 = "segk AS MATERIALIZED (SELECT *, coalesce(INSURED_VALUE = 0, false) AS is_zero FROM k1_train),"

# Long table of (is_zero, col, grp, v) for the rank statistics.
_LONG = """
long AS (
  SELECT is_zero, 'USAGE' AS col, CAST(USAGE AS VARCHAR) AS grp, CAST(NULL AS DOUBLE) AS grp_num, PREMIUM AS v FROM segk WHERE USAGE IS NOT NULL AND PREMIUM IS NOT NULL
  UNION ALL SELECT is_zero, 'TYPE_VEHICLE', CAST(TYPE_VEHICLE AS VARCHAR), NULL, PREMIUM FROM segk WHERE TYPE_VEHICLE IS NOT NULL AND PREMIUM IS NOT NULL
  UNION ALL SELECT is_zero, 'SEX', CAST(SEX AS VARCHAR), CAST(SEX AS DOUBLE), PREMIUM FROM segk WHERE SEX IS NOT NULL AND PREMIUM IS NOT NULL),
per_value AS (SELECT is_zero, col, v, count(*) AS cnt FROM long GROUP BY ALL),
ranks AS (
  SELECT is_zero, col, v, cnt,
    sum(cnt) OVER (PARTITION BY is_zero, col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt + (cnt + 1) / 2.0 AS avg_rank
  FROM per_value),
cat_counts AS (SELECT is_zero, col, grp, grp_num, v, count(*) AS cnt FROM long GROUP BY ALL),
grp_sums AS (
  SELECT c.is_zero, c.col, c.grp, c.grp_num, sum(c.cnt) AS n, sum(c.cnt * r.avg_rank) AS rank_sum
  FROM cat_counts c JOIN ranks r USING (is_zero, col, v) GROUP BY ALL),
tests AS (
  SELECT is_zero, col, sum(cnt) AS N, sum(power(cnt::DOUBLE, 3) - cnt) AS ties FROM per_value GROUP BY ALL),
ks AS (SELECT is_zero, col, count(*) AS k, sum(rank_sum * rank_sum / n) AS s FROM grp_sums GROUP BY ALL),
dunn AS (
  SELECT a.is_zero, a.col, a.grp AS a, b.grp AS b,
    abs(a.rank_sum / a.n - b.rank_sum / b.n)
      / sqrt((t.N::DOUBLE * (t.N + 1) / 12.0 - t.ties / (12.0 * (t.N - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z
  FROM grp_sums a JOIN grp_sums b ON a.is_zero = b.is_zero AND a.col = b.col
   AND (coalesce(a.grp_num, 0) < coalesce(b.grp_num, 0) OR (coalesce(a.grp_num, 0) = coalesce(b.grp_num, 0) AND a.grp < b.grp))
  JOIN tests t ON t.is_zero = a.is_zero AND t.col = a.col),
pair_counts AS (
  SELECT d.is_zero, d.col, d.a, d.b, c.v,
    sum(CASE WHEN c.grp = d.a THEN c.cnt ELSE 0 END) AS cnt_a, sum(CASE WHEN c.grp = d.b THEN c.cnt ELSE 0 END) AS cnt_b
  FROM dunn d JOIN cat_counts c ON c.is_zero = d.is_zero AND c.col = d.col AND (c.grp = d.a OR c.grp = d.b)
  GROUP BY ALL),
pair_ranks AS (
  SELECT *, cnt_a + cnt_b AS cnt,
    sum(cnt_a + cnt_b) OVER (PARTITION BY is_zero, col, a, b ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - (cnt_a + cnt_b) + (cnt_a + cnt_b + 1) / 2.0 AS avg_rank
  FROM pair_counts),
mw AS (
  SELECT is_zero, col, a, b, sum(cnt_a) AS n_a, sum(cnt_b) AS n_b,
    sum(cnt_a * avg_rank) - sum(cnt_a)::DOUBLE * (sum(cnt_a) + 1) / 2.0 AS U1
  FROM pair_ranks GROUP BY ALL),
"""

_ITEMS = ["USAGE", "TYPE_VEHICLE", "MAKE", "SEX", "INSR_TYPE"]
_MASK = " + ".join(f"(CASE WHEN grouping({c}) = 0 THEN {1 << i} ELSE 0 END)" for i, c in enumerate(_ITEMS))
_PRESENT = " AND ".join(f"(grouping({c}) = 1 OR {c} IS NOT NULL)" for c in _ITEMS)


def _set_key(mask: str, side: str) -> str:
    """An itemset as one text: the mask and the values of its columns."""
    return f"concat_ws(chr(1), {mask}, " + ", ".join(
        f"CASE WHEN ({mask} & {1 << i}) <> 0 THEN {side}{c} ELSE '' END" for i, c in enumerate(_ITEMS)) + ")"


def _itemsets(min_support: float) -> str:
    return f"""
baskets AS MATERIALIZED (
  SELECT is_zero, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _ITEMS)}, count(*) AS cnt
  FROM segk GROUP BY ALL),
seg_n AS (SELECT is_zero, sum(cnt) AS n FROM baskets GROUP BY is_zero),
cubed AS (
  SELECT is_zero, ({_MASK}) AS mask, {", ".join(_ITEMS)}, CAST(sum(cnt) AS BIGINT) AS cnt
  FROM baskets GROUP BY is_zero, CUBE ({", ".join(_ITEMS)})
  HAVING ({_MASK}) > 0 AND {_PRESENT}),
itemsets AS MATERIALIZED (
  SELECT c.is_zero, c.mask, {", ".join(f"c.{x}" for x in _ITEMS)}, c.cnt, c.cnt / s.n AS support,
    CAST(bit_count(c.mask) AS INTEGER) AS size, {_set_key("c.mask", "c.")} AS set_key
  FROM cubed c JOIN seg_n s USING (is_zero) WHERE c.cnt / s.n >= {min_support}),
splits AS MATERIALIZED (
  SELECT w.*, m.a_mask, {_set_key("m.a_mask", "w.")} AS a_key, {_set_key("xor(w.mask, m.a_mask)", "w.")} AS c_key
  FROM itemsets w JOIN (SELECT unnest(range(1, {1 << len(_ITEMS)})) AS a_mask) m ON (m.a_mask & w.mask) = m.a_mask AND m.a_mask <> w.mask
  WHERE w.size >= 2),
rules AS (
  SELECT w.is_zero,
    concat_ws(', ', {", ".join(f"CASE WHEN (w.a_mask & {1 << i}) <> 0 THEN '{x}=' || w.{x} END" for i, x in enumerate(_ITEMS))}) AS antecedents,
    concat_ws(', ', {", ".join(f"CASE WHEN (w.a_mask & {1 << i}) = 0 THEN '{x}=' || w.{x} END" for i, x in enumerate(_ITEMS))}) AS consequent,
    a.support AS antecedent_support, c.support AS consequent_support, w.support AS support,
    w.cnt / a.cnt AS confidence, (w.cnt / a.cnt) / c.support AS lift
  FROM splits w
  JOIN itemsets a ON a.is_zero = w.is_zero AND a.set_key = w.a_key
  JOIN itemsets c ON c.is_zero = w.is_zero AND c.set_key = w.c_key),
"""


_ROUND_K1 = _round_all(K1_COLS)
_K2_COLS_ALL = K1_COLS + [("OBJECT_AGE", "double")]
_HIST = f"""
hist AS (
  SELECT *, row_number() OVER w - 1 AS POLICY_IDX,
    lag(PREMIUM) OVER w AS PREMIUM_prev,
    sum(DURATION) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DURATION_cum,
    first_value(DURATION) OVER w AS DURATION_first
  FROM segk WINDOW w AS (PARTITION BY OBJECT_ID, is_zero ORDER BY {ORDER})),
"""


def _state(src: str) -> str:
    return (f"SELECT OBJECT_ID, is_zero, CAST(arg_max(PREMIUM, ({ORDER})) AS DOUBLE) AS PREVIOUS_PREMIUM, "
            f"CAST(sum(DURATION) AS BIGINT) AS TOTAL_DURATION FROM {src} GROUP BY OBJECT_ID, is_zero")


_SPLIT = f"""
train_rows AS (SELECT * FROM segk WHERE floor(START_MNTH / 12) <= 12),
test_rows AS (SELECT *, coalesce(INSURED_VALUE = 0, false) AS is_zero FROM k1_infer WHERE floor(START_MNTH / 12) > 12),
st AS ({_state('train_rows')}),
"""

ORACLE: dict[str, str] = {}

ORACLE["a1_policies"] = _sql("SELECT * FROM policies")
_CORE = ("OBJECT_ID, SEX, INSR_BEGIN, INSR_END, INSR_TYPE, INSURED_VALUE, PREMIUM, PROD_YEAR, SEATS_NUM, CCM_TON, "
         "TYPE_VEHICLE, MAKE, USAGE")
ORACLE["a1_csv_by_name"] = ORACLE["a1_policies"]
ORACLE["a2_append_store"] = ORACLE["a3_overwrite_store"] = _sql(f"SELECT {_CORE} FROM policies")
ORACLE["a7_state_versions"] = _sql(_state("segk"), _SEG_K1)
ORACLE["a9_materialised"] = _sql("SELECT * FROM k1_train")
ORACLE["c7_hand_limits"] = _sql(f"""SELECT {KEYS}, is_zero, PREMIUM, SEATS_NUM FROM segk
  WHERE PREMIUM < 5000 AND SEATS_NUM < 9 AND (is_zero OR INSURED_VALUE < 400000)""", _SEG_K1)
ORACLE["c10_plain_filter"] = _sql(f"""SELECT {KEYS}, TYPE_VEHICLE, SEATS_NUM FROM k1_train
  WHERE TYPE_VEHICLE IN ('Truck', 'Bus') AND SEATS_NUM > 5 AND INSURED_VALUE IS NOT NULL""")
ORACLE["g1_largest_premiums"] = _sql(f"SELECT {KEYS}, PREMIUM FROM k1_train ORDER BY PREMIUM DESC, {KEYS} LIMIT 100")
ORACLE["g2_slice"] = _sql(f"SELECT {KEYS}, PREMIUM FROM k1_train ORDER BY PREMIUM DESC, {KEYS} LIMIT 100 OFFSET 1000")
ORACLE["g3_union"] = _sql(f"""SELECT {KEYS}, START_MNTH, DURATION, MAKE, 'train' AS part FROM k1_train WHERE floor(START_MNTH / 12) <= 12
  UNION ALL SELECT {KEYS}, START_MNTH, DURATION, MAKE, 'later' FROM k1_infer WHERE floor(START_MNTH / 12) > 12""")
ORACLE["g6_same_rows"] = _sql("""
SELECT CAST(sum(a) AS BIGINT) AS rows_a, CAST(sum(b) AS BIGINT) AS rows_b, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS only_a,
  CAST(sum(greatest(b - a, 0)) AS BIGINT) AS only_b, sum(abs(a - b)) = 0 AS equal FROM (
  SELECT count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM (
    SELECT OBJECT_ID, START_MNTH, DURATION, PREMIUM, MAKE, 0 AS side FROM k1_train
    UNION ALL SELECT OBJECT_ID, START_MNTH, DURATION, PREMIUM, MAKE, 1 FROM k1_infer WHERE PREMIUM IS NOT NULL AND DURATION > 0) r
  GROUP BY OBJECT_ID, START_MNTH, DURATION, PREMIUM, MAKE) t""")
ORACLE["b1_month_index"] = _sql(f"""SELECT {KEYS}, INSR_BEGIN, INSR_END, {_month('INSR_BEGIN')} AS START_MNTH,
  {_month('INSR_END')} AS END_MNTH, {_month('INSR_END')} - {_month('INSR_BEGIN')} AS DURATION,
  TRY_CAST(split_part(INSR_BEGIN, '-', 3) AS INTEGER) AS BEGIN_YEAR FROM policies""")
ORACLE["b3_object_age"] = _sql(f"""SELECT {KEYS}, START_MNTH, PROD_YEAR,
  START_MNTH - (PROD_YEAR - 2000.0::DOUBLE) * 12.0::DOUBLE AS OBJECT_AGE FROM k1_train""")
ORACLE["b4_make_key"] = _sql("""SELECT MAKE, upper(replace(coalesce(MAKE, ''), ' ', '')) AS MAKE_KEY, count(*) AS n
  FROM policies GROUP BY ALL""")
ORACLE["b5_make_closure"] = _sql("""SELECT k AS MAKE_KEY, coalesce(MAKE_STD, 'UNKNOWN') AS MAKE_STD, count(*) AS n
  FROM (SELECT upper(replace(coalesce(MAKE, ''), ' ', '')) AS k FROM policies) p LEFT JOIN make_lookup ON k = MAKE_KEY GROUP BY ALL""")
ORACLE["b6_trade_plates"] = _sql(f"""SELECT {KEYS}, CCM_TON, SEATS_NUM, PROD_YEAR FROM k1_infer
  WHERE TYPE_VEHICLE = 'Trade plates'""")
ORACLE["b10_segments"] = _sql("SELECT is_zero, count(*) AS n, count(DISTINCT OBJECT_ID) AS objects FROM segk GROUP BY is_zero",
                              _SEG_K1)
ORACLE["b12_merge_chain"] = _sql(f"""SELECT is_zero, USAGE_BEFORE, USAGE, count(*) AS n FROM (
  {_merge_sql("(SELECT *, USAGE AS USAGE_BEFORE FROM segk)")}) t GROUP BY ALL""", _SEG_K1)
ORACLE["c9_temporal_split"] = _sql("""SELECT TRY_CAST(split_part(INSR_BEGIN, '-', 3) AS INTEGER) <= 12 AS is_train, count(*) AS n
  FROM policies GROUP BY ALL""")
ORACLE["f1_dedup_contracts"] = _sql(f"""SELECT {KEYS}, START_MNTH, DURATION, INSURED_VALUE, SEX, PREMIUM, INSR_TYPE
  FROM dedup""")
ORACLE["k1_base_clean_train"] = _sql("SELECT * FROM k1_train")
ORACLE["k1_base_clean_inference"] = _sql("SELECT * FROM k1_infer")
ORACLE["k1_clean_metrics"] = _sql("""
SELECT 'nans' AS stage, 'null_object_removed' AS metric, CAST(count(*) FILTER (WHERE OBJECT_ID IS NULL) AS BIGINT) AS value FROM policies
UNION ALL SELECT 'nans', 'INSR_ZERO_duration_removed', CAST(count(*) FILTER (WHERE NOT coalesce(DURATION > 0, false)) AS BIGINT) FROM months2
UNION ALL SELECT 'nans', 'rows_before_dedup', CAST(count(*) AS BIGINT) FROM months2 WHERE DURATION > 0
UNION ALL SELECT 'nans', 'rows_after_dedup', CAST(count(*) AS BIGINT) FROM dedup
UNION ALL SELECT 'nans', 'duplicates_removed', CAST((SELECT count(*) FROM months2 WHERE DURATION > 0) - count(*) AS BIGINT) FROM dedup
UNION ALL SELECT 'nans', 'trade_plates_CCM_TON_nan', CAST(count(*) FILTER (WHERE TYPE_VEHICLE = 'Trade plates' AND CCM_TON IS NULL) AS BIGINT) FROM dedup
UNION ALL SELECT 'nans', 'trade_plates_SEATS_NUM_nan', CAST(count(*) FILTER (WHERE TYPE_VEHICLE = 'Trade plates' AND SEATS_NUM IS NULL) AS BIGINT) FROM dedup
UNION ALL SELECT 'nans', 'trade_plates_prod_year_nan', CAST(count(*) FILTER (WHERE TYPE_VEHICLE = 'Trade plates' AND PROD_YEAR IS NULL) AS BIGINT) FROM dedup
UNION ALL SELECT 'nans', 'premium_nan_count', CAST(count(*) FILTER (WHERE PREMIUM IS NULL) AS BIGINT) FROM dedup
UNION ALL SELECT 'nans', 'unknown_makes', CAST(count(*) FILTER (WHERE MAKE = 'UNKNOWN') AS BIGINT) FROM k1_train""")
ORACLE["d2_impute_table"] = _sql(f"""SELECT TYPE_VEHICLE, MAKE, {", ".join(f"{c}_hit, round({c}_fill, {R}) AS {c}_fill" for c in IMPUTED)}
  FROM imp""")
ORACLE["d2_group_impute"] = _sql(f"""SELECT {KEYS}, {", ".join(f"round({c}, {R}) AS {c}" for c in IMPUTED)} FROM imputed""")
ORACLE["k3_defaults"] = _sql(f"SELECT col, round(num_value, {R}) AS num_value, text_value FROM defaults")
ORACLE["k2_full_clean_train"] = _sql(f"SELECT {_round_all(_K2_COLS_ALL)} FROM k2_train")
ORACLE["k3_default_fill"] = _sql(f"SELECT {_round_all(_K2_COLS_ALL)} FROM k2_infer")
ORACLE["e7_null_counts"] = _sql(", ".join(
    ["SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS {c}" for c, _ in K1_COLS)])
    + " FROM imputed")
ORACLE["e5_scalar_caps"] = _sql(f"SELECT is_zero, col, round(cap, {R}) AS cap FROM caps_scalar")
ORACLE["e6_type_caps"] = _sql(f"""SELECT is_zero, TYPE_VEHICLE, round(SEATS_NUM_cap, {R}) AS SEATS_NUM_cap,
  round(CCM_TON_cap, {R}) AS CCM_TON_cap FROM caps_by_type""")
ORACLE["c6_capped_rows"] = _sql(f"SELECT {KEYS}, is_zero, TYPE_VEHICLE, round(PREMIUM, {R}) AS PREMIUM FROM capped")
ORACLE["k4_outlier_stage"] = _sql(f"SELECT {KEYS}, is_zero, TYPE_VEHICLE, USAGE, SEX, INSR_TYPE FROM merged", _MERGED)
ORACLE["k4_cap_metrics"] = _sql("""
SELECT CASE WHEN is_zero THEN 'INSR_ZERO' ELSE 'ELSE' END AS segment, m.metric, m.value FROM (
  SELECT is_zero,
    CAST(count(*) AS BIGINT) AS records,
    CAST(count(*) FILTER (WHERE NOT kp) AS BIGINT) AS removed_PREMIUM,
    CAST(count(*) FILTER (WHERE kp AND NOT ki) AS BIGINT) AS removed_INSURED_VALUE,
    CAST(count(*) FILTER (WHERE kp AND ki AND NOT ks) AS BIGINT) AS removed_SEATS_NUM,
    CAST(count(*) FILTER (WHERE kp AND ki AND ks AND NOT kc) AS BIGINT) AS removed_CCM_TON,
    CAST(count(*) FILTER (WHERE kp AND ki AND ks AND kc) AS BIGINT) AS final_records
  FROM (
    SELECT k.is_zero,
      coalesce(k.PREMIUM < (SELECT cap FROM caps_scalar s WHERE s.is_zero = k.is_zero AND s.col = 'PREMIUM'), false) AS kp,
      k.is_zero OR coalesce(k.INSURED_VALUE < (SELECT cap FROM caps_scalar s WHERE NOT s.is_zero AND s.col = 'INSURED_VALUE'), false) AS ki,
      coalesce(k.SEATS_NUM < c.SEATS_NUM_cap, false) AS ks, coalesce(k.CCM_TON < c.CCM_TON_cap, false) AS kc
    FROM k2s k LEFT JOIN caps_by_type c ON k.is_zero = c.is_zero AND k.TYPE_VEHICLE = c.TYPE_VEHICLE) f
  GROUP BY is_zero) a,
LATERAL (VALUES ('records', records), ('removed_PREMIUM', removed_PREMIUM), ('removed_INSURED_VALUE', removed_INSURED_VALUE),
  ('removed_SEATS_NUM', removed_SEATS_NUM), ('removed_CCM_TON', removed_CCM_TON), ('final_records', final_records)) m(metric, value)""")
ORACLE["e9_value_counts"] = _sql("""SELECT TYPE_VEHICLE, upper(replace(coalesce(MAKE, ''), ' ', '')) AS MAKE_KEY, count(*) AS n,
  count(*) < 20 AS is_rare FROM policies GROUP BY ALL""")
ORACLE["e10_crosstab_objects"] = _sql("""SELECT TYPE_VEHICLE, USAGE, count(DISTINCT OBJECT_ID) AS objects
  FROM k1_train GROUP BY ALL""")
ORACLE["e11_box_stats"] = _sql(f"""
SELECT is_zero, TYPE_VEHICLE, n, round(min_v, {R}) AS min_v, round(q1, {R}) AS q1, round(median, {R}) AS median,
  round(q3, {R}) AS q3, round(max_v, {R}) AS max_v, outside FROM (
  SELECT b.*, (SELECT count(*) FROM k2s k WHERE k.is_zero = b.is_zero AND k.TYPE_VEHICLE = b.TYPE_VEHICLE
      AND (k.PREMIUM < b.q1 - 1.5 * (b.q3 - b.q1) OR k.PREMIUM > b.q3 + 1.5 * (b.q3 - b.q1))) AS outside
  FROM (SELECT is_zero, TYPE_VEHICLE, count(*) AS n, min(PREMIUM) AS min_v, max(PREMIUM) AS max_v,
          quantile_cont(PREMIUM, 0.25) AS q1, quantile_cont(PREMIUM, 0.5) AS median, quantile_cont(PREMIUM, 0.75) AS q3
        FROM k2s GROUP BY ALL) b) t""")
ORACLE["e12_histogram"] = _sql("""
SELECT CAST(least(floor((PROD_YEAR - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 10), 9) AS INTEGER) AS bucket,
  count(*) AS n, min(PROD_YEAR) AS bucket_min, min(lo) AS overall_min
FROM k1_train, (SELECT min(PROD_YEAR) AS lo, max(PROD_YEAR) AS hi FROM k1_train) b
WHERE PROD_YEAR IS NOT NULL GROUP BY 1""")
ORACLE["e13_object_state"] = _sql(_state("segk"), _SEG_K1)
ORACLE["e15_distinct"] = _sql("""SELECT is_zero, count(DISTINCT OBJECT_ID) AS objects, count(DISTINCT TYPE_VEHICLE) AS types,
  count(DISTINCT MAKE) AS makes FROM segk GROUP BY is_zero""", _SEG_K1)
ORACLE["e16_stage_sizes"] = _sql("""SELECT 'raw' AS stage, count(*) AS n FROM policies
  UNION ALL SELECT 'base_clean', count(*) FROM k1_train UNION ALL SELECT 'full_clean', count(*) FROM k2_train""")
ORACLE["f2_first_policies"] = _sql(f"""SELECT {KEYS}, is_zero, START_MNTH, DURATION, PREMIUM FROM hist
  WHERE POLICY_IDX = 0""", _SEG_K1, _HIST)
ORACLE["f3_policy_history"] = _sql(f"""SELECT {KEYS}, is_zero, CAST(POLICY_IDX AS BIGINT) AS POLICY_IDX, PREMIUM_prev,
  CAST(DURATION_cum AS BIGINT) AS DURATION_cum FROM hist""", _SEG_K1, _HIST)
ORACLE["n5_later_history"] = _sql(f"""SELECT {KEYS}, is_zero, PREMIUM, PREMIUM_prev AS PREVIOUS_PREMIUM,
  CAST(DURATION_cum - DURATION_first AS BIGINT) AS TOTAL_DURATION FROM hist
  WHERE POLICY_IDX >= 2 AND PREMIUM_prev IS NOT NULL""", _SEG_K1, _HIST)
ORACLE["n5_later_history_full"] = _sql(f"""SELECT {KEYS}, is_zero, PREMIUM, PREMIUM_prev AS PREVIOUS_PREMIUM,
  CAST(DURATION_cum AS BIGINT) AS TOTAL_DURATION FROM hist
  WHERE POLICY_IDX >= 1 AND PREMIUM_prev IS NOT NULL""", _SEG_K1, _HIST)
ORACLE["f5_average_ranks"] = _sql("""
SELECT is_zero, PREMIUM, cnt, CAST(below AS BIGINT) AS below, below + (cnt + 1) / 2.0 AS avg_rank FROM (
  SELECT is_zero, PREMIUM, cnt,
    sum(cnt) OVER (PARTITION BY is_zero ORDER BY PREMIUM ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt AS below
  FROM (SELECT is_zero, PREMIUM, count(*) AS cnt FROM segk WHERE PREMIUM IS NOT NULL GROUP BY ALL) v) t""", _SEG_K1)
ORACLE["n2_split_by_state"] = _sql(f"""
SELECT {", ".join("t." + k.strip() for k in KEYS.split(","))}, t.is_zero, s.OBJECT_ID IS NOT NULL AS KNOWN,
  s.PREVIOUS_PREMIUM, CAST(s.TOTAL_DURATION + t.DURATION AS BIGINT) AS TOTAL_DURATION
FROM test_rows t LEFT JOIN st s ON s.OBJECT_ID = t.OBJECT_ID AND s.is_zero = t.is_zero""", _SEG_K1, _SPLIT)
ORACLE["n3_fold_predictions"] = _sql(f"""
SELECT coalesce(s.OBJECT_ID, b.OBJECT_ID) AS OBJECT_ID, coalesce(s.is_zero, b.is_zero) AS is_zero,
  CASE WHEN b.OBJECT_ID IS NOT NULL THEN b.pp ELSE s.PREVIOUS_PREMIUM END AS PREVIOUS_PREMIUM,
  CAST(CASE WHEN b.OBJECT_ID IS NOT NULL AND s.OBJECT_ID IS NOT NULL THEN s.TOTAL_DURATION + b.sum_d
       WHEN b.OBJECT_ID IS NOT NULL THEN b.last_d ELSE s.TOTAL_DURATION END AS BIGINT) AS TOTAL_DURATION
FROM st s FULL OUTER JOIN (
  SELECT OBJECT_ID, is_zero, CAST(arg_max(PREMIUM * 1.1, ({ORDER})) AS DOUBLE) AS pp,
    arg_max(DURATION, ({ORDER})) AS last_d, sum(DURATION) AS sum_d
  FROM test_rows WHERE PREMIUM IS NOT NULL GROUP BY ALL) b
ON s.OBJECT_ID = b.OBJECT_ID AND s.is_zero = b.is_zero""", _SEG_K1, _SPLIT)
ORACLE["n4_update_with_labels"] = _sql(f"""
SELECT coalesce(s.OBJECT_ID, b.OBJECT_ID) AS OBJECT_ID, coalesce(s.is_zero, b.is_zero) AS is_zero,
  CASE WHEN b.OBJECT_ID IS NOT NULL THEN b.pp ELSE s.PREVIOUS_PREMIUM END AS PREVIOUS_PREMIUM,
  CAST(CASE WHEN b.OBJECT_ID IS NOT NULL THEN b.d ELSE s.TOTAL_DURATION END AS BIGINT) AS TOTAL_DURATION
FROM st s FULL OUTER JOIN (
  SELECT OBJECT_ID, is_zero, CAST(arg_max(PREMIUM, ({ORDER})) AS DOUBLE) AS pp, arg_max(DURATION, ({ORDER})) AS d
  FROM test_rows WHERE PREMIUM IS NOT NULL GROUP BY ALL) b
ON s.OBJECT_ID = b.OBJECT_ID AND s.is_zero = b.is_zero""", _SEG_K1, _SPLIT)
ORACLE["i1_kruskal_h"] = _sql(f"""
SELECT t.is_zero, t.col, k.k, t.N, round(CASE WHEN t.N > 1 AND 1 - t.ties / (power(t.N::DOUBLE, 3) - t.N) <> 0 THEN
  (12.0 / (t.N::DOUBLE * (t.N + 1)) * k.s - 3 * (t.N + 1)) / (1 - t.ties / (power(t.N::DOUBLE, 3) - t.N)) END, {R}) AS H
FROM tests t JOIN ks k USING (is_zero, col)""", _SEG_K1, _LONG)
ORACLE["i2_dunn_z"] = _sql(f"SELECT is_zero, col, a, b, round(z, {R}) AS z FROM dunn", _SEG_K1, _LONG)
ORACLE["i4_mann_whitney_u"] = _sql(f"""SELECT is_zero, col, a, b, n_a, n_b, round(U1, {R}) AS U1,
  round(2.0 * U1 / (n_a::DOUBLE * n_b) - 1.0, {R}) AS cliff_delta FROM mw""", _SEG_K1, _LONG)


def _erfc(x: str) -> str:
    """erfc by the series of erf; beyond 6 it is below every rounding here.  ``x`` may be negative."""
    series = (f"list_sum(list_transform(range(0, 160), lambda i: CASE WHEN i % 2 = 0 THEN 1.0 ELSE -1.0 END * "
              f"exp((2 * i + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(i + 1.0)) / (2 * i + 1)))")
    return (f"CASE WHEN abs({x}) > 6 THEN (CASE WHEN {x} > 0 THEN 0.0 ELSE 2.0 END) "
            f"ELSE 1.0 - sign({x}) * 2.0 / sqrt(pi()) * {series} END")


_TWO = lambda z: f"least(1.0, {_erfc(f'(abs({z}) / sqrt(2.0))')})"
_UPPER = lambda z: f"least(1.0, greatest(0.0, {_erfc(f'({z} / sqrt(2.0))')}))"
#: Upper tail of a chi-square with k - 1 degrees of freedom: a Poisson sum, or erfc and a sum of half-integer terms.
_CHI2 = f"""CASE WHEN H IS NULL OR k < 2 THEN NULL WHEN H <= 0 THEN 1.0
  WHEN (k - 1) % 2 = 0 THEN exp(-H / 2) * list_sum(list_transform(range(0, (k - 1) // 2), lambda i: exp(i * ln(H / 2) - lgamma(i + 1.0))))
  ELSE {_erfc("sqrt(H / 2)")} + exp(-H / 2) * coalesce(list_sum(list_transform(range(1, (k - 2) // 2 + 1),
    lambda i: exp((i - 0.5) * ln(H / 2) - lgamma(i + 0.5)))), 0) END"""
_MW_Z = """
mw_ties AS (SELECT is_zero, col, a, b, sum(power(cnt::DOUBLE, 3) - cnt) AS ties FROM pair_ranks GROUP BY ALL),
mwz AS (
  SELECT m.*, (greatest(U1, n_a::DOUBLE * n_b - U1) - n_a::DOUBLE * n_b / 2.0 - 0.5)
    / sqrt(n_a::DOUBLE * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS z
  FROM mw m JOIN mw_ties t USING (is_zero, col, a, b)),
"""
ORACLE["i1_kruskal_p"] = _sql(f"SELECT is_zero, col, k, N, round(H, {R}) AS H, round({_CHI2}, {R}) AS p FROM (" + f"""
SELECT t.is_zero, t.col, k.k, t.N, CASE WHEN t.N > 1 AND 1 - t.ties / (power(t.N::DOUBLE, 3) - t.N) <> 0 THEN
  (12.0 / (t.N::DOUBLE * (t.N + 1)) * k.s - 3 * (t.N + 1)) / (1 - t.ties / (power(t.N::DOUBLE, 3) - t.N)) END AS H
FROM tests t JOIN ks k USING (is_zero, col)) h""", _SEG_K1, _LONG)
_DUNN_P = f"""
dunn_p AS (
  SELECT d.*, {_TWO("z")} AS p, least(1.0, {_TWO("z")} * k.k * (k.k - 1) / 2.0) AS p_adj FROM dunn d JOIN ks k USING (is_zero, col)),
"""
ORACLE["i2_dunn_p"] = _sql(f"SELECT is_zero, col, a, b, round(z, {R}) AS z, round(p, {R}) AS p, round(p_adj, {R}) AS p_adj FROM dunn_p",
                           _SEG_K1, _LONG, _DUNN_P)
ORACLE["i4_mann_whitney_p"] = _sql(f"""SELECT is_zero, col, a, b, round(U1, {R}) AS U1, round(z, {R}) AS z, round({_UPPER("z")}, {R}) AS p,
  round(2.0 * U1 / (n_a::DOUBLE * n_b) - 1.0, {R}) AS cliff_delta FROM mwz""", _SEG_K1, _LONG, _MW_Z)
ORACLE["i6_similar_categories"] = _sql(f"""SELECT is_zero, col, CAST(row_number() OVER (PARTITION BY is_zero, col
    ORDER BY try_cast(CASE WHEN col = 'SEX' THEN a END AS DOUBLE), a, try_cast(CASE WHEN col = 'SEX' THEN b END AS DOUBLE), b) - 1 AS INTEGER) AS seq,
  a AS old, b AS new FROM dunn_p JOIN mwz m USING (is_zero, col, a, b) WHERE p_adj > 0.9 AND {_UPPER("m.z")} > 0.5""",
                                       _SEG_K1, _LONG, _DUNN_P, _MW_Z)
ORACLE["j1_transactions"] = _sql(f"""SELECT is_zero, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _ITEMS)}, count(*) AS cnt
  FROM segk GROUP BY ALL""", _SEG_K1)
_MINED = _itemsets(0.01)
ORACLE["j2_frequent_itemsets"] = _sql(f"SELECT is_zero, mask, {', '.join(_ITEMS)}, cnt, support, size FROM itemsets",
                                      _SEG_K1, _MINED)
ORACLE["j3_rules"] = _sql(f"""SELECT is_zero, antecedents, consequent, round(antecedent_support, {R}) AS antecedent_support,
  round(consequent_support, {R}) AS consequent_support, round(support, {R}) AS support,
  round(confidence, {R}) AS confidence, round(lift, {R}) AS lift FROM rules WHERE confidence >= 0.5""", _SEG_K1, _MINED)
ORACLE["j7_perfect_rules"] = _sql(f"""SELECT is_zero, antecedents, consequent, round(support, {R}) AS support FROM rules
  WHERE confidence = 1.0""", _SEG_K1, _MINED)
ORACLE["j5_rule_misses"] = _sql(" UNION ALL ".join(
    f"SELECT '{f.split('_', 2)[2].rsplit('_', 1)[0]}' AS segment, {int(f.rsplit('_', 1)[1])} AS seq, "
    f"CAST(count(*) FILTER (WHERE {f}) AS BIGINT) AS misses FROM {_RULES_LAST}" for f in _RULE_FLAGS),
    _MERGED, _RULES_ON_MERGED)
ORACLE["j6_rule_corrected"] = _sql(f"SELECT {KEYS}, is_zero, USAGE, TYPE_VEHICLE, INSR_TYPE FROM {_RULES_LAST}",
                                   _MERGED, _RULES_ON_MERGED)
_K7_COLS = _K2_COLS_ALL + [("is_zero", "boolean")]
ORACLE["k7_transform_train"] = _sql(f"SELECT {_round_all(_K7_COLS)} FROM {_RULES_LAST}", _MERGED, _RULES_ON_MERGED)
ORACLE["l1_make_frequency"] = _sql(f"""SELECT MAKE, round(count(*) / sum(count(*)) OVER (), {R}) AS freq
  FROM k2_train GROUP BY MAKE""")
ORACLE["l2_sex_ordinal"] = _sql(f"""SELECT SEX, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS code FROM (
  SELECT SEX, min((OBJECT_ID, START_MNTH, DURATION, {TIE_ASC})) AS f FROM k2_train GROUP BY SEX) t""")
ORACLE["l3_insr_onehot"] = _sql(f"""SELECT {KEYS}, INSR_TYPE AS INSR_TYPE_RAW,
  {", ".join(f"CAST(INSR_TYPE = {v} AS DOUBLE) AS INSR_TYPE_{v}" for v in (1201, 1202, 1204))} FROM k2_train""")
ORACLE["l4_target_encoding"] = _sql(f"""
SELECT col, value, n, round(mean, {R}) AS mean, round(prior, {R}) AS prior,
  round(prior * (1 - 1.0 / (1.0 + exp(-(n - 20) / 10.0))) + mean * (1.0 / (1.0 + exp(-(n - 20) / 10.0))), {R}) AS encoded
FROM (
  SELECT 'TYPE_VEHICLE' AS col, TYPE_VEHICLE AS value, count(*) AS n, avg(PREMIUM) AS mean,
    (SELECT avg(PREMIUM) FROM k2_train) AS prior FROM k2_train GROUP BY TYPE_VEHICLE
  UNION ALL
  SELECT 'USAGE', USAGE, count(*), avg(PREMIUM), (SELECT avg(PREMIUM) FROM k2_train) FROM k2_train GROUP BY USAGE) t""")
_SCALED = ["SEATS_NUM", "CCM_TON", "DURATION", "OBJECT_AGE", "INSURED_VALUE"]
ORACLE["l6_standard_scaling"] = _sql(f"""SELECT {KEYS}, {", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, {R}) AS {c}"
    for c in _SCALED)} FROM k2_train""")
_SMOOTH = ("prior * (1 - 1.0 / (1.0 + exp(-(n - 20) / 10.0))) + mean * (1.0 / (1.0 + exp(-(n - 20) / 10.0)))")
_ENCODED = f"""
enc AS (
  SELECT k.*, f.freq AS MAKE_FREQ, x.code AS SEX_LABEL, t.e AS TYPE_VEHICLE_TARGET, u.e AS USAGE_TARGET,
    {", ".join(f"CAST(INSR_TYPE = {v} AS DOUBLE) AS INSR_TYPE_{v}" for v in (1201, 1202, 1204))}
  FROM k2_train k
  JOIN (SELECT MAKE, count(*) / (SELECT count(*) FROM k2_train) AS freq FROM k2_train GROUP BY MAKE) f ON f.MAKE = k.MAKE
  JOIN (SELECT SEX, CAST(row_number() OVER (ORDER BY min((OBJECT_ID, START_MNTH, DURATION, {TIE_ASC}))) AS DOUBLE) AS code
        FROM k2_train GROUP BY SEX) x ON x.SEX = k.SEX
  JOIN (SELECT TYPE_VEHICLE, {_SMOOTH} AS e FROM (SELECT TYPE_VEHICLE, count(*) AS n, avg(PREMIUM) AS mean,
        (SELECT avg(PREMIUM) FROM k2_train) AS prior FROM k2_train GROUP BY ALL) a) t ON t.TYPE_VEHICLE = k.TYPE_VEHICLE
  JOIN (SELECT USAGE, {_SMOOTH} AS e FROM (SELECT USAGE, count(*) AS n, avg(PREMIUM) AS mean,
        (SELECT avg(PREMIUM) FROM k2_train) AS prior FROM k2_train GROUP BY ALL) a) u ON u.USAGE = k.USAGE),
insr AS (
  SELECT INSR_TYPE, row_number() OVER (ORDER BY min((OBJECT_ID, START_MNTH, DURATION, {TIE_ASC}))) AS pos
  FROM k2_train GROUP BY INSR_TYPE),
"""
_ENC_COLS = ["MAKE_FREQ", "SEX_LABEL", "TYPE_VEHICLE_TARGET", "USAGE_TARGET", "INSR_TYPE_1201", "INSR_TYPE_1202", "INSR_TYPE_1204"]
ORACLE["l5_encoded"] = _sql(f"SELECT {KEYS}, {', '.join(f'round({c}, {R}) AS {c}' for c in _ENC_COLS)} FROM enc", _ENCODED)
_MODEL_COLS = ["INSURED_VALUE", "SEATS_NUM", "CCM_TON", "DURATION", "OBJECT_AGE", "MAKE_FREQ", "SEX_LABEL",
               "TYPE_VEHICLE_TARGET", "USAGE_TARGET"]
ORACLE["l7_features"] = _sql(" UNION ALL ".join(
    [f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, round(avg({c}), {R}) AS mean, round(stddev_pop({c}), {R}) AS std FROM enc"
     for i, c in enumerate(_MODEL_COLS)] +
    [f"SELECT CAST({len(_MODEL_COLS)} + (SELECT pos - 1 FROM insr WHERE INSR_TYPE = {v}) AS INTEGER), 'INSR_TYPE_{v}', "
     f"round(avg(INSR_TYPE_{v}), {R}), round(stddev_pop(INSR_TYPE_{v}), {R}) FROM enc" for v in (1201, 1202, 1204)]), _ENCODED)
_SEG_K2 = "segk AS (SELECT *, coalesce(INSURED_VALUE = 0, false) AS is_zero FROM k2_train),"
ORACLE["m7_lag_baseline_metrics"] = _sql(f"""
SELECT is_zero, count(*) AS n, round(sqrt(avg(power(PREMIUM - PREMIUM_prev, 2))), {R}) AS rmse,
  round(avg(abs(PREMIUM - PREMIUM_prev)), {R}) AS mae,
  round(1 - sum(power(PREMIUM - PREMIUM_prev, 2)) / (count(*) * var_pop(PREMIUM)), {R}) AS r2,
  round(avg(CASE WHEN PREMIUM <> 0 THEN abs((PREMIUM - PREMIUM_prev) / PREMIUM) END) * 100, {R}) AS mape
FROM hist WHERE POLICY_IDX >= 1 AND PREMIUM_prev IS NOT NULL GROUP BY is_zero""", _SEG_K2, _HIST)
ORACLE["n1_state_from_transform"] = _sql(f"""
SELECT is_zero, OBJECT_ID, round(PREVIOUS_PREMIUM, {R}) AS PREVIOUS_PREMIUM, TOTAL_DURATION FROM ({_state(_RULES_LAST)}) s""",
                                         _MERGED, _RULES_ON_MERGED)


def _body(name: str, *extra: str) -> str:
    prefix = _with(*extra).rstrip().rstrip(",")
    return ORACLE[name][len(prefix) + 1:]


_IMPUTE_COUNTS = " UNION ALL ".join(
    f"SELECT 'nans' AS stage, '{c}_imputed' AS metric, CAST(count(*) FILTER (WHERE {_MISSING[c].format(c=c)}) AS BIGINT) "
    f"AS value FROM k1_train" for c in IMPUTED)
_REMAINING = " UNION ALL ".join(
    f"SELECT 'remaining_nans' AS stage, '{c}' AS metric, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS value "
    f"FROM imputed" for c, _ in K1_COLS)
ORACLE["k8_quality_report"] = _sql(f"""
SELECT stage, metric, value FROM ({_body("k1_clean_metrics")}) a
UNION ALL SELECT stage, metric, value FROM ({_IMPUTE_COUNTS}) b
UNION ALL SELECT stage, metric, value FROM ({_REMAINING}) c
UNION ALL SELECT 'outliers' AS stage, segment || '_' || metric AS metric, value FROM ({_body("k4_cap_metrics")}) d
UNION ALL SELECT 'apriori' AS stage, segment || '_' || CAST(seq AS VARCHAR) AS metric, misses AS value
  FROM ({_body("j5_rule_misses", _MERGED, _RULES_ON_MERGED)}) e""", _MERGED, _RULES_ON_MERGED)

# Inference transform of a batch without PREMIUM: defaults filled, no PREMIUM cap.
_INFER_CAPPED = """
k2i AS (SELECT * EXCLUDE (PREMIUM), coalesce(INSURED_VALUE = 0, false) AS is_zero FROM k2_infer),
capped_i AS (
  SELECT k.* FROM k2i k JOIN caps_by_type c ON k.is_zero = c.is_zero AND k.TYPE_VEHICLE = c.TYPE_VEHICLE
  WHERE (k.is_zero OR coalesce(k.INSURED_VALUE < (SELECT cap FROM caps_scalar s WHERE NOT s.is_zero AND s.col = 'INSURED_VALUE'), false))
    AND coalesce(k.SEATS_NUM < c.SEATS_NUM_cap, false) AND coalesce(k.CCM_TON < c.CCM_TON_cap, false)),"""
_MERGED_I = f"merged_i AS ({_merge_sql('capped_i')}),"
_RULES_I, _RULES_I_LAST, _ = _rules_ctes("merged_i")
_RULES_I = _RULES_I.replace("rule_", "rule_i_")
_RULES_I_LAST = _RULES_I_LAST.replace("rule_", "rule_i_")
_K7I_COLS = [c for c in _K7_COLS if c[0] != "PREMIUM"]
ORACLE["k7_transform_inference"] = _sql(f"SELECT {_round_all(_K7I_COLS)} FROM {_RULES_I_LAST}",
                                        _INFER_CAPPED, _MERGED_I, _RULES_I)

# --- Queries of covera/plans/catalog_stores.py -------------------------------------------------------
ORACLE["a1_csv_clashing_cells"] = ORACLE["a1_policies"]
ORACLE["a5_routes"] = _sql("""SELECT 'labelled' AS batch, 'store' AS route, count(*) AS n FROM policies
  UNION ALL SELECT 'unlabelled', 'predict', count(*) FROM policies""")
ORACLE["a6_saved_processor"] = ORACLE["k7_transform_train"]
ORACLE["a8_saved_models"] = _sql(f"""SELECT {KEYS}, true AS same FROM policies
  WHERE TRY_CAST(split_part(INSR_BEGIN, '-', 3) AS INTEGER) > 12""")
ORACLE["a7_state_runs"] = ORACLE["n3_fold_predictions"]

_NULLS = "NULL::VARCHAR AS text"
_FIT_CONFIDENCE = 0.5
ORACLE["k6_fit"] = _sql(" UNION ALL ".join([
    *[f"SELECT 'impute' AS lookup, concat_ws('|', TYPE_VEHICLE, MAKE, '{c}') AS key, round({c}_fill, {R}) AS value, {_NULLS} FROM imp WHERE {c}_hit"
      for c in IMPUTED],
    f"SELECT 'cap', concat_ws('|', CAST(is_zero AS VARCHAR), col), round(cap, {R}), NULL FROM caps_scalar",
    *[f"SELECT 'type_cap', concat_ws('|', CAST(is_zero AS VARCHAR), TYPE_VEHICLE, '{c}'), round({c}_cap, {R}), NULL FROM caps_by_type"
      for c in ("SEATS_NUM", "CCM_TON")],
    f"SELECT 'default', col, round(num_value, {R}), text_value FROM defaults",
    """SELECT 'merge', concat_ws('|', CAST(is_zero AS VARCHAR), col, CAST(row_number() OVER (PARTITION BY is_zero, col
    ORDER BY try_cast(CASE WHEN col = 'SEX' THEN a END AS DOUBLE), a, try_cast(CASE WHEN col = 'SEX' THEN b END AS DOUBLE), b) - 1 AS VARCHAR)),
    NULL, a || ' > ' || b FROM dunn_p JOIN mwz m USING (is_zero, col, a, b) WHERE p_adj > 0.9 AND """ + f"{_UPPER('m.z')} > 0.5",
    f"""SELECT 'rule', concat_ws('|', CAST(is_zero AS VARCHAR), antecedents, consequent), round(confidence, {R}), NULL
  FROM rules WHERE confidence >= {_FIT_CONFIDENCE}"""]), _SEG_K1, _LONG, _DUNN_P, _MW_Z, _itemsets(0.1))
ORACLE["k6_incremental_fit"] = ORACLE["k6_fit"]

_WIDE = {"USAGE": "USAGE", "TYPE_VEHICLE": "TYPE_VEHICLE", "MAKE": "MAKE", "SEX": "CAST(SEX AS VARCHAR)",
         "INSR_TYPE": "CAST(INSR_TYPE AS VARCHAR)", "SEATS": "CAST(CAST(SEATS_NUM AS INTEGER) AS VARCHAR)",
         "MONTHS": "CAST(DURATION AS VARCHAR)", "LITRES": "CAST(CAST(floor(CCM_TON / 1000) AS INTEGER) AS VARCHAR)",
         "DECADE": "CAST(CAST(floor(PROD_YEAR / 10) AS INTEGER) AS VARCHAR)", "MONTH": "CAST(START_MNTH % 12 AS VARCHAR)",
         "THOUSANDS": "CAST(CAST(floor(PREMIUM / 1000) AS INTEGER) AS VARCHAR)",
         "HALF": "CASE WHEN START_MNTH % 12 < 6 THEN '1' ELSE '2' END"}
# Level by level: a set grows by items that come after its last one, and only if it is frequent.
_WIDE_SETS = f"""
wide_rows AS MATERIALIZED (
  SELECT is_zero, row_number() OVER () AS rid, list_sort(list_filter([{", ".join(f"'{c}=' || {e}" for c, e in _WIDE.items())}], lambda x: x IS NOT NULL)) AS items
  FROM segk),
wide_n AS MATERIALIZED (SELECT is_zero, count(*) AS n FROM wide_rows GROUP BY is_zero),
wide_frequent AS MATERIALIZED (
  SELECT t.is_zero, t.item FROM (SELECT is_zero, unnest(items) AS item FROM wide_rows) t JOIN wide_n w USING (is_zero)
  GROUP BY t.is_zero, t.item, w.n HAVING count(*) >= 0.1 * w.n),
wide_baskets AS MATERIALIZED (
  SELECT is_zero, items, count(*) AS c FROM (
    SELECT r.is_zero, r.rid, list(f.item ORDER BY f.item) AS items FROM (SELECT is_zero, rid, unnest(items) AS item FROM wide_rows) r
    JOIN wide_frequent f ON f.is_zero = r.is_zero AND f.item = r.item GROUP BY ALL) b GROUP BY ALL),
wide_subsets AS MATERIALIZED (
  SELECT is_zero, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items, sum(c) AS cnt
  FROM wide_baskets, unnest(range(1, CAST(power(2, len(items)) AS BIGINT))) AS s(m) GROUP BY ALL),
wide_sets AS MATERIALIZED (
  SELECT s.is_zero, s.items, CAST(s.cnt AS BIGINT) AS cnt, s.cnt / w.n AS support FROM wide_subsets s JOIN wide_n w USING (is_zero)
  WHERE s.cnt >= 0.1 * w.n),
"""
ORACLE["j2_wide_itemsets"] = _sql(f"""SELECT is_zero, array_to_string(items, ', ') AS items, cnt, round(support, {R}) AS support
FROM wide_sets""", _SEG_K1, _WIDE_SETS)
ORACLE["j3_wide_rules"] = _sql(f"""SELECT w.is_zero, array_to_string(w.a_items, ', ') AS antecedents, array_to_string(w.c_items, ', ') AS consequent,
  round(a.support, {R}) AS antecedent_support, round(c.support, {R}) AS consequent_support, round(w.support, {R}) AS support,
  round(w.cnt / a.cnt, {R}) AS confidence, round(w.cnt / a.cnt / c.support, {R}) AS lift
FROM (SELECT is_zero, cnt, support, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS a_items,
        list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) AS c_items
      FROM wide_sets, unnest(range(1, CAST(power(2, len(items)) - 1 AS BIGINT))) AS s(m) WHERE len(items) >= 2) w
JOIN wide_sets a ON a.is_zero = w.is_zero AND a.items = w.a_items
JOIN wide_sets c ON c.is_zero = w.is_zero AND c.items = w.c_items
WHERE w.cnt / a.cnt >= 0.6""", _SEG_K1, _WIDE_SETS)

ORACLE["e6_sketch_quantiles"] = _sql("""SELECT is_zero, TYPE_VEHICLE, q, count(*) AS n, true AS "within"
FROM segk, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS q) asked WHERE TYPE_VEHICLE IS NOT NULL GROUP BY ALL""", _SEG_K1)

# Ways to choose k of the ranks 1 to i with a given sum, by one rank more at a time.
ORACLE["i4_mann_whitney_exact"] = "WITH RECURSIVE " + _sql(f"""
SELECT month, a, b, n_a, n_b, round(U1, {R}) AS U1, exact, round(CASE WHEN exact THEN (
    SELECT least(1.0, 2.0 * sum(w.ways) FILTER (WHERE w.s - m * (m + 1) / 2 >= most) / sum(w.ways)) FROM ways w
    WHERE w.i = total AND w.k = m) END, {R}) AS p
FROM (SELECT *, least(n_a, n_b) AS m, n_a + n_b AS total, greatest(U1, n_a * n_b - U1) AS most FROM tested) t""", """
small AS MATERIALIZED (
  SELECT START_MNTH AS month, TYPE_VEHICLE AS t, MAKE, PREMIUM AS v FROM k1_train
  WHERE TYPE_VEHICLE IN ('Truck', 'Bus') AND PREMIUM IS NOT NULL),
counted AS MATERIALIZED (
  SELECT month, MAKE, count(*) FILTER (WHERE t = 'Truck') AS n_a, count(*) FILTER (WHERE t = 'Bus') AS n_b,
    count(*) = count(DISTINCT v) AS untied FROM small GROUP BY ALL),
wins AS MATERIALIZED (
  SELECT x.month, x.MAKE, sum(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0.0 END) AS U1
  FROM small x JOIN small y ON x.month = y.month AND x.MAKE = y.MAKE AND x.t = 'Truck' AND y.t = 'Bus' GROUP BY ALL),
tested AS MATERIALIZED (
  SELECT month, 'Truck/' || MAKE AS a, 'Bus/' || MAKE AS b, n_a, n_b, CAST(U1 AS DOUBLE) AS U1, least(n_a, n_b) <= 8 AND untied AS exact
  FROM counted JOIN wins USING (month, MAKE) WHERE n_a > 0 AND n_b > 0),
most_ranks AS MATERIALIZED (SELECT coalesce(max(n_a + n_b) FILTER (WHERE exact), 0) AS n FROM tested),
ways(i, k, s, ways) AS (
  SELECT 0, 0, 0, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, k + taken, s + taken * (i + 1), sum(ways) FROM ways, (SELECT unnest([0, 1]) AS taken) c, most_ranks
  WHERE i < n AND k + taken <= 8 GROUP BY i + 1, k + taken, s + taken * (i + 1)),
""")[len("WITH "):]
