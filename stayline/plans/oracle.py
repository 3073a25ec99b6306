"""For each registered query, SQL for another engine with the same columns and rows."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# ---------------------------------------------------------------- shared parts

COHORT = """
coded AS (
  SELECT p_partkey, lpad(regexp_extract(p_brand, '[0-9]+'), 3, '0') || '.' || p_partkey AS icd9_code,
         p_type AS short_title, p_name AS long_title
  FROM part),
dx AS (
  SELECT DISTINCT o_custkey AS subject_id, l_orderkey AS hadm_id, icd9_code, short_title
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN coded ON l_partkey = p_partkey
  WHERE regexp_matches(icd9_code, '^[0-9]{3}') AND CAST(substr(icd9_code, 1, 3) AS INTEGER) BETWEEN 10 AND 20
    AND (long_title ILIKE '%gear%' OR long_title ILIKE '%anvil%')),
stays AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS icustay_id, o_orderdate AS intime, outtime
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS outtime FROM lineitem GROUP BY 1) e
    ON o_orderkey = l_orderkey),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY intime, icustay_id) AS rn FROM stays),
patients AS (
  SELECT c_custkey AS subject_id, c_mktsegment AS gender,
         TIMESTAMP '1925-01-01' + CAST(floor(c_acctbal * 3) AS INTEGER) * INTERVAL 1 DAY AS dob, dod
  FROM customer LEFT JOIN (
    SELECT o_custkey, min(l_shipdate) AS dod FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R' AND l_quantity >= 30 GROUP BY 1) d ON c_custkey = o_custkey),
cohort AS (
  SELECT f.subject_id, f.hadm_id, f.icustay_id, dx.icd9_code, dx.short_title, f.intime, f.outtime,
         p.gender, p.dob, p.dod, o.o_orderdate AS admittime, o.o_orderpriority AS ethnicity,
         o.o_orderstatus AS marital_status, o.o_orderstatus AS insurance, o.o_orderpriority AS admission_type,
         CAST(floor((epoch_us(o.o_orderdate) - epoch_us(p.dob)) / 31557600000000.0) AS BIGINT) AS age,
         CASE WHEN p.dod IS NOT NULL AND date_part('day', p.dod - o.o_orderdate) <= 30 THEN 1 ELSE 0 END
           AS mortality_30d
  FROM ranked f JOIN dx ON f.subject_id = dx.subject_id AND f.hadm_id = dx.hadm_id
    JOIN orders o ON o.o_orderkey = f.hadm_id AND o.o_custkey = f.subject_id
    JOIN patients p ON p.subject_id = f.subject_id
  WHERE f.rn = 1 AND epoch_us(f.outtime) - epoch_us(f.intime) <= 1800 * 86400000000
    AND floor((epoch_us(o.o_orderdate) - epoch_us(p.dob)) / 31557600000000.0) BETWEEN 18 AND 89)
"""

STARTS = "starts AS (SELECT user_id, min(ts) AS intime FROM events GROUP BY 1)"
WINDOW = f"""
{STARTS},
win AS (
  SELECT event_id, e.user_id, event_type, ts, value, intime
  FROM events e JOIN starts s ON e.user_id = s.user_id
  WHERE value IS NOT NULL AND ts BETWEEN intime AND intime + INTERVAL 48 HOUR)
"""


def series(source: str, entity: str, label: str, time: str, value: str) -> str:
    """Mean, min, max, slope per (entity, label); times count from the entity's first reading."""
    hours = f"(epoch_us({time}) - t0) / 3.6e9"
    return f"""
      SELECT {entity}, {label}, avg({value}) AS mean, min({value}) AS min, max({value}) AS max,
             CASE WHEN count(*) = 1 THEN NULL WHEN min({time}) = max({time}) THEN 0.0
                  ELSE regr_slope({value}, {hours}) END AS slope
      FROM (SELECT *, min(epoch_us({time})) OVER (PARTITION BY {entity}) AS t0 FROM {source}) x
      GROUP BY {entity}, {label}"""


def digits(stat: str) -> int:
    return 4 if stat == "slope" else 6


LONG_VALUE = f"CASE WHEN feature LIKE 'slope%' THEN {r('value', 4)} ELSE {r('value')} END"


def wide(long: str, entity: str, label: str, labels: list[str], rounding: bool = False) -> str:
    cells = []
    for stat in ("mean", "min", "max", "slope"):
        for name in labels:
            cell = f"max(CASE WHEN {label} = '{name}' THEN {stat} END)"
            cells.append(f"{r(cell, digits(stat)) if rounding else cell} AS {stat}_{name}")
    return f"SELECT {entity}, {', '.join(cells)} FROM ({long}) l GROUP BY {entity}"


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
WINDOW_LONG = series("win", "user_id", "event_type", "ts", "value")
WINDOW_WIDE = wide(WINDOW_LONG, "user_id", "event_type", EVENT_TYPES)
HISTORY_LONG = series("events", "user_id", "event_type", "ts", "value")
STATS = ("mean", "min", "max", "slope")
LEFT = [f"{s}_{n}" for s in STATS for n in EVENT_TYPES]
RIGHT = LEFT
MERGED_NAMES = [(f"w.{c}", f"{c}_x" if c in RIGHT else c) for c in LEFT] + [(f"h.{c}", f"{c}_y") for c in RIGHT]
MERGED_COLUMNS = ", ".join(f"{source} AS {name}" for source, name in MERGED_NAMES)
MERGED = f"""
{WINDOW},
merged AS (
  SELECT c_custkey, c_acctbal, {MERGED_COLUMNS}
  FROM (SELECT * FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) c
  LEFT JOIN ({WINDOW_WIDE}) w ON w.user_id = c_custkey
  LEFT JOIN ({wide(HISTORY_LONG, "user_id", "event_type", EVENT_TYPES)}) h ON h.user_id = c_custkey)
"""
MERGED_FEATURES = ["c_acctbal", *[name for _, name in MERGED_NAMES]]
MERGED_ALL = ["c_custkey", *MERGED_FEATURES]


def union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("@", name) for name in names)


def hashed(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


TEST_CUT = int(0.2 * (1 << 60))


PARTS = """
raw AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(length(p_name) AS DOUBLE) AS name_length
  FROM part),
parts AS (
  SELECT p_partkey, (p_size - 25.0) / 14.0 AS p_size, (p_retailprice - 1400.0) / 300.0 AS p_retailprice,
         (name_length - 10.0) / 2.0 AS name_length
  FROM raw),
scored AS (
  SELECT *, -0.2 + 0.8 * p_size - 0.5 * p_retailprice + 0.3 * name_length AS margin FROM parts)
"""
PROBABILITY = "1.0 / (1.0 + exp(-margin))"
LINEAR = f"""
{PARTS},
shap AS (
  SELECT p_partkey, 'p_size' AS feature, p_size AS value, 0.8 * (p_size - 0.1) AS shap FROM parts
  UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, -0.5 * p_retailprice FROM parts
  UNION ALL SELECT p_partkey, 'name_length', name_length, 0.3 * (name_length + 0.2) FROM parts),
ordered AS (
  SELECT *, CAST(-0.2 + 0.8 * 0.1 - 0.3 * 0.2 AS DOUBLE) AS base_value,
         row_number() OVER (PARTITION BY p_partkey ORDER BY abs(shap) DESC, feature) AS rank FROM shap),
totals AS (SELECT p_partkey, sum(shap) AS shap_total FROM shap GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
importance AS (SELECT feature, avg(abs(shap)) AS mean_abs_shap FROM shap GROUP BY 1)
"""
DOCS = "docs AS (SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id))"

# ---------------------------------------------------------------- sources

ORACLE["pk_violations"] = """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows,
       count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL OR l_shipdate IS NULL) AS n_null_rows
FROM lineitem GROUP BY 1, 2 HAVING n_rows > 1 OR n_null_rows > 0"""
ORACLE["csv_roundtrip"] = "SELECT * FROM orders"
ORACLE["parquet_roundtrip"] = "SELECT * FROM events"
ORACLE["sql_passthrough"] = """
SELECT r_name, count(*) AS n_customers, round(max(c_acctbal), 6) AS max_balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""

# ---------------------------------------------------------------- cohort

ORACLE["dx_code_filter"] = f"WITH {COHORT} SELECT subject_id, hadm_id, icd9_code, short_title FROM dx"
ORACLE["first_stay"] = """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) x
WHERE rn = 1"""
ORACLE["short_stay"] = f"WITH {COHORT} SELECT * FROM stays WHERE outtime - intime <= INTERVAL 1800 DAY"
ORACLE["cohort_full"] = f"WITH {COHORT} SELECT * FROM cohort"

# ---------------------------------------------------------------- windows

ORACLE["window_48h_entity_key"] = f"WITH {WINDOW} SELECT * FROM win"
ORACLE["window_48h_admission_key"] = """
SELECT event_id, e.user_id, e.event_type, ts, value, intime
FROM events e JOIN (SELECT user_id, event_type, min(ts) AS intime FROM events GROUP BY 1, 2) s
  ON e.user_id = s.user_id AND e.event_type = s.event_type
WHERE value IS NOT NULL AND ts BETWEEN intime AND intime + INTERVAL 48 HOUR"""
ORACLE["window_day_granularity"] = f"""
WITH {STARTS}
SELECT event_id, e.user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS ts, value, intime
FROM events e JOIN starts s ON e.user_id = s.user_id
WHERE value IS NOT NULL AND date_trunc('day', ts) BETWEEN intime AND intime + INTERVAL 48 HOUR"""
ORACLE["window_with_dictionary"] = f"""
WITH {WINDOW}
SELECT user_id, event_id, ts, value, c_nationkey AS itemid, n_name AS label, n_regionkey AS category
FROM win JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
ORACLE["extract_labs_window"] = f"""
WITH {COHORT}
SELECT c.subject_id, c.hadm_id, c.icustay_id, c.icd9_code, c.short_title, l_linenumber AS itemid,
       n_name AS labs_label, 'Blood' AS fluid, CAST(n_regionkey AS VARCHAR) AS labs_category,
       l_shipdate AS charttime, l_extendedprice AS labs_valuenum, l_returnflag AS labs_valueom, l_linestatus AS flag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN cohort c ON c.hadm_id = l_orderkey AND c.subject_id = o_custkey
  JOIN nation ON n_nationkey = l_linenumber
WHERE l_extendedprice IS NOT NULL AND l_shipdate BETWEEN c.intime AND c.intime + INTERVAL 1800 DAY"""
USER_COHORT = f"""
{STARTS},
codes AS (
  SELECT DISTINCT o_custkey AS subject_id, l_returnflag AS icd9_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
base AS (SELECT s.user_id AS icustay_id, icd9_code, intime FROM starts s JOIN codes ON s.user_id = subject_id)
"""
ORACLE["extract_vitals_window"] = f"""
WITH {USER_COHORT}
SELECT b.icustay_id AS subject_id, b.icustay_id AS hadm_id, b.icustay_id, b.icd9_code, b.icd9_code AS short_title,
       c_nationkey AS itemid, n_name AS vitals_label, CAST(n_regionkey AS VARCHAR) AS vitals_category,
       'metavision' AS dbsource, ts AS charttime, value AS vitals_valuenum, event_type AS vitals_valueuom
FROM events e JOIN base b ON e.user_id = b.icustay_id JOIN customer ON c_custkey = e.user_id
  JOIN nation ON c_nationkey = n_nationkey
WHERE value IS NOT NULL AND ts BETWEEN intime AND intime + INTERVAL 48 HOUR"""

# ---------------------------------------------------------------- features

COVERAGE = """
coverage AS (
  SELECT event_type, count(DISTINCT user_id) AS n_entities,
         count(DISTINCT user_id) / (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) FROM win) AS coverage
  FROM win GROUP BY 1)"""
ORACLE["label_coverage"] = f"""
WITH {WINDOW}, {COVERAGE} SELECT event_type, n_entities, {r("coverage")} AS coverage FROM coverage"""
ORACLE["filter_high_coverage"] = f"""
WITH {WINDOW}, {COVERAGE}
SELECT event_id, user_id, event_type, ts, value FROM win
WHERE event_type IN (SELECT event_type FROM coverage WHERE coverage >= 0.66)"""
ORACLE["ts_features_long"] = f"""
WITH {WINDOW}
SELECT user_id, event_type, {", ".join(f"{r(s, digits(s))} AS {s}" for s in STATS)} FROM ({WINDOW_LONG}) x"""
ORACLE["ts_features_wide"] = f"WITH {WINDOW} {wide(WINDOW_LONG, 'user_id', 'event_type', EVENT_TYPES, True)}"
ORACLE["merge_features"] = f"""
WITH {MERGED} SELECT c_custkey, {", ".join(
    f"{r(n, 4 if n.startswith('slope') else 6)} AS {n}" for n in MERGED_FEATURES)} FROM merged"""
ORACLE["column_coverage"] = f"""
WITH {MERGED} SELECT column_name, {r("coverage")} AS coverage FROM (
{union("SELECT '@' AS column_name, count(@) / CAST(count(*) AS DOUBLE) AS coverage FROM merged", MERGED_ALL)}) x"""
ORACLE["drop_sparse_complete"] = f"""
WITH {MERGED},
long AS ({union("SELECT c_custkey, '@' AS feature, @ AS value FROM merged", MERGED_FEATURES)}),
kept AS (
  SELECT feature FROM long GROUP BY 1 HAVING count(value) / CAST(count(*) AS DOUBLE) > 0.7),
held AS (SELECT l.* FROM long l JOIN kept USING (feature)),
whole AS (SELECT c_custkey FROM held GROUP BY 1 HAVING count(value) = count(*))
SELECT c_custkey, feature, {LONG_VALUE} AS value FROM held JOIN whole USING (c_custkey)"""
ORACLE["build_features_full"] = f"""
WITH {USER_COHORT},
rows48 AS (
  SELECT b.icustay_id, event_type, ts, value FROM events e JOIN base b ON e.user_id = b.icustay_id
  WHERE ts BETWEEN intime AND intime + INTERVAL 48 HOUR),
sets AS (
  SELECT *, CASE WHEN event_type IN ('click', 'signup', 'view') THEN 'vitals' ELSE 'labs' END AS kind FROM rows48),
sizes AS (SELECT kind, CAST(count(DISTINCT icustay_id) AS DOUBLE) AS n FROM sets GROUP BY 1),
covered AS (
  SELECT event_type FROM (
    SELECT kind, event_type, count(DISTINCT icustay_id) AS k FROM sets GROUP BY 1, 2) c JOIN sizes USING (kind)
  WHERE k / n >= CASE kind WHEN 'vitals' THEN 0.7 ELSE 0.65 END),
stats AS ({series("(SELECT * FROM sets WHERE event_type IN (SELECT event_type FROM covered))",
                  "icustay_id", "event_type", "ts", "value")}),
names AS ({" UNION ALL ".join(
    f"SELECT '{s}_' || event_type AS feature, event_type, '{s}' AS stat FROM covered" for s in STATS)}),
cells AS (
  SELECT b.icustay_id, b.icd9_code, feature,
         CASE stat WHEN 'mean' THEN mean WHEN 'min' THEN min WHEN 'max' THEN max ELSE slope END AS value
  FROM base b CROSS JOIN names n
    LEFT JOIN stats s ON s.icustay_id = b.icustay_id AND s.event_type = n.event_type),
kept AS (SELECT feature FROM cells GROUP BY 1 HAVING count(value) / CAST(count(*) AS DOUBLE) > 0.6),
held AS (SELECT c.* FROM cells c JOIN kept USING (feature)),
whole AS (SELECT icustay_id, icd9_code FROM held GROUP BY 1, 2 HAVING count(value) = count(*))
SELECT icustay_id, icd9_code, feature, {LONG_VALUE} AS value FROM held JOIN whole USING (icustay_id, icd9_code)"""
ORACLE["build_features_by_arrays"] = ORACLE["build_features_full"]

# ---------------------------------------------------------------- columns

ORACLE["align_columns"] = """
SELECT c_custkey, c_acctbal, CAST(0.0 AS DOUBLE) AS c_absent, c_nationkey FROM customer"""
ORACLE["drop_leaky"] = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer"""
ORACLE["drop_ids"] = f"""
WITH {COHORT}
SELECT DISTINCT short_title, gender, ethnicity, marital_status, insurance, admission_type, age, mortality_30d
FROM cohort"""
ORACLE["numeric_only"] = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"
ORACLE["null_report"] = f"""
WITH {MERGED} {union("SELECT '@' AS column_name, count(*) - count(@) AS n_missing FROM merged", MERGED_ALL)}"""

# ---------------------------------------------------------------- preparation

ORACLE["hash_split"] = f"""
SELECT doc_id, quality, toxic, {hashed("doc_id")} < {TEST_CUT} AS is_test FROM labels"""
ORACLE["stratified_split"] = f"""
WITH h AS (SELECT *, {hashed("doc_id")} AS h FROM labels),
n AS (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h) AS k, count(*) OVER (PARTITION BY quality) AS n
  FROM h WHERE quality IS NOT NULL),
cuts AS (SELECT quality, h AS cut FROM n WHERE k = CAST(ceil(n * 0.2::DOUBLE) AS BIGINT))
SELECT doc_id, quality, toxic, coalesce(h <= cut, false) AS is_test FROM h LEFT JOIN cuts USING (quality)"""


def filled(column: str, rows: str) -> str:
    return f"coalesce({column}, (SELECT median({column}) FROM {rows}))"


IMPUTED = ["mean_click", "mean_view", "min_error", "max_purchase"]
ORACLE["median_impute"] = f"""
WITH {WINDOW},
w AS ({WINDOW_WIDE}),
marked AS (
  SELECT *, CASE WHEN {hashed("user_id")} < {TEST_CUT} THEN 'test' ELSE 'train' END AS part
  FROM w),
train AS (SELECT * FROM marked WHERE part = 'train')
SELECT user_id, {", ".join(f"{r(filled(c, 'train'))} AS {c}" for c in IMPUTED)}, part FROM marked"""
SELF_IMPUTED = ["mean_click", "mean_signup", "max_view"]
ORACLE["inference_impute"] = f"""
WITH {WINDOW},
w AS ({WINDOW_WIDE})
SELECT {", ".join(f"{r(c)} AS {c}" for c in SELF_IMPUTED)}, count(*) AS n_rows FROM (
  SELECT {", ".join(f"{filled(c, 'w')} AS {c}" for c in SELF_IMPUTED)} FROM w) x
GROUP BY {", ".join(f"x.{c}" for c in SELF_IMPUTED)}"""


def standardized(column: str) -> str:
    return f"({column} - (SELECT avg({column}) FROM part)) / (SELECT stddev_pop({column}) FROM part)"


ORACLE["standardize"] = f"""
SELECT p_partkey, {r(standardized("p_size"))} AS p_size, {r(standardized("p_retailprice"))} AS p_retailprice FROM part"""
ORACLE["one_hot"] = "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\""
    for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer"
ORACLE["sample_n"] = f"""
SELECT doc_id, lang, n_chars FROM documents ORDER BY {hashed("doc_id")}, doc_id LIMIT 100"""

# ---------------------------------------------------------------- scores

ORACLE["logistic_score"] = f"""
WITH {PARTS}
SELECT p_partkey, CAST(margin > 0 AS BIGINT) AS predicted_mortality_30d,
       {r(PROBABILITY)} AS predicted_probability FROM scored"""
ORACLE["risk_bands"] = f"""
WITH {PARTS}
SELECT p_partkey, CASE WHEN p > 0.5 THEN 'high' WHEN p > 0.2 THEN 'medium' ELSE 'low' END AS band,
       printf('%.2f%%', p * 100) AS risk_text, printf('%+.4f', p_size) AS size_text
FROM (SELECT *, {PROBABILITY} AS p FROM scored) x"""
ORACLE["score_parts"] = f"""
WITH {PARTS}
SELECT p_partkey, nullif(raw.p_size, 7) + 0.0 AS p_size, {r("raw.p_retailprice")} AS p_retailprice, raw.name_length,
       CASE WHEN raw.p_size <> 7 THEN CAST(margin > 0 AS BIGINT) END AS predicted_mortality_30d,
       CASE WHEN raw.p_size <> 7 THEN {r(PROBABILITY)} END AS predicted_probability
FROM raw JOIN scored USING (p_partkey)"""
ORACLE["classification_report"] = f"""
WITH {DOCS},
guess AS (
  SELECT CAST(quality AS VARCHAR) AS y, CAST(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS VARCHAR) AS p FROM docs
  WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
classes AS (SELECT DISTINCT y AS class FROM guess UNION SELECT DISTINCT p FROM guess),
counted AS (
  SELECT class, (SELECT count(*) FROM guess WHERE y = class) AS support,
         (SELECT count(*) FROM guess WHERE p = class) AS predicted,
         (SELECT count(*) FROM guess WHERE y = class AND p = class) AS hits
  FROM classes),
measured AS (
  SELECT class, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE hits / CAST(support AS DOUBLE) END AS recall,
         CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * hits / (support + predicted) END AS f1_score,
         support, hits
  FROM counted),
lines AS (
  SELECT class, precision, recall, f1_score, support FROM measured
  UNION ALL SELECT 'accuracy', sum(hits) / CAST(sum(support) AS DOUBLE), sum(hits) / CAST(sum(support) AS DOUBLE),
    sum(hits) / CAST(sum(support) AS DOUBLE), CAST(sum(support) AS BIGINT) FROM measured
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM measured
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM measured)
SELECT class, {r("precision")} AS precision, {r("recall")} AS recall, {r("f1_score")} AS f1_score, support FROM lines"""
ORACLE["roc_auc"] = f"""
WITH {DOCS},
per_score AS (
  SELECT n_chars, count(*) FILTER (quality > 0) AS p, count(*) FILTER (quality <= 0) AS n FROM docs GROUP BY 1),
below AS (SELECT *, sum(n) OVER (ORDER BY n_chars) - n AS under FROM per_score)
SELECT {r("CAST(sum(p * (2 * under + n)) AS DOUBLE) / (2.0 * sum(p) * sum(n))")} AS auc,
       CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg FROM below"""

# ---------------------------------------------------------------- explanation

ORACLE["to_long"] = f"""
WITH {PARTS}
{union(f"SELECT p_partkey, '@' AS feature, {r('@')} AS value FROM raw", ["p_size", "p_retailprice", "name_length"])}"""
ORACLE["linear_shap"] = f"""
WITH {LINEAR}
SELECT p_partkey, {r("base_value")} AS base_value, feature, {r("value")} AS value, {r("shap")} AS shap FROM ordered"""
ORACLE["raw_attributions"] = f"""
WITH {LINEAR} SELECT p_partkey, {", ".join(
    f"{r(f'''max(CASE WHEN feature = '{f}' THEN shap END)''')} AS {f}"
    for f in ("p_size", "p_retailprice", "name_length"))} FROM shap GROUP BY 1"""
ORACLE["contribution_table"] = f"""
WITH {LINEAR}
SELECT p_partkey, {r("base_value")} AS base_value, feature, {r("value")} AS value, {r("shap")} AS shap,
       {r("abs(shap)")} AS abs_shap, CASE WHEN shap > 0 THEN 'Increase Risk' ELSE 'Decrease Risk' END AS direction, rank
FROM ordered"""
ORACLE["contribution_words"] = f"""
WITH {LINEAR}
SELECT p_partkey, feature, CASE WHEN shap > 0 THEN '↑ Risk' ELSE '↓ Risk' END AS arrow,
       CASE WHEN shap > 0 THEN '⬆️ Increases Risk' ELSE '⬇️ Decreases Risk' END AS impact,
       printf('%.6f', round(value, 6)) AS value_text
FROM ordered"""
ORACLE["top_rows"] = f"""
WITH {LINEAR}
SELECT p_partkey, {r("CAST(-0.2 + 0.8 * 0.1 - 0.3 * 0.2 AS DOUBLE)")} AS base_value, {r("shap_total")} AS shap_total FROM totals"""
ORACLE["waterfall"] = f"""
WITH {LINEAR},
steps AS (
  SELECT *, base_value + sum(shap) OVER (PARTITION BY p_partkey ORDER BY rank) AS running_after
  FROM ordered WHERE p_partkey IN (SELECT p_partkey FROM totals))
SELECT p_partkey, {r("base_value")} AS base_value, rank, feature, {r("value")} AS value, {r("shap")} AS shap,
       {r("running_after - shap")} AS running_before, {r("running_after")} AS running_after FROM steps"""
ORACLE["global_importance"] = f"""
WITH {LINEAR} SELECT feature, {r("mean_abs_shap")} AS mean_abs_shap FROM importance"""
ORACLE["beeswarm"] = f"""
WITH {LINEAR},
places AS (SELECT feature, row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS feature_rank FROM importance)
SELECT feature, p_partkey, {r("base_value")} AS base_value, {r("value")} AS value, {r("shap")} AS shap, feature_rank
FROM ordered JOIN places USING (feature)"""

_X = ["p_size", "p_retailprice", "name_length"]
_W = [0.8, -0.5, 0.3]


def _subset_score(subset: int) -> str:
    terms = " + ".join(f"({w}) * {x}" for i, (x, w) in enumerate(zip(_X, _W)) if subset >> i & 1)
    return f"1.0 / (1.0 + exp(-(-0.2 + {terms or '0.0'})))"


def _shapley(i: int) -> str:
    terms = []
    for subset in range(8):
        if not subset >> i & 1:
            size = bin(subset).count("1")
            weight = {0: "1.0 / 3", 1: "1.0 / 6", 2: "1.0 / 3"}[size]
            terms.append(f"{weight} * (s{subset | 1 << i} - s{subset})")
    return " + ".join(terms)


ORACLE["exact_shapley"] = f"""
WITH {PARTS},
subsets AS (SELECT *, {", ".join(f"{_subset_score(s)} AS s{s}" for s in range(8))} FROM parts)
{" UNION ALL ".join(
    f"SELECT p_partkey, {r('s0')} AS base_value, '{x}' AS feature, {r(x)} AS value, {r(_shapley(i))} AS shap FROM subsets"
    for i, x in enumerate(_X))}"""

ORACLE["exact_shapley_batches"] = ORACLE["exact_shapley"]


def _mixed_score(subset: int) -> str:
    """The mean over the background with the features of a subset taken from the row."""
    terms = " + ".join(f"({w}) * {x if subset >> i & 1 else 'b.' + x.replace('p.', '')}" for i, (x, w) in enumerate(zip([f"p.{x}" for x in _X], _W)))
    return f"sum(n / (1.0 + exp(-(-0.2 + {terms})))) / sum(n)"


ORACLE["walk_shapley"] = f"""
WITH {PARTS},
background AS (
  SELECT (floor(p_size / 10) * 10.0 - 25.0) / 14.0 AS p_size, (floor(p_retailprice / 500) * 500.0 - 1400.0) / 300.0 AS p_retailprice,
         0.0 AS name_length, count(*) AS n
  FROM raw GROUP BY 1, 2),
subsets AS (
  SELECT p.p_partkey, {", ".join(f"any_value(p.{x}) AS {x}" for x in _X)}, {", ".join(f"{_mixed_score(s)} AS s{s}" for s in range(8))}
  FROM parts p, background b GROUP BY p.p_partkey)
{" UNION ALL ".join(
    f"SELECT p_partkey, {r('s0')} AS base_value, '{x}' AS feature, {r(x)} AS value, {r(_shapley(i))} AS shap, 0.0::DOUBLE AS error FROM subsets"
    for i, x in enumerate(_X))}"""

_VECTOR_MARGIN = " + ".join(["0.1"] + [f"({(i % 7 - 3) / 4}) * {{0}}[{i + 1}]" for i in range(64)])
ORACLE["walk_shapley_wide"] = f"""
WITH cells AS (SELECT vec_id, label >= 5 AS outcome, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
background AS (SELECT outcome, [{", ".join(f"round(min(e[{i + 1}]), 1)" for i in range(64))}] AS b FROM cells GROUP BY outcome),
base AS (SELECT avg(1.0 / (1.0 + exp(-({_VECTOR_MARGIN.format("b")})))) AS base_value FROM background)
SELECT vec_id, {r("base_value")} AS base_value, {r(f"1.0 / (1.0 + exp(-({_VECTOR_MARGIN.format('e')})))")} AS score, true AS has_errors
FROM cells, base"""

# ---------------------------------------------------------------- exploring

ORACLE["explore_cohort"] = f"""
WITH {COHORT} SELECT subject_id, age, gender, icustay_id, mortality_30d FROM cohort
WHERE gender = 'BUILDING' AND age BETWEEN 30 AND 60"""
ORACLE["distinct_subjects"] = "SELECT DISTINCT o_custkey FROM orders"
ORACLE["patient_lookup"] = f"""
WITH {COHORT}
SELECT o_custkey AS subject_id, o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_custkey IN (SELECT subject_id FROM cohort WHERE gender = 'MACHINERY' AND age BETWEEN 18 AND 89)"""
ORACLE["trend_exact"] = """
SELECT user_id, event_type, ts, value FROM events WHERE upper(event_type) IN ('PURCHASE', 'ERROR')"""
ORACLE["trend_contains"] = f"""
WITH {WINDOW}
SELECT user_id, event_type, ts, value FROM win WHERE event_type ILIKE '%ign%' OR event_type ILIKE '%ie%'"""
ORACLE["range_violations"] = f"""
WITH {PARTS}
SELECT p_partkey, 'p_size' AS feature, 'Size' AS label, p_size AS value, 5.0::DOUBLE AS lowest, 45.0::DOUBLE AS highest
FROM raw WHERE p_size NOT BETWEEN 5 AND 45
UNION ALL SELECT p_partkey, 'p_retailprice', 'Price', p_retailprice, 950.0::DOUBLE, 1800.0::DOUBLE
FROM raw WHERE p_retailprice NOT BETWEEN 950 AND 1800"""


# ---------------------------------------------------------------- loads

ORACLE["ingest_events"] = """
SELECT CAST(event_id AS INTEGER) AS row_id, CAST(user_id AS INTEGER) AS icustay_id, ts AS charttime, event_type AS value,
       value AS valuenum FROM events"""
ORACLE["ingest_notes"] = """
SELECT CAST(doc_id AS INTEGER) AS row_id, lang AS category, source AS description, md5(text) AS text_md5 FROM documents"""
ORACLE["model_roundtrip"] = ORACLE["logistic_score"]

# ---------------------------------------------------------------- ways for large data

ORACLE["window_salted"] = ORACLE["window_48h_entity_key"]
ORACLE["window_stored"] = ORACLE["window_48h_entity_key"]
ORACLE["features_refreshed"] = ORACLE["ts_features_long"]
ORACLE["published_load"] = "SELECT c_custkey, c_name, c_nationkey, true AS refused FROM customer"


def _base_schemas() -> str:
    """Filled and distinct values of the columns that each base table is given."""
    tables = {
        "patients": ("customer", "c_custkey row_id, c_custkey subject_id, c_mktsegment gender"),
        "admissions": (
            "orders",
            "o_orderkey row_id, o_custkey subject_id, o_orderkey hadm_id, o_orderdate admittime, o_orderpriority admission_type,"
            " o_orderstatus marital_status, o_orderkey % 2 hospital_expire_flag",
        ),
        "icustays": ("orders", "o_orderkey row_id, o_custkey subject_id, o_orderkey icustay_id, o_orderdate intime, o_totalprice los"),
        "diagnoses_icd": (
            "orders",
            "o_orderkey row_id, o_custkey subject_id, o_orderkey hadm_id, o_orderkey % 7 seq_num, o_orderpriority icd9_code",
        ),
        "d_icd_diagnoses": ("part", "p_partkey row_id, p_brand icd9_code, p_type short_title, p_name long_title"),
        "chartevents": ("events", "event_id row_id, user_id icustay_id, ts charttime, event_type \"value\", \"value\" valuenum"),
        "d_items": ("nation", "n_nationkey row_id, n_nationkey itemid, n_name label"),
        "labevents": ("events", "event_id row_id, user_id subject_id, ts charttime, event_type flag, \"value\" valuenum"),
        "noteevents": ("documents", "doc_id row_id, lang category, CASE WHEN text <> '' THEN text END text"),
        "d_labitems": ("region", "r_regionkey row_id, r_regionkey itemid, r_name label"),
    }
    parts = []
    for name, (source, columns) in tables.items():
        for column in [c.split()[-1] for c in columns.split(", ")]:
            column = column.strip('"')
            parts.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name, count(x.{column}) AS n_filled, "
                f"count(DISTINCT x.{column}) AS n_distinct FROM (SELECT {columns} FROM {source}) x"
            )
    return " UNION ALL ".join(parts)


ORACLE["base_schemas"] = _base_schemas()
ORACLE["names_and_inputs"] = """
WITH starts AS (SELECT user_id, min(ts) AS intime FROM events GROUP BY 1),
rows AS (SELECT e.* FROM events e JOIN starts USING (user_id) WHERE value IS NOT NULL AND NOT isnan(value) AND ts BETWEEN intime AND intime + INTERVAL 48 HOUR),
labels AS (SELECT event_type FROM rows GROUP BY 1
           HAVING count(DISTINCT user_id) / (SELECT count(DISTINCT user_id)::DOUBLE FROM rows) >= 0.66),
stats(stat, k) AS (VALUES ('mean', 0), ('min', 1), ('max', 2), ('slope', 3)),
names AS (SELECT stat || '_' || event_type AS name, 4 * (row_number() OVER (PARTITION BY stat ORDER BY event_type) - 1) + k AS place FROM labels, stats)
SELECT 'name' AS kind, place, name, false AS known FROM names
UNION ALL SELECT 'name', (SELECT count(*) FROM names), 'max_bicarbonate', true
UNION ALL SELECT 'input', (SELECT count(*) FROM events), 'labs', true
UNION ALL SELECT 'input', (SELECT count(*) FROM orders), 'vitals', true
UNION ALL SELECT 'input', (SELECT count(*) FROM customer), 'cohort', true"""
ORACLE["window_crowded"] = """
SELECT event_id, e.user_id, e.event_type, ts, value, intime, window_type
FROM events e JOIN (SELECT user_id, event_type AS window_type, min(ts) AS intime FROM events GROUP BY 1, 2) s
  ON e.user_id = s.user_id
WHERE value IS NOT NULL AND ts BETWEEN intime AND intime + INTERVAL 48 HOUR"""
ORACLE["merge_salted"] = ORACLE["merge_features"]
ORACLE["median_large"] = "SELECT " + ", ".join(
    f"{r(f'median({c})')} AS {c}" for c in ("l_extendedprice", "l_quantity", "l_discount")
) + " FROM lineitem"
ORACLE["sample_ties"] = f"""
SELECT l_orderkey FROM lineitem ORDER BY {hashed("l_orderkey")}, l_orderkey LIMIT 1000"""

# ---------------------------------------------------------------- slopes and names

_CLOSE = """(
  SELECT user_id, event_type, value,
         TIMESTAMP '2150-01-01' + to_microseconds(CAST(epoch_us(ts) // 1000000 % 100000 AS BIGINT)) AS ts
  FROM events WHERE value IS NOT NULL)"""
ORACLE["slope_close_times"] = f"""
WITH slopes AS ({series(_CLOSE, "user_id", "event_type", "ts", "value")}),
sized AS (
  SELECT *, CASE WHEN slope <> 0 THEN CAST(floor(log10(abs(slope))) AS BIGINT) END AS exponent FROM slopes)
SELECT user_id, event_type, {r("slope / pow(10.0, exponent)")} AS digits, exponent FROM sized"""
ORACLE["dotted_labels"] = f"""
WITH {WINDOW}, {COVERAGE},
covered AS (SELECT event_type FROM coverage WHERE coverage >= 0.66),
stats AS ({series("(SELECT * FROM win WHERE event_type IN (SELECT event_type FROM covered))", "user_id", "event_type", "ts", "value")}),
names AS ({" UNION ALL ".join(
    f"SELECT '{s}_resp._' || event_type AS feature, event_type, '{s}' AS stat FROM covered" for s in STATS)}),
cells AS (
  SELECT b.user_id, feature,
         CASE stat WHEN 'mean' THEN mean WHEN 'min' THEN min WHEN 'max' THEN max ELSE slope END AS value
  FROM starts b CROSS JOIN names n LEFT JOIN stats s ON s.user_id = b.user_id AND s.event_type = n.event_type),
kept AS (SELECT feature FROM cells GROUP BY 1 HAVING count(value) / CAST(count(*) AS DOUBLE) > 0.6),
held AS (SELECT c.* FROM cells c JOIN kept USING (feature)),
whole AS (SELECT user_id FROM held GROUP BY 1 HAVING count(value) = count(*))
SELECT user_id, feature, {LONG_VALUE} AS value FROM held JOIN whole USING (user_id)"""

# ---------------------------------------------------------------- fitted models: what must hold of them

_CELLS = [f"e{i}" for i in range(64)]
ORACLE["logistic_fit"] = """
SELECT vec_id, CAST(label >= 5 AS INTEGER) AS outcome, true AS class_fits, true AS is_optimum FROM embeddings"""
ORACLE["training_report"] = f"""
SELECT CAST(CAST(label >= 5 AS INTEGER) AS VARCHAR) AS class, count(*) AS support, true AS measures_fit
FROM embeddings WHERE {hashed("vec_id")} < {TEST_CUT} GROUP BY 1"""
ORACLE["gbt_select_features"] = """
SELECT vec_id, CAST(label >= 5 AS INTEGER) AS outcome, 10 AS n_features, true AS complete FROM embeddings"""
ORACLE["tree_shap_importance"] = f"""
WITH n AS (SELECT label >= 5 AS y, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS k FROM embeddings GROUP BY 1)
SELECT unnest({_CELLS}) AS feature, (SELECT CAST(sum(k) AS BIGINT) FROM n) AS n_rows, true AS adds_up"""


def _newton(rounds: int = 12) -> str:
    """Newton steps on the penalised loss of two standardised features and an intercept, a table a step."""
    steps = ["w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for k in range(rounds):
        steps.append(f"""
g{k} AS (
  SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
         avg((p - y) * u) + any_value(a) / count(*) AS ga, avg((p - y) * v) + any_value(b) / count(*) AS gb, avg(p - y) AS gc,
         avg(q * u * u) + 1.0 / count(*) AS aa, avg(q * u * v) AS ab, avg(q * u) AS ac,
         avg(q * v * v) + 1.0 / count(*) AS bb, avg(q * v) AS bc, avg(q) AS cc
  FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1.0 / (1.0 + exp(-(a * u + b * v + c))) AS p FROM z, w{k}) s) t),
d{k} AS (
  SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g{k}),
w{k + 1} AS (
  SELECT a - (ga * (bb * cc - bc * bc) - ab * (gb * cc - bc * gc) + ac * (gb * bc - bb * gc)) / det AS a,
         b - (aa * (gb * cc - bc * gc) - ga * (ab * cc - bc * ac) + ac * (ab * gc - gb * ac)) / det AS b,
         c - (aa * (bb * gc - gb * bc) - ab * (ab * gc - gb * ac) + ga * (ab * bc - bb * ac)) / det AS c FROM d{k})""")
    return ", ".join(steps)


ORACLE["logistic_newton"] = f"""
WITH x AS (
  SELECT ln(n_chars + 1.0) AS u, CAST(lang = 'en' AS DOUBLE) AS v, CAST(quality AS DOUBLE) AS y
  FROM labels JOIN documents USING (doc_id)),
z AS (
  SELECT (u - (SELECT avg(u) FROM x)) / (SELECT stddev_pop(u) FROM x) AS u,
         (v - (SELECT avg(v) FROM x)) / (SELECT stddev_pop(v) FROM x) AS v, y FROM x),
{_newton()}
SELECT (SELECT count(*) FROM x) AS n_rows, term, round(weight, 3) + 0.0 AS weight FROM (
  SELECT 'size' AS term, a AS weight FROM w12 UNION ALL SELECT 'is_english', b FROM w12
  UNION ALL SELECT 'intercept', c FROM w12) t"""
ORACLE["tree_split"] = f"""
WITH x AS (SELECT l_linenumber AS f, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0 END AS y FROM lineitem),
cuts AS (SELECT DISTINCT f + 0.5::DOUBLE AS cut FROM x WHERE f < (SELECT max(f) FROM x)),
sides AS (
  SELECT cut, avg(y) FILTER (f <= cut) AS l, avg(y) FILTER (f > cut) AS h,
         sum(pow(y, 2)) - pow(sum(y) FILTER (f <= cut), 2) / count(*) FILTER (f <= cut)
           - pow(sum(y) FILTER (f > cut), 2) / count(*) FILTER (f > cut) AS loss
  FROM x CROSS JOIN cuts GROUP BY cut),
best AS (SELECT * FROM sides ORDER BY loss, cut LIMIT 1)
SELECT (SELECT count(*) FROM x) AS n_rows, '-inf'::DOUBLE AS low, cut AS high, {r("2 * l")} AS margin FROM best
UNION ALL SELECT (SELECT count(*) FROM x), cut, 'inf'::DOUBLE, {r("2 * h")} FROM best"""


def _leaf_sql() -> tuple[list[str], str, str]:
    """Per leaf its background patterns and what every part gets of it; then the sum of shares, and the base."""
    leaves = [
        (0.7, {"p_size": "p_size <= 25", "p_retailprice": "p_retailprice > 1200"}),
        (-0.4, {"p_size": "p_size > 25", "name_length": "name_length <= 12"}),
        (0.25, {"p_size": "p_size > 10 AND p_size <= 40", "p_retailprice": "p_retailprice <= 1400", "name_length": "name_length > 8"}),
    ]
    tables, shares, bases = [], [], ["0.1"]
    for k, (value, tests) in enumerate(leaves):
        bits = ", ".join(f"({test})::INTEGER AS {f}" for f, test in tests.items())
        names = list(tests)
        tables.append(f"o{k} AS (SELECT p_partkey, {bits} FROM raw)")
        tables.append(f"c{k} AS (SELECT {', '.join(names)}, count(*) / (SELECT count(*)::DOUBLE FROM raw) AS w FROM o{k} GROUP BY ALL)")
        mine = " + ".join(f"o.{f} * (1 - c.{f})" for f in names)
        theirs = " + ".join(f"c.{f} * (1 - o.{f})" for f in names)
        whole = " AND ".join(f"o.{f} + c.{f} > 0" for f in names)
        tables.append(f"m{k} AS (SELECT o.*, {', '.join(f'c.{f} AS bg_{f}' for f in names)}, w, {mine} AS p, {theirs} AS q FROM o{k} o, c{k} c WHERE {whole})")
        for f in names:
            shares.append(f"""SELECT p_partkey, '{f}' AS feature, {value} * w * CASE
              WHEN {f} > bg_{f} THEN factorial(greatest(p - 1, 0)::INTEGER) * factorial(q::INTEGER) / factorial((p + q)::INTEGER)::DOUBLE
              WHEN {f} < bg_{f} THEN -factorial(p::INTEGER) * factorial(greatest(q - 1, 0)::INTEGER) / factorial((p + q)::INTEGER)::DOUBLE
              ELSE 0.0 END AS s FROM m{k}""")
        bases.append(f"{value} * (SELECT avg(({' AND '.join(tests.values())})::INTEGER) FROM raw)")
    return tables, " UNION ALL ".join(shares), " + ".join(bases)


_TABLES, _SHARES, _BASE = _leaf_sql()
ORACLE["tree_shap_fixed"] = f"""
WITH {PARTS}, {", ".join(_TABLES)},
long AS ({union("SELECT p_partkey, '@' AS feature, @ AS value FROM raw", _X)}),
shares AS (SELECT p_partkey, feature, sum(s) AS shap FROM ({_SHARES}) x GROUP BY 1, 2)
SELECT p_partkey, {r(_BASE)} AS base_value, feature, {r("value")} AS value, {r("coalesce(shap, 0.0)")} AS shap
FROM long LEFT JOIN shares USING (p_partkey, feature)"""

_EXPLAINED = """
shap AS (
  SELECT p_partkey, 'p_size' AS feature, 0.8 * p_size AS shap FROM parts
  UNION ALL SELECT p_partkey, 'p_retailprice', -0.5 * p_retailprice FROM parts
  UNION ALL SELECT p_partkey, 'name_length', 0.3 * name_length FROM parts),
ordered AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(shap) DESC, feature) AS rank FROM shap),
totals AS (SELECT p_partkey, sum(shap) AS t FROM shap GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
importance AS (
  SELECT feature, m, row_number() OVER (ORDER BY m DESC, feature) AS place
  FROM (SELECT feature, avg(abs(shap)) AS m FROM shap GROUP BY 1) x)
"""
ORACLE["explain_tables"] = f"""
WITH {PARTS}, {_EXPLAINED}
SELECT 'contributions' AS kind, p_partkey, feature, {r("shap")} AS amount, rank AS place FROM ordered
UNION ALL SELECT 'waterfall', p_partkey, feature, {r("-0.2 + sum(shap) OVER (PARTITION BY p_partkey ORDER BY rank)")}, rank
  FROM ordered WHERE p_partkey IN (SELECT p_partkey FROM totals)
UNION ALL SELECT 'importance', NULL, feature, {r("m")}, NULL FROM importance
UNION ALL SELECT 'beeswarm', p_partkey, feature, {r("shap")}, place FROM ordered JOIN importance USING (feature)"""
