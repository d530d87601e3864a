"""Plain SQL with the same results as the catalogue's queries, written for a single-node engine.

These statements favour the obvious formulation (cross joins, global windows) over a scalable one; they
only check results.
"""

from __future__ import annotations

from veilframe.operators.roles import ANONYMISATION_RULES, CONTENT_RULES
from veilframe.plans import person as views
from veilframe.plans.catalog import AS_OF, SECRET
from veilframe.schema import PERSON_COLUMNS

COLS = [
    "id", "birthdate", "ssn", "first", "last", "address", "city", "state", "zip", "race", "gender", "marital",
    "healthcare_expenses", "healthcare_coverage",
]
WIDE = COLS + ["drivers", "passport", "maiden", "lat", "lon"]
TYPES = {
    "birthdate": "date", "healthcare_expenses": "double", "healthcare_coverage": "double", "lat": "double", "lon": "double",
}
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM = LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_shipdate": "timestamp_ntz",
}
UNIT = "4503599627370496e0"


def with_views(body: str, *ctes: str) -> str:
    parts = [f"person AS ({views.PERSON_SQL})", *ctes]
    return f"WITH {', '.join(parts)} {body}"


WIDE_CTE = f"wide AS ({views.WIDE_PERSON_SQL})"
SHIFTED_CTE = f"shifted AS ({views.SHIFTED_PERSON_SQL})"
DOUBLED_CTE = f"doubled AS ({views.DOUBLED_PERSON_SQL})"
GAPPED_CTE = f"gapped AS ({views.GAPPED_PERSON_SQL})"
PAIR_CTE = "pair AS (SELECT 'original' AS series, * FROM person UNION ALL SELECT 'pseudonymised', * FROM shifted)"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0e0)"


def nulls(cols: list[str]) -> str:
    return " + ".join(f"CAST({c} IS NULL AS INT)" for c in cols)


def listed(cols: list[str], **changed: str) -> str:
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in cols)


DATED = {"birthdate": "CAST(birthdate AS VARCHAR)"}


def people(source: str = "person", **changed: str) -> str:
    return f"SELECT {listed(COLS, **{**DATED, **changed})} FROM {source}"


def profile_sql(source: str, cols: list[str]) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS total_records, CAST({len(cols)} AS BIGINT) AS total_columns,
       CAST(sum({nulls(cols)}) AS BIGINT) AS missing_values,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS BIGINT) AS duplicate_records
FROM {source}"""


def describe_sql(source: str, cols: list[str], digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {r(f'avg({c})', digits)} AS mean,
        {r(f'stddev_samp({c})', digits)} AS std, {r(f'min({c})', digits)} AS min,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', digits)} AS p25, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', digits)} AS p50,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', digits)} AS p75, {r(f'max({c})', digits)} AS max FROM {source}"""
        for c in cols
    )


def value_counts_sql(source: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, CAST(count(*) AS BIGINT) AS count FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in cols
    )


def role_sql(name: str, rules, token: bool = False) -> str:
    whens = []
    for role, words in rules:
        hits = [f"'_' || lower({name}) || '_' LIKE '%\\_{w.replace('_', chr(92) + '_')}\\_%' ESCAPE '\\'" if token else f"contains(lower({name}), '{w}')" for w in words]
        whens.append(f"WHEN {' OR '.join(hits)} THEN '{role}'")
    return f"CASE {' '.join(whens)} END"


def catalogue_sql(source: str, cols: list[str], types: dict[str, str]) -> str:
    kinds = {"string": "categorical", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    rows = [
        f"""SELECT '{source}' AS "table", {i} AS position, '{c}' AS "column", '{kinds.get(types.get(c, 'string'), 'numerical')}' AS kind,
        CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
        CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM {source}"""
        for i, c in enumerate(cols)
    ]
    return " UNION ALL ".join(rows)


ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp"}
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def stats_sql(name: str, source: str, cols: list[str]) -> str:
    return f"""SELECT '{name}' AS "table", CAST(count(*) AS BIGINT) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns,
    '{",".join(cols)}' AS columns, CAST(sum({nulls(cols)}) AS BIGINT) AS missing_values FROM {source}"""


def filled(c: str, over: str = "ORDER BY id") -> str:
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def mode_of(c: str, source: str, default: str = "Unknown") -> str:
    return f"coalesce((SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), '{default}')"


def median_of(c: str, source: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.5) FROM {source})"


# --- masks ---------------------------------------------------------------------------------------

SSN = "CASE WHEN ssn IS NULL OR ssn = '' THEN ssn ELSE substr(sha256(ssn), 1, 3) || '-' || substr(sha256(ssn), 4, 2) || '-' || substr(sha256(ssn), 6, 4) END"
FIRST = "'Patient_' || substr(md5(coalesce(nullif(first, ''), 'Unknown')), 1, 8)"
LAST = "'ID_' || substr(md5(coalesce(nullif(last, ''), 'Unknown')), 1, 8)"
ADDRESS = r"CASE WHEN len(regexp_extract_all(coalesce(address, ''), '\S+')) > 1 THEN 'Street_' || len(regexp_extract_all(address, '\S+')) || '_Redacted' ELSE 'Address_Redacted' END"
ZIP = "CASE WHEN length(split_part(zip, '.', 1)) >= 3 THEN substr(split_part(zip, '.', 1), 1, 3) || 'XX' ELSE '00000' END"
MASKS = {"ssn": SSN, "first": FIRST, "last": LAST, "address": ADDRESS, "zip": ZIP}
REDACTIONS = {c: f"'{c.upper()}_Redacted'" for c in ("drivers", "passport", "maiden", "lat", "lon")}


def keyed(c: str, namespace: str = "person") -> str:
    h = f"sha256('{len(SECRET)}:{len(namespace)}:{SECRET}:{namespace}:' || {c})"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


# --- ages and features ---------------------------------------------------------------------------

AGE = f"CAST(floor(date_diff('day', birthdate, DATE '{AS_OF}') / 365e0) AS INT)"
AGED_CTE = f"""aged AS (SELECT *, CASE WHEN age <= 0 THEN NULL WHEN age <= 18 THEN '0-18' WHEN age <= 30 THEN '19-30'
    WHEN age <= 50 THEN '31-50' WHEN age <= 70 THEN '51-70' WHEN age <= 100 THEN '70+' END AS age_group
  FROM (SELECT * EXCLUDE (birthdate), {AGE} AS age, CAST(month(birthdate) AS INT) AS birth_month,
    CAST(year(birthdate) AS INT) AS birth_year FROM person))"""
AGED_COLS = [c for c in COLS if c != "birthdate"] + ["age", "birth_month", "birth_year", "age_group"]
AGED_NUMBERS = ["healthcare_expenses", "healthcare_coverage", "age", "birth_month", "birth_year"]
AGED_TEXTS = [c for c in AGED_COLS if c not in AGED_NUMBERS and c != "id"]
FILLED_CTE = f"filled AS (SELECT id, {', '.join(f'{filled(c)} AS {c}' for c in AGED_COLS if c != 'id')} FROM aged)"


def scaled(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"


def coded(c: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS BIGINT)"


PREPARED_CTE = "prepared AS (SELECT id, {} FROM filled)".format(
    ", ".join([f"{coded(c)} AS {c}" for c in AGED_TEXTS] + [f"{r(scaled(c))} AS {c}" for c in AGED_NUMBERS])
)
CONDITION = ["gender", "healthcare_expenses", "healthcare_coverage", "age_group"]
TARGET = ["city", "state", "zip", "race", "age"]
FEATURE_ROWS = with_views(
    " UNION ALL ".join(
        f"SELECT id AS row_key, '{side}' AS side, {i} AS position, CAST({c} AS DOUBLE) AS value FROM prepared"
        for side, cols in (("condition", CONDITION), ("target", TARGET))
        for i, c in enumerate(cols)
    ),
    AGED_CTE, FILLED_CTE, PREPARED_CTE,
)


def minmax(c: str) -> str:
    low, high = f"min({c}) OVER ()", f"max({c}) OVER ()"
    return r(f"CASE WHEN {low} = {high} THEN {c} - {low} ELSE ({c} - {low}) / ({high} - {low}) END")


def standard(c: str) -> str:
    return r(f"CASE WHEN min({c}) OVER () = max({c}) OVER () THEN {c} - min({c}) OVER () ELSE ({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) END")


# --- privacy -------------------------------------------------------------------------------------


def complete(qi: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in qi)


def classes_cte(source: str, qi: list[str], keep_nulls: bool = False) -> str:
    where = "" if keep_nulls else f"WHERE {complete(qi)}"
    return f"classes AS (SELECT {', '.join(qi)}, CAST(count(*) AS BIGINT) AS class_size FROM {source} {where} GROUP BY ALL)"


def k_sql(ks=(2, 5, 10, 20), detail: bool = False) -> str:
    more = f""", max(class_size) AS max_group_size, CAST(count(*) FILTER (class_size >= k) AS BIGINT) AS groups_meeting_k,
        {r('100e0 * count(*) FILTER (class_size >= k) / count(*)')} AS percentage_meeting_k""" if detail else ""
    return f"""SELECT CAST(k AS INT) AS k, min(class_size) >= k AS achieved, min(class_size) AS min_group_size,
        CAST(count(*) AS BIGINT) AS total_groups, CAST(count(*) FILTER (class_size < k) AS BIGINT) AS groups_below_k {more}
      FROM classes, (SELECT unnest({list(ks)}) AS k) GROUP BY k"""


def l_cte(source: str, qi: list[str], sensitive: list[str]) -> str:
    counts = ", ".join(f"count(DISTINCT {s}) AS d_{s}" for s in sensitive)
    return f"distinct_values AS (SELECT {', '.join(qi)}, {counts} FROM {source} WHERE {complete(qi)} GROUP BY ALL)"


def l_sql(sensitive: list[str], detail: bool = False) -> str:
    least = f"least({', '.join('d_' + s for s in sensitive)})"
    base = f"""SELECT CAST(l AS INT) AS l, CAST(count(*) FILTER ({least} >= l) AS DOUBLE) / count(*) >= 0.8e0 AS achieved,
        CAST(count(*) FILTER ({least} >= l) AS BIGINT) AS l_diverse_groups, CAST(count(*) AS BIGINT) AS total_groups,
        {r(f'CAST(count(*) FILTER ({least} >= l) AS DOUBLE) / count(*)')} AS ratio"""
    source = "FROM distinct_values, (SELECT unnest([2, 3, 5]) AS l) GROUP BY l"
    if not detail:
        return f"{base} {source}"
    return " UNION ALL ".join(f"{base}, '{s}' AS attribute, {r(f'avg(d_{s})')} AS average_diversity {source}" for s in sensitive)


def t_ctes(source: str, qi: list[str], sensitive: list[str]) -> list[str]:
    """Every class against every overall value, in exact integers."""
    keys = ", ".join(qi)
    out = [f"groups_ AS (SELECT DISTINCT {keys} FROM {source} WHERE {complete(qi)})"]
    for s in sensitive:
        same = " AND ".join(f"g.{c} = x.{c}" for c in qi)
        out.append(
            f"""tv_{s} AS (
  SELECT {', '.join('g.' + c for c in qi)}, max(o.n) AS n, max(coalesce(x.n, 0)) AS n_g,
    coalesce(sum(abs(CAST(o.c AS HUGEINT) * coalesce(x.n, 0) - CAST(coalesce(y.c, 0) AS HUGEINT) * o.n)), 0) AS dev
  FROM groups_ g
  LEFT JOIN (SELECT {s} AS v, count(*) AS c, sum(count(*)) OVER () AS n FROM {source} WHERE {s} IS NOT NULL GROUP BY {s}) o ON true
  LEFT JOIN (SELECT {keys}, count({s}) AS n FROM {source} GROUP BY ALL) x ON {same}
  LEFT JOIN (SELECT {keys}, {s} AS v, count(*) AS c FROM {source} GROUP BY ALL) y
    ON {same.replace('x.', 'y.')} AND y.v = o.v
  GROUP BY ALL)"""
        )
    distance = {s: f"CASE WHEN tv_{s}.n IS NULL THEN 0e0 WHEN tv_{s}.n_g = 0 THEN 0.5e0 ELSE CAST(tv_{s}.dev AS DOUBLE) / (2e0 * tv_{s}.n * tv_{s}.n_g) END" for s in sensitive}
    close = {
        s: f"(tv_{s}.n IS NULL OR CASE WHEN tv_{s}.n_g = 0 THEN 5 <= t10 ELSE 10 * tv_{s}.dev <= 2 * t10 * CAST(tv_{s}.n AS HUGEINT) * tv_{s}.n_g END)"
        for s in sensitive
    }
    joins = " ".join(f"JOIN tv_{s} USING ({keys})" for s in sensitive[1:])
    out.append(
        f"""distances AS (SELECT t10, {' AND '.join(close.values())} AS close, {', '.join(f'{d} AS tv_{s}' for s, d in distance.items())}
  FROM tv_{sensitive[0]} {joins}, (SELECT unnest([1, 2, 3]) AS t10))"""
    )
    return out


def t_sql(sensitive: list[str], detail: bool = False) -> str:
    ratio = "CAST(count(*) FILTER (close) AS DOUBLE) / count(*)"
    base = f"""SELECT CAST(t10 AS DOUBLE) / 10 AS t, {ratio} >= 0.8e0 AS achieved, CAST(count(*) FILTER (close) AS BIGINT) AS t_close_groups,
        CAST(count(*) AS BIGINT) AS total_groups, {r(ratio)} AS ratio"""
    if not detail:
        return f"{base} FROM distances GROUP BY t10"
    return " UNION ALL ".join(f"{base}, '{s}' AS attribute, {r(f'avg(tv_{s})')} AS average_distance FROM distances GROUP BY t10" for s in sensitive)


def level(share: str) -> str:
    return f"CASE WHEN {share} > 0.8e0 THEN 'HIGH' WHEN {share} > 0.5e0 THEN 'MEDIUM' ELSE 'LOW' END"


RISK = f"""SELECT CAST(sum(class_size) AS BIGINT) AS total_records, CAST(count(*) AS BIGINT) AS unique_combinations,
    {r('count(*) / CAST(sum(class_size) AS DOUBLE)')} AS uniqueness_ratio, {level('count(*) / CAST(sum(class_size) AS DOUBLE)')} AS risk_level FROM classes"""
SINGLE = "count(*) FILTER (class_size = 1) / CAST(sum(class_size) AS DOUBLE)"
RISK_DETAIL = f"""SELECT CAST(sum(class_size) AS BIGINT) AS total_records, CAST(count(*) AS BIGINT) AS unique_combinations,
    CAST(count(*) FILTER (class_size = 1) AS BIGINT) AS single_records, CAST(count(*) FILTER (class_size <= 3) AS BIGINT) AS small_groups_1_3,
    CAST(count(*) FILTER (class_size BETWEEN 4 AND 10) AS BIGINT) AS medium_groups_4_10,
    CAST(count(*) FILTER (class_size > 10) AS BIGINT) AS large_groups_10_plus, {r('100e0 * ' + SINGLE)} AS single_record_risk_percentage,
    {r('100e0 * (count(*) FILTER (class_size <= 3)) / CAST(sum(class_size) AS DOUBLE)')} AS small_group_risk_percentage,
    {level(SINGLE)} AS overall_risk_level FROM classes"""


def metric_sql(metric: str, source: str, fields: list[tuple[str, str]], param: str | None) -> str:
    """Long metric rows from a metric query; fields are (name, kind)."""
    label = f"'{param}=' || {param}" if param else "CAST(NULL AS VARCHAR)"
    parts = []
    for name, kind in fields:
        number = "CAST(NULL AS DOUBLE)" if kind == "text" else f"CAST({name} AS DOUBLE)"
        text = f"CAST({name} AS VARCHAR)" if kind in ("text", "flag") else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT 'privacy' AS family, '{metric}' AS metric, {label} AS param, '{name}' AS field, {number} AS value_num, {text} AS value_str FROM {source}"
        )
    return " UNION ALL ".join(parts)


def privacy_parts(source: str, qi: list[str], sensitive: list[str]) -> tuple[str, list[str]]:
    """The report's rows, and the CTEs they need."""
    k = [("achieved", "flag"), ("min_group_size", "n"), ("total_groups", "n"), ("groups_below_k", "n")]
    l_fields = [("achieved", "flag"), ("l_diverse_groups", "n"), ("total_groups", "n"), ("ratio", "n")]
    t = [("achieved", "flag"), ("t_close_groups", "n"), ("total_groups", "n"), ("ratio", "n")]
    risk = [("total_records", "n"), ("unique_combinations", "n"), ("uniqueness_ratio", "n"), ("risk_level", "text")]
    all_classes = classes_cte(source, qi, keep_nulls=True).replace("classes AS", "all_classes AS", 1)
    body = " UNION ALL ".join(
        [
            metric_sql("k_anonymity", "k_table", k, "k"),
            metric_sql("l_diversity", "l_table", l_fields, "l"),
            metric_sql("t_closeness", "t_table", t, "t"),
            metric_sql("reidentification_risk", "risk_table", risk, None),
        ]
    )
    ctes = [
        classes_cte(source, qi), l_cte(source, qi, sensitive), *t_ctes(source, qi, sensitive), all_classes,
        f"k_table AS ({k_sql()})", f"l_table AS ({l_sql(sensitive)})", f"t_table AS ({t_sql(sensitive)})",
        f"risk_table AS ({RISK.replace('FROM classes', 'FROM all_classes')})",
    ]
    return body, ctes


def privacy_report_sql(qi: list[str], sensitive: list[str], prefix: str = "") -> str:
    body, ctes = privacy_parts("person", qi, sensitive)
    return with_views(f"SELECT {prefix} * FROM ({body})", *ctes)


# --- utility -------------------------------------------------------------------------------------

MONEY = ["healthcare_expenses", "healthcare_coverage"]


def relative(stat: str, c: str) -> str:
    return f"abs((SELECT {stat}({c}) FROM shifted) - (SELECT {stat}({c}) FROM person)) / (abs((SELECT {stat}({c}) FROM person)) + 1e-8)"


def similarity_sql() -> str:
    per = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT avg({c}) FROM person) AS mean_original, (SELECT stddev_samp({c}) FROM person) AS std_original,
        (SELECT avg({c}) FROM shifted) AS mean_synthetic, (SELECT stddev_samp({c}) FROM shifted) AS std_synthetic,
        {relative('avg', c)} AS mean_relative_diff, {relative('stddev_samp', c)} AS std_relative_diff"""
        for c in MONEY
    )
    cols = ["mean_original", "std_original", "mean_synthetic", "std_synthetic", "mean_relative_diff", "std_relative_diff"]
    score = "1 - (mean_relative_diff + std_relative_diff) / 2"
    return with_views(
        f"""SELECT "column", {', '.join(f'{r(c, 3)} AS {c}' for c in cols)}, {r(score, 3)} AS similarity_score, CAST(NULL AS BIGINT) AS columns_compared FROM per
        UNION ALL SELECT 'overall', {', '.join('NULL' for _ in cols)}, {r(f'avg({score})', 3)}, CAST(count(*) AS BIGINT) FROM per""",
        SHIFTED_CTE, f"per AS ({per})",
    )


def fidelity_sql() -> str:
    per = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'(SELECT avg({c}) FROM person)', 3)} AS mean_real, {r(f'(SELECT stddev_pop({c}) FROM person)', 3)} AS std_real,
        {r(f'(SELECT avg({c}) FROM shifted)', 3)} AS mean_synthetic, {r(f'(SELECT stddev_pop({c}) FROM shifted)', 3)} AS std_synthetic,
        CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS correlation_mae"""
        for c in MONEY
    )
    a, b = MONEY
    gap = f"abs((SELECT corr({a}, {b}) FROM person) - (SELECT corr({a}, {b}) FROM shifted))"
    mae = f"""(SELECT sum(coalesce(abs(p.{a} - s.{a}), 0) + coalesce(abs(p.{b} - s.{b}), 0)) / (count(p.{a} - s.{a}) + count(p.{b} - s.{b})) FROM person p JOIN shifted s USING (id))"""
    return with_views(f"{per} UNION ALL SELECT 'overall', NULL, NULL, NULL, NULL, {r(mae, 3)}, {r(f'2 * {gap} / 4', 3)}", SHIFTED_CTE)


def quality_sql() -> str:
    none = "CAST(NULL AS VARCHAR)"
    types = {"string": 11, "date": 1, "double": 2}
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    texts = [c for c in COLS if c not in TYPES]
    return with_views(
        f"""SELECT metric, {none} AS "column", {none} AS key, {r('value', 4)} AS value FROM (
          SELECT unnest(['rows', 'columns', 'missing_values', 'missing_percentage']) AS metric,
                 unnest([n, {len(COLS)}, m, 100e0 * m / (n * {len(COLS)})]) AS value
          FROM (SELECT count(*) AS n, sum({nulls(COLS)}) AS m FROM shifted))
        UNION ALL {' UNION ALL '.join(f"SELECT 'data_types', NULL, '{t}', CAST({n} AS DOUBLE)" for t, n in types.items())}
        UNION ALL {' UNION ALL '.join(f"SELECT 'numerical_stats', \"column\", '{s}', CAST({s} AS DOUBLE) FROM stats" for s in stats)}
        UNION ALL SELECT 'categorical_stats', "column", value, CAST(count AS DOUBLE) FROM ({value_counts_sql('shifted', texts)})""",
        SHIFTED_CTE, f"stats AS ({describe_sql('shifted', MONEY, 4)})",
    )


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def compare_lines_sql() -> str:
    """lineitem against its rows above line 1: equal columns, all numeric ones."""
    none = "CAST(NULL AS VARCHAR)"
    width = "(SELECT count(*) FROM (DESCRIBE lineitem))"
    figures = {"row_ratio": "CAST((SELECT count(*) FROM part_) AS DOUBLE) / (SELECT count(*) FROM lineitem)", "column_ratio": "1e0", "common_columns": width, "column_overlap": "1e0"}
    stats = {"mean_original": ("avg", "lineitem"), "mean_synthetic": ("avg", "part_"), "std_original": ("stddev_samp", "lineitem"), "std_synthetic": ("stddev_samp", "part_")}
    rows = [f"SELECT '{m}' AS metric, {none} AS \"column\", {r(f'CAST({e} AS DOUBLE)', 3)} AS value" for m, e in figures.items()]
    rows += [f"SELECT '{m}', '{c}', {r(f'(SELECT {f}(CAST({c} AS DOUBLE)) FROM {t})', 3)}" for m, (f, t) in stats.items() for c in LINE_NUMBERS]
    return f"WITH part_ AS (SELECT * FROM lineitem WHERE l_linenumber > 1) {' UNION ALL '.join(rows)}"


def compare_sql() -> str:
    none = "CAST(NULL AS VARCHAR)"
    figures = {
        "row_ratio": "CAST((SELECT count(*) FROM shifted) AS DOUBLE) / (SELECT count(*) FROM wide)",
        "column_ratio": f"{len(COLS)} / {len(WIDE)}e0",
        "common_columns": f"{len(COLS)}",
        "column_overlap": f"{len(COLS)} / {len(WIDE)}e0",
    }
    stats = {"mean_original": ("avg", "wide"), "mean_synthetic": ("avg", "shifted"), "std_original": ("stddev_samp", "wide"), "std_synthetic": ("stddev_samp", "shifted")}
    rows = [f"SELECT '{m}' AS metric, {none} AS \"column\", {r(e, 3)} AS value" for m, e in figures.items()]
    rows += [f"SELECT '{m}', '{c}', {r(f'(SELECT {f}({c}) FROM {t})', 3)}" for m, (f, t) in stats.items() for c in MONEY]
    return with_views(" UNION ALL ".join(rows), WIDE_CTE, SHIFTED_CTE)


def fact(family: str, metric: str, param: str | None, field: str, number: str = "CAST(NULL AS DOUBLE)", text: str = "CAST(NULL AS VARCHAR)") -> str:
    label = f"'{param}'" if param else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{family}' AS family, '{metric}' AS metric, {label} AS param, '{field}' AS field, {number} AS value_num, {text} AS value_str"


def validation_parts(original: str, anonymised: str, qi: list[str], sensitive: list[str], numbers: list[str], width: int) -> tuple[str, list[str]]:
    """Privacy, similarity and shape of two tables as metric rows."""
    privacy, ctes = privacy_parts(anonymised, qi, sensitive)
    facts, scores = [], []
    for c in numbers:
        stats = {
            f"{stat}_{side}": f"(SELECT {f}({c}) FROM {t})"
            for side, t in (("original", original), ("synthetic", anonymised))
            for stat, f in (("mean", "avg"), ("std", "stddev_samp"))
        }
        gaps = {f"{x}_relative_diff": f"abs({stats[x + '_synthetic']} - {stats[x + '_original']}) / (abs({stats[x + '_original']}) + 1e-8)" for x in ("mean", "std")}
        score = f"1 - ({gaps['mean_relative_diff']} + {gaps['std_relative_diff']}) / 2"
        scores.append(f"({score})")
        facts += [fact("utility", "statistical_similarity", f"column={c}", n, e) for n, e in {**stats, **gaps, "similarity_score": score}.items()]
    facts.append(fact("utility", "statistical_similarity", "column=overall", "similarity_score", f"({' + '.join(scores)}) / {len(numbers)}"))
    facts.append(fact("utility", "statistical_similarity", "column=overall", "columns_compared", f"{len(numbers)}"))
    for side, t in (("original", original), ("anonymised", anonymised)):
        facts.append(fact("dataset_info", "shape", f"side={side}", "rows", f"(SELECT count(*) FROM {t})"))
        facts.append(fact("dataset_info", "shape", f"side={side}", "columns", str(width)))
    facts.append(fact("dataset_info", "columns", None, "quasi_identifiers", text=f"'{','.join(qi)}'"))
    facts.append(fact("dataset_info", "columns", None, "sensitive_attributes", text=f"'{','.join(sensitive)}'"))
    body = " UNION ALL ".join([privacy, *facts])
    return f"SELECT family, metric, param, field, {r('value_num', 3)} AS value_num, value_str FROM ({body})", ctes


def validate_sql() -> str:
    body, ctes = validation_parts("person", "masked", ["zip", "race", "city", "state"], ["gender", *MONEY], MONEY, len(COLS))
    return with_views(body, SHIFTED_CTE, f"masked AS (SELECT {listed(COLS, **MASKS)} FROM shifted)", *ctes)


def anonymise_no_synthesis_sql() -> str:
    body, ctes = validation_parts(
        "aged", "masked", ["age", "zip", "race", "city", "state"], ["gender", *MONEY],
        [*MONEY, "age", "birth_month", "birth_year"], len(AGED_COLS),
    )
    structure = ["total_records", "total_columns", "missing_values", "duplicate_records"]
    facts = " UNION ALL ".join(fact("profile", "structure", None, f, f"CAST((SELECT {f} FROM structure) AS DOUBLE)") for f in structure)
    return with_views(
        f"SELECT 'original' AS dataset, * FROM ({facts}) UNION ALL SELECT 'pseudonymised', * FROM ({body})",
        AGED_CTE, f"masked AS (SELECT {listed(AGED_COLS, **MASKS, id=keyed('id'))} FROM aged)", *ctes,
        f"structure AS ({profile_sql('person', COLS)})",
    )


# --- synthesis -----------------------------------------------------------------------------------


def unit(key: str, purpose: str, seed: int = 42) -> str:
    return f"CAST(CAST('0x' || substr(md5({key} || '|{purpose}|{seed}'), 1, 13) AS BIGINT) AS DOUBLE) / {UNIT}"


def bins(c: str) -> str:
    edges = "[" + ", ".join(f"0.{i}" for i in range(1, 10)) + "]"
    return f"coalesce(CAST(list_sum(list_transform((SELECT quantile_cont({c}, {edges}) FROM aged), lambda e: CAST({c} > e AS INT))) AS VARCHAR), '?')"


#: Rows are numbered by id, then by the other columns in the order in which the model takes them.
ROW_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("id", *CONDITION, *TARGET))
MODEL_CTES = [
    AGED_CTE,
    f"""binned AS MATERIALIZED (SELECT *, {bins('healthcare_expenses')} AS bin_e,
        CASE WHEN healthcare_coverage IS NULL THEN '?' ELSE {bins('healthcare_coverage')} END AS bin_c FROM aged)""",
    f"""cells AS MATERIALIZED (SELECT *, '0|' || coalesce(gender, '?') || '|' || bin_e || '|' || bin_c || '|' || coalesce(age_group, '?') AS c0,
        '1|' || coalesce(age_group, '?') AS c1, '2' AS c2, row_number() OVER (ORDER BY {ROW_ORDER}) - 1 AS n FROM binned)""",
    """counted AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY c0) AS n0, count(*) OVER (PARTITION BY c1) AS n1, count(*) OVER () AS n2 FROM cells)""",
    """routed AS MATERIALIZED (SELECT *, CASE WHEN n0 >= 20 THEN c0 WHEN n1 >= 20 THEN c1 ELSE c2 END AS cell,
        CASE WHEN n0 >= 20 THEN n0 WHEN n1 >= 20 THEN n1 ELSE n2 END AS size FROM counted)""",
    f"""donors AS MATERIALIZED (SELECT d.cell, CAST(row_number() OVER (PARTITION BY d.cell ORDER BY CAST('0x' || substr(md5(CAST(n AS VARCHAR)), 1, 13) AS BIGINT), n) AS BIGINT) AS rank, {', '.join(TARGET)}
        FROM (SELECT c0 AS cell, * EXCLUDE (cell) FROM routed UNION ALL SELECT c1, * EXCLUDE (cell) FROM routed UNION ALL SELECT c2, * EXCLUDE (cell) FROM routed) d
        WHERE d.cell IN (SELECT cell FROM routed))""",
]


def sampled_cte(source: str, key: str, seed: int) -> str:
    """One request per row and target column, answered by the donor of that rank."""
    requests = " UNION ALL ".join(
        f"SELECT {key}, '{c}' AS asked, cell, 1 + CAST(floor({unit(f'CAST({key} AS VARCHAR)', c, seed)} * size) AS BIGINT) AS rank FROM {source}"
        for c in TARGET
    )
    picks = ", ".join(f"max({c}) FILTER (asked = '{c}') AS {c}" for c in TARGET)
    conditions = ", ".join(f"s.{c} AS {c}" for c in CONDITION)
    return f"""requests AS MATERIALIZED ({requests}),
  drawn AS MATERIALIZED (SELECT {key}, {picks} FROM requests JOIN donors USING (cell, rank) GROUP BY {key}),
  sampled AS (SELECT d.*{", s.id" if key == "n" else ""}, {conditions} FROM drawn d JOIN {source} s USING ({key}))"""


SAMPLE_COLS = ", ".join([*TARGET, "gender", f"{r('healthcare_expenses')} AS healthcare_expenses", f"{r('healthcare_coverage')} AS healthcare_coverage", "age_group"])
RESAMPLED_CTES = [
    "indexed AS MATERIALIZED (SELECT * EXCLUDE (n), n AS row_index FROM routed)",
    f"""resampled AS MATERIALIZED (SELECT d.draw, i.* EXCLUDE (id) FROM
        (SELECT i AS draw, CAST(floor({unit('CAST(i AS VARCHAR)', 'row', 7)} * (SELECT count(*) FROM routed)) AS BIGINT) AS row_index
         FROM range(0, CAST((SELECT 2 * count(*) FROM routed) AS BIGINT)) g(i)) d JOIN indexed i USING (row_index))""",
]


def draw_int(purpose: str, low: int, high: int) -> str:
    return f"CAST({low} + CAST(floor({unit('CAST(n AS VARCHAR)', purpose)} * {high - low}) AS BIGINT) AS VARCHAR)"


IDENTITIES = {
    "id": "printf('synth_%06d', n)",
    "ssn": f"{draw_int('ssn-area', 100, 999)} || '-' || {draw_int('ssn-group', 10, 99)} || '-' || {draw_int('ssn-serial', 1000, 9999)}",
    "first": "printf('Synthetic_First_%03d', n)",
    "last": "printf('Synthetic_Last_%03d', n)",
    "address": "'Address_Redacted'",
}


# --- chart data ----------------------------------------------------------------------------------


def histogram_sql(source: str, c: str, n_bins: int, *ctes: str) -> str:
    width = f"((SELECT hi - lo FROM rng) / {n_bins})"
    return with_views(
        f"""SELECT series, bin, {r(f'(SELECT lo FROM rng) + (bin - 1) * {width}')} AS bin_start, {r(f'(SELECT lo FROM rng) + (bin - 1) * {width} + {width}')} AS bin_end,
        CAST(count(*) AS BIGINT) AS count
        FROM (SELECT series, CAST(least(floor(({c} - lo) * {n_bins} / (hi - lo)) + 1, {n_bins}) AS BIGINT) AS bin FROM {source}, rng WHERE {c} IS NOT NULL)
        GROUP BY series, bin""",
        *ctes, f"rng AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {source})",
    )


def from_file(sql: str) -> str:
    """The same over what a CSV file gives back: blank cells are nulls."""
    view = f"person AS ({views.PERSON_SQL})"
    assert view in sql
    return sql.replace(view, f"whole AS ({views.PERSON_SQL}), person AS (SELECT {listed(COLS, **CSV_BLANKS)} FROM whole)", 1)


def density_sql(source: str, cols: list[str], digits: int, *ctes: str) -> str:
    """Every bin of every series and column, with its edges; a bin without values counts 0."""
    parts = []
    for c in cols:
        ranges = f"(SELECT series, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n FROM {source} GROUP BY series)"
        start = "CASE WHEN hi = lo THEN lo + (bin - 1) * (1e0 / 30) ELSE lo + (bin - 1) * ((hi - lo) / 30) END"
        end = "CASE WHEN hi = lo THEN lo + bin * (1e0 / 30) ELSE lo + bin * ((hi - lo) / 30) END"
        width = "CASE WHEN hi = lo THEN 1e0 / 30 ELSE (hi - lo) / 30 END"
        parts.append(
            f"""SELECT series, '{c}' AS "column", bin, {r(start, 4)} AS bin_start, {r(end, 4)} AS bin_end, CAST(coalesce(k, 0) AS BIGINT) AS count,
            {r(f'coalesce(k, 0) / (n * ({width}))', digits)} AS density
            FROM (SELECT *, CAST(unnest(range(1, 31)) AS BIGINT) AS bin FROM {ranges})
            LEFT JOIN (SELECT series, CASE WHEN lo = hi THEN 1 ELSE CAST(least(floor((CAST({c} AS DOUBLE) - lo) * 30 / (hi - lo)) + 1, 30) AS BIGINT) END AS bin, count(*) AS k
                       FROM {source} JOIN {ranges} USING (series) WHERE {c} IS NOT NULL GROUP BY ALL) USING (series, bin)"""
        )
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def box_sql(source: str, c: str, *ctes: str) -> str:
    within = f"{c} BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)"
    return with_views(
        f"""SELECT series, CAST(count({c}) AS BIGINT) AS count, {r(f'min({c})', 4)} AS min, {r(f'min({c}) FILTER ({within})', 4)} AS whisker_low,
        {r('max(q1)', 4)} AS q1, {r('max(q2)', 4)} AS median, {r('max(q3)', 4)} AS q3, {r(f'max({c}) FILTER ({within})', 4)} AS whisker_high,
        {r(f'max({c})', 4)} AS max, CAST(count({c}) - count(*) FILTER ({within}) AS BIGINT) AS outliers
        FROM {source} JOIN (SELECT series, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {source} GROUP BY series) USING (series)
        GROUP BY series""",
        *ctes,
    )


EVENTS_CTE = "series_events AS (SELECT 'events' AS series, value FROM events)"
PLACE = ["race", "state", "city"]
PLACE_ZIP = PLACE + ["zip"]
FINE = PLACE + ["zip", "gender"]
CSV_BLANKS = {"first": "nullif(first, '')", "address": "nullif(address, '')"}
CLEANED_CTES = [
    DOUBLED_CTE,
    "uniq AS (SELECT DISTINCT * FROM doubled)",
    "cleaned AS (SELECT {} FROM uniq)".format(
        ", ".join(
            c if c in ("id", "birthdate") else f"coalesce({c}, {median_of(c, 'uniq') if c in MONEY else mode_of(c, 'uniq')}) AS {c}"
            for c in COLS
        )
    ),
]
BLANKED_CTE = f"blanked AS (SELECT {listed(COLS, **CSV_BLANKS)} FROM person)"


def onehot(c: str, levels: list[str]) -> str:
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in levels)


PERSON_NAMES = [c.lower() for c in PERSON_COLUMNS]


def plain_value(c: str) -> str:
    return r(c) if c in ("lat", "lon", *MONEY) else f"CAST({c} AS VARCHAR)" if c == "birthdate" else c


def synthesised_sql(people: str | None = None) -> str:
    """All columns of the synthetic table: drawn and preserved ones, made-up identities, nulls for what the input lacks."""
    drawn = {c: plain_value(c) for c in (*CONDITION, *TARGET) if c in PERSON_NAMES}
    columns = ", ".join(f"{ {**drawn, **IDENTITIES}.get(c, 'NULL') } AS {c}" for c in PERSON_NAMES)
    ctes = [*MODEL_CTES, sampled_cte("routed", "n", 42)]
    if not people:
        return with_views(f"SELECT {columns} FROM sampled", *ctes)
    return f"WITH {', '.join([f'whole AS ({views.PERSON_SQL})', f'person AS ({people.replace("FROM person", "FROM whole")})', *ctes])} SELECT {columns} FROM sampled"


def oracles() -> dict[str, str]:
    gm = ["gender", "marital"]
    keyed_row = {**MASKS, **REDACTIONS, "id": keyed("id")}
    return {
        "read_people": with_views(people(**CSV_BLANKS)),
        "read_first_people": with_views(people(**CSV_BLANKS) + " ORDER BY healthcare_expenses, id LIMIT 100"),
        "first_people_unordered": with_views("SELECT least(100, count(*)) AS n FROM person"),
        "csv_round_trip": with_views("SELECT id, nullif(address, '') AS address, city, healthcare_expenses FROM quoted", f"quoted AS ({views.QUOTED_PERSON_SQL})"),
        "csv_split": with_views("SELECT id, nullif(address, '') AS address, city, healthcare_expenses FROM quoted", f"quoted AS ({views.QUOTED_PERSON_SQL})"),
        "write_table": with_views(people()),
        "feature_store": FEATURE_ROWS,
        "parameter_store": with_views(
            f"""SELECT s.id, g.code AS gender, k.code AS race,
            {r('(s.healthcare_expenses - (SELECT avg(healthcare_expenses) FROM person)) / (SELECT stddev_pop(healthcare_expenses) FROM person)')} AS healthcare_expenses
            FROM shifted s JOIN (SELECT gender, CAST(row_number() OVER (ORDER BY gender) - 1 AS BIGINT) AS code FROM person GROUP BY gender) g USING (gender)
            JOIN (SELECT race, CAST(row_number() OVER (ORDER BY race) - 1 AS BIGINT) AS code FROM person GROUP BY race) k USING (race)""",
            SHIFTED_CTE,
        ),
        "mapping_store": with_views("SELECT id AS original, CAST(1 AS BIGINT) AS pseudonyms, CAST(36 AS BIGINT) AS pseudonym_length FROM person"),
        "report_store": privacy_report_sql(PLACE, gm, prefix="'person' AS dataset,"),
        "stream_ingest": with_views(people(**MASKS, id=keyed("id"))),
        "stream_ingest_mapped": with_views(f"SELECT {listed([c for c in COLS if c != 'id'], **DATED, **MASKS)} FROM person"),
        "stream_ingest_mapped_ids": with_views("SELECT COUNT(*) AS n, COUNT(id) AS ids, COUNT(DISTINCT id) AS distinct_ids FROM person"),
        "stream_report": privacy_report_sql(PLACE, gm),
        "profile": with_views(profile_sql("doubled", COLS), DOUBLED_CTE),
        "profile_lineitem": profile_sql("lineitem", LINEITEM),
        "missing_by_column": with_views(
            "SELECT * FROM ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count, {r(f'100e0 * (count(*) - count({c})) / count(*)')} AS missing_pct FROM person"
                for c in COLS
            )
            + ") WHERE missing_count > 0"
        ),
        "dtype_counts": with_views(
            'SELECT "table", dtype, CAST(count(*) AS BIGINT) AS columns, CAST(sum(cells) AS BIGINT) AS known_cells FROM ('
            + " UNION ALL ".join(
                f"SELECT '{t}' AS \"table\", '{types.get(c, 'string')}' AS dtype, count({c}) AS cells FROM {t}"
                for t, cols, types in (("person", COLS, TYPES), ("lineitem", LINEITEM, LINEITEM_TYPES))
                for c in cols
            )
            + ') GROUP BY "table", dtype'
        ),
        "column_catalogue": with_views(
            f"""SELECT "table", CAST(position AS INT) AS position, "column", {role_sql('"column"', ANONYMISATION_RULES)} AS role,
            {role_sql('"column"', CONTENT_RULES)} AS content, kind, n_rows, n_missing, n_distinct FROM (
            {catalogue_sql('wide', WIDE, TYPES).replace("SELECT 'wide'", "SELECT 'person'")} UNION ALL {catalogue_sql('orders', ORDERS, ORDERS_TYPES)})""",
            WIDE_CTE,
        ),
        "column_catalogue_token": with_views(
            f"""SELECT "column", {role_sql('"column"', ANONYMISATION_RULES, token=True)} AS role,
            {role_sql('"column"', CONTENT_RULES, token=True)} AS content, n_rows, n_missing FROM ({catalogue_sql('wide', WIDE, TYPES)})""",
            WIDE_CTE,
        ),
        "dataset_stats": with_views(
            f"{stats_sql('person', 'person', COLS)} UNION ALL {stats_sql('pseudonymised', 'masked', WIDE)}",
            WIDE_CTE, f"masked AS (SELECT {listed(WIDE, **MASKS, **REDACTIONS)} FROM wide)",
        ),
        "describe": with_views(describe_sql("person", MONEY, 4)),
        "describe_lineitem": describe_sql("lineitem", LINEITEM_NUMBERS, 4),
        "value_counts": with_views(value_counts_sql("person", [c for c in COLS if c not in TYPES])),
        "value_counts_lineitem": value_counts_sql("lineitem", ["l_returnflag", "l_linestatus"]),
        "dedupe": with_views(f"SELECT DISTINCT {listed(COLS, **DATED)} FROM doubled", DOUBLED_CTE),
        "impute_median_exact": """WITH known AS (SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN 9007199254740992 + l_orderkey END AS big,
              CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS DECIMAL(12, 2)) END AS exact FROM lineitem),
            ranked AS (SELECT big, row_number() OVER (ORDER BY big) AS k, count(*) OVER () AS n FROM known WHERE big IS NOT NULL),
            middle AS (SELECT CAST(sum(big) // count(*) AS BIGINT) AS m FROM ranked WHERE k IN ((n + 1) // 2, n // 2 + 1))
            SELECT l_orderkey, max(coalesce(big, (SELECT m FROM middle))) AS big,
              CAST(max(coalesce(exact, CAST((SELECT quantile_cont(exact, 0.5) FROM known) AS DECIMAL(12, 2)))) AS DOUBLE) AS exact FROM known GROUP BY l_orderkey""",
        "impute_median": with_views(
            f"""SELECT id, marital, zip, city, gender, {r(f"coalesce(healthcare_expenses, {median_of('healthcare_expenses', 'gapped')})", 3)} AS healthcare_expenses,
            {r(f"coalesce(healthcare_coverage, {median_of('healthcare_coverage', 'gapped')})", 3)} AS healthcare_coverage, passport, lat, lon FROM gapped""",
            GAPPED_CTE,
        ),
        "impute_mode": with_views(
            f"SELECT id, coalesce(marital, {mode_of('marital', 'gapped')}) AS marital, coalesce(zip, {mode_of('zip', 'gapped')}) AS zip, 'Unknown' AS passport FROM gapped",
            GAPPED_CTE,
        ),
        "sparse_columns": with_views("SELECT id, marital, zip, city, gender, healthcare_expenses, healthcare_coverage, lon FROM gapped", GAPPED_CTE),
        "sparse_rows": with_views(f"SELECT id, marital, zip FROM gapped WHERE {nulls(['id', 'birthdate', 'marital', 'zip', 'passport', 'lat'])} <= 3", GAPPED_CTE),
        "fill_directional": with_views(f"SELECT id, CAST({filled('birthdate')} AS VARCHAR) AS birthdate, {', '.join(f'{filled(c)} AS {c}' for c in COLS[2:])} FROM person"),
        "fill_directional_by": with_views(
            "SELECT id, gender, CAST({} AS VARCHAR) AS birthdate, {} FROM person".format(
                filled("birthdate", "PARTITION BY gender ORDER BY id"),
                ", ".join(f"{filled(c, 'PARTITION BY gender ORDER BY id')} AS {c}" for c in ("ssn", "zip", "marital")),
            )
        ),
        "fill_constant": with_views("SELECT id, coalesce(healthcare_expenses, 0e0) AS healthcare_expenses, coalesce(lat, 0e0) AS lat FROM gapped", GAPPED_CTE),
        "clean": with_views(people("cleaned"), *CLEANED_CTES),
        "clean_gaps": with_views(
            f"""SELECT id, coalesce(marital, {mode_of('marital', 'gapped')}) AS marital, coalesce(zip, {mode_of('zip', 'gapped')}) AS zip, city, gender,
            coalesce(healthcare_expenses, {median_of('healthcare_expenses', 'gapped')}) AS healthcare_expenses,
            coalesce(healthcare_coverage, {median_of('healthcare_coverage', 'gapped')}) AS healthcare_coverage, 'Unknown' AS passport, lon FROM gapped""",
            GAPPED_CTE,
        ),
        "clean_report": with_views(
            f"""SELECT 'before' AS stage, CAST(count(*) AS BIGINT) AS n_rows, CAST({len(COLS)} AS BIGINT) AS n_columns FROM doubled
            UNION ALL SELECT 'after', CAST(count(*) AS BIGINT), CAST({len(COLS)} AS BIGINT) FROM (SELECT DISTINCT * FROM doubled)""",
            DOUBLED_CTE,
        ),
        "preprocess": with_views(
            "SELECT {} FROM blanked".format(
                ", ".join(
                    "CAST(birthdate AS VARCHAR) AS birthdate" if c == "birthdate"
                    else c if c == "id"
                    else f"coalesce({c}, {median_of(c, 'blanked') if c in MONEY else mode_of(c, 'blanked')}) AS {c}"
                    for c in COLS
                )
            ),
            BLANKED_CTE,
        ),
        "parse_dates": with_views("SELECT id, CASE WHEN id LIKE '%5' THEN NULL ELSE CAST(birthdate AS VARCHAR) END AS birthdate FROM person"),
        "age_features": with_views("SELECT id, age, birth_month, birth_year, age_group FROM aged", AGED_CTE),
        "bucketize": """SELECT CASE WHEN o_totalprice <= 0 THEN NULL WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'middle'
            WHEN o_totalprice <= 300000 THEN 'high' END AS band, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY band""",
        "minmax": with_views(f"SELECT id, {', '.join(f'{minmax(c)} AS {c}' for c in [*MONEY, 'lon'])} FROM gapped", GAPPED_CTE),
        "minmax_lineitem": f"SELECT l_orderkey, l_linenumber, {minmax('l_quantity')} AS l_quantity, {minmax('l_extendedprice')} AS l_extendedprice FROM lineitem",
        "standard": with_views(f"SELECT id, {', '.join(f'{standard(c)} AS {c}' for c in [*MONEY, 'lon'])} FROM gapped", GAPPED_CTE),
        "label_encode": with_views(f"SELECT id, {', '.join(f'{coded(c)} AS {c}' for c in ('race', 'marital', 'city', 'zip', 'last'))} FROM person"),
        "onehot": with_views(
            f"SELECT id, {onehot('race', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])}, {onehot('marital', ['M', 'S'])} FROM person"
        ),
        "onehot_cities": with_views(
            "SELECT id, CAST(id LIKE '%1' AS INTEGER) AS dotted, CAST(id LIKE '%2' AS INTEGER) AS upper, CAST(NOT (id LIKE '%1' OR id LIKE '%2') AS INTEGER) AS lower FROM person"
        ),
        "split_features": FEATURE_ROWS,
        "prepare_features": with_views(f"SELECT {', '.join(AGED_COLS)} FROM prepared", AGED_CTE, FILLED_CTE, PREPARED_CTE),
        "pseudonymise_id": with_views(
            "SELECT last, CAST(1 AS BIGINT) AS pseudonyms, CAST(count(*) AS BIGINT) AS n, CAST(36 AS BIGINT) AS id_length FROM doubled GROUP BY last", DOUBLED_CTE
        ),
        "pseudonymise_id_keyed": with_views(f"SELECT {keyed('id')} AS id, last FROM person"),
        "pseudonymise_hash": with_views(f"SELECT {listed(['id', 'ssn', 'first', 'last', 'address', 'city', 'state', 'zip'], **MASKS)} FROM person"),
        "redact": with_views(f"SELECT {listed(['id', 'drivers', 'passport', 'maiden', 'lat', 'lon'], **REDACTIONS)} FROM wide", WIDE_CTE),
        "pseudonymise_table": with_views(f"SELECT {listed(WIDE, **DATED, **keyed_row)} FROM wide", WIDE_CTE),
        "mapping_stats": with_views(
            """SELECT 'person' AS namespace, CAST(count(*) AS BIGINT) AS total_mappings, CAST(count(DISTINCT id) AS BIGINT) AS distinct_originals, CAST(0 AS BIGINT) AS duplicates FROM person
            UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT), CAST(count(DISTINCT c_custkey) AS BIGINT), CAST(0 AS BIGINT) FROM customer"""
        ),
        "equivalence_classes": with_views("SELECT * FROM classes", classes_cte("person", PLACE_ZIP)),
        "equivalence_classes_with_nulls": with_views("SELECT * FROM classes", classes_cte("person", PLACE_ZIP, keep_nulls=True)),
        "k_anonymity": with_views(k_sql(), classes_cte("person", FINE)),
        "k_anonymity_orders": with_views(k_sql(), classes_cte("orders", ["o_orderpriority", "o_orderstatus"])),
        "k_anonymity_order_customers": with_views(k_sql(), classes_cte("orders", ["o_orderpriority", "o_orderstatus", "o_custkey"])),
        "k_anonymity_detail": with_views(k_sql((2, 3, 5, 10, 20), detail=True), classes_cte("person", FINE)),
        "l_diversity": with_views(l_sql(gm), l_cte("person", PLACE, gm)),
        "l_diversity_lineitem": with_views(l_sql(["l_linestatus", "l_quantity"]), l_cte("lineitem", ["l_suppkey", "l_returnflag"], ["l_linestatus", "l_quantity"])),
        "l_diversity_overlap": with_views(l_sql(gm), l_cte("person", [*PLACE, "gender"], gm)),
        "l_diversity_detail": with_views(l_sql(gm, detail=True), l_cte("person", PLACE, gm)),
        "t_closeness": with_views(t_sql(gm), *t_ctes("person", PLACE, gm)),
        "t_closeness_lineitem": with_views(t_sql(["l_returnflag", "l_quantity"]), *t_ctes("lineitem", ["l_suppkey"], ["l_returnflag", "l_quantity"])),
        "t_closeness_detail": with_views(t_sql(gm, detail=True), *t_ctes("person", PLACE, gm)),
        "reid_risk": with_views(RISK, classes_cte("person", FINE, keep_nulls=True)),
        "risk_detail": with_views(RISK_DETAIL, classes_cte("person", FINE, keep_nulls=True)),
        "privacy_report": privacy_report_sql(PLACE_ZIP, gm),
        "holdout_split": with_views(f"SELECT id, {unit('id', 'holdout')} < 0.3e0 AS is_test FROM person"),
        "similarity": similarity_sql(),
        "matrix_fidelity": fidelity_sql(),
        "synthetic_quality": quality_sql(),
        "compare_tables": compare_sql(),
        "compare_tables_lineitem": compare_lines_sql(),
        "model_utility_known": """SELECT feature, model, 'gender' AS target, 1e0 AS accuracy_original, good AS accuracy_synthetic, good - 1e0 AS accuracy_difference,
            1e0 AS auc_original, good AS auc_synthetic, good = 1e0 AS utility_preserved
            FROM (VALUES ('same', 1e0), ('turned', 0e0)) f(feature, good), (VALUES ('random_forest'), ('logistic_regression')) m(model)""",
        "validate": validate_sql(),
        "anonymise_no_synthesis": anonymise_no_synthesis_sql(),
        "anonymise_files": from_file(anonymise_no_synthesis_sql()),
        "fit_conditional": with_views("SELECT * FROM donors", *MODEL_CTES),
        "sample_conditional": with_views(f"SELECT id, {SAMPLE_COLS} FROM sampled", *MODEL_CTES, sampled_cte("routed", "n", 42)),
        "sample_conditional_n": with_views(f"SELECT draw, {SAMPLE_COLS} FROM sampled", *MODEL_CTES, *RESAMPLED_CTES, sampled_cte("resampled", "draw", 7)),
        "assemble_synthetic": with_views("SELECT id, zip, race, gender FROM person"),
        "synthetic_identities": with_views(
            f"SELECT gender, 'DRIVERS_Redacted' AS drivers, 'LAT_Redacted' AS lat, {', '.join(f'{e} AS {c}' for c, e in IDENTITIES.items())} FROM (SELECT gender, row_number() OVER (ORDER BY id) - 1 AS n FROM person)"
        ),
        "conform": with_views(
            "SELECT {} FROM wide".format(", ".join(f"{plain_value(c)} AS {c}" if c in WIDE else f"NULL AS {c}" for c in PERSON_NAMES)), WIDE_CTE
        ),
        "synthesise": synthesised_sql(),
        "synthesise_gaps": synthesised_sql(views.LOOSE_PERSON_SQL),
        "histogram": histogram_sql("pair", "healthcare_expenses", 20, SHIFTED_CTE, PAIR_CTE),
        "histogram_events": histogram_sql("series_events", "value", 50, EVENTS_CTE),
        "density_histogram": density_sql("pair", list(MONEY), 12, f"person AS ({views.PERSON_SQL})", SHIFTED_CTE, PAIR_CTE),
        "density_histogram_lineitem": density_sql("lines", LINE_NUMBERS, 9, "lines AS (SELECT 'lineitem' AS series, * FROM lineitem)"),
        "category_counts": with_views("SELECT series, gender AS value, CAST(count(*) AS BIGINT) AS count FROM pair GROUP BY series, gender", SHIFTED_CTE, PAIR_CTE),
        "box_stats": box_sql("pair", "healthcare_expenses", SHIFTED_CTE, PAIR_CTE),
        "box_stats_events": box_sql("series_events", "value", EVENTS_CTE),
        "k_achieved": with_views(f"SELECT k, CAST(achieved AS INT) AS achieved FROM ({k_sql()})", classes_cte("person", PLACE)),
    }
