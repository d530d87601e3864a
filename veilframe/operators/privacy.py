"""Privacy metrics over equivalence classes (rows that agree on all quasi-identifiers).

The class-level metrics all derive from one pre-aggregated value profile: rows per (class, attribute,
value). It has at most one row per distinct combination, so a class or a value that covers a third of
the table is a few rows here and never a group of raw rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.lookup import attach_totals
from veilframe.operators.shape import rows, text_of
from veilframe.schema import QUASI_IDENTIFIERS, SENSITIVE, present, require
from veilframe.session import materialise

KS = (2, 5, 10, 20)
KS_DETAIL = (2, 3, 5, 10, 20)
LS = (2, 3, 5)
TS = (0.1, 0.2, 0.3)
ACCEPTED_RATIO = 0.8
HIGH_RISK, MEDIUM_RISK = 0.8, 0.5
ATTRIBUTE, VALUE, ROWS = "_attribute", "_value", "_rows"
_EXACT = "decimal(38,0)"


def _checked(df: DataFrame, qi: Sequence[str]) -> list[str]:
    if not qi:
        raise ValueError("at least one quasi-identifier is needed")
    return require(df, qi)


def _complete(qi: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in qi])


def equivalence_classes(df: DataFrame, qi: Sequence[str], null_keys: str = "drop") -> DataFrame:
    """Class sizes. ``null_keys="drop"`` leaves out rows with a null quasi-identifier, ``"group"`` keeps
    null as a value."""
    qi = _checked(df, qi)
    if null_keys not in ("drop", "group"):
        raise ValueError("null_keys must be 'drop' or 'group'")
    kept = df.filter(_complete(qi)) if null_keys == "drop" else df
    return kept.groupBy(*qi).agg(F.count("*").alias("class_size"))


# --- k-anonymity ---------------------------------------------------------------------------------


def _k_rows(classes: DataFrame, ks: Sequence[int], detail: bool) -> DataFrame:
    size = F.col("class_size")
    totals = classes.agg(
        F.min(size).alias("lo"), F.max(size).alias("hi"), F.count("*").alias("n"),
        *[F.count_if(size < k).alias(f"b{k}") for k in ks],
    )
    out = []
    for k in ks:
        meeting = F.col("n") - F.col(f"b{k}")
        fields = [
            F.lit(k).alias("k"),
            F.coalesce(F.col("lo") >= k, F.lit(False)).alias("achieved"),
            F.col("lo").alias("min_group_size"),
            F.col("n").alias("total_groups"),
            F.col(f"b{k}").alias("groups_below_k"),
        ]
        if detail:
            fields += [
                F.col("hi").alias("max_group_size"),
                meeting.alias("groups_meeting_k"),
                F.try_divide(F.lit(100.0) * meeting, F.col("n")).alias("percentage_meeting_k"),
            ]
        out.append(F.struct(*fields))
    return rows(totals, out)


def k_anonymity(df: DataFrame, qi: Sequence[str], ks: Sequence[int] = KS) -> DataFrame:
    """Per k: is every class at least k large, and how many are not. One scan, one exchange."""
    return _k_rows(equivalence_classes(df, qi), ks, detail=False)


def k_anonymity_detail(df: DataFrame, qi: Sequence[str], ks: Sequence[int] = KS_DETAIL) -> DataFrame:
    return _k_rows(equivalence_classes(df, qi), ks, detail=True)


# --- value profile -------------------------------------------------------------------------------


def value_profile(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """(qi, attribute, value, rows), classes with null quasi-identifiers and null values included. The
    attribute is the position in ``sensitive``, which shuffles smaller than its name. A column may be both."""
    pairs = [F.struct(F.lit(i).alias(ATTRIBUTE), text_of(df, s).alias(VALUE)) for i, s in enumerate(sensitive)]
    cells = df.select(*qi, F.inline(F.array(*pairs)))
    return cells.groupBy(*qi, ATTRIBUTE, VALUE).agg(F.count("*").alias(ROWS))


def merged_profile(profiles: DataFrame, qi: Sequence[str]) -> DataFrame:
    """One profile of the rows of several: counts of equal cells are added."""
    return profiles.groupBy(*qi, ATTRIBUTE, VALUE).agg(F.sum(ROWS).alias(ROWS))


def _classes_of(profile: DataFrame, qi: Sequence[str]) -> DataFrame:
    """Class sizes from the profile: every row counts once under each attribute."""
    one = profile.filter(F.col(ATTRIBUTE) == 0)
    return one.groupBy(*qi).agg(F.sum(ROWS).alias("class_size"))


# --- l-diversity ---------------------------------------------------------------------------------


def _distinct_per_class(profile: DataFrame, qi: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    known = F.col(VALUE).isNotNull()
    counts = [F.count_if(known & (F.col(ATTRIBUTE) == i)).alias(f"_d{i}") for i in range(len(sensitive))]
    return profile.filter(_complete(qi)).groupBy(*qi).agg(*counts)


def _smallest(cols: Sequence[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def _l_rows(distinct: DataFrame, sensitive: Sequence[str], ls: Sequence[int], detail: bool) -> DataFrame:
    columns = [F.col(f"_d{i}") for i in range(len(sensitive))]
    totals = distinct.agg(
        F.count("*").alias("n"),
        *[F.count_if(_smallest(columns) >= v).alias(f"l{v}") for v in ls],
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)],
    )
    out = []
    for v in ls:
        ratio = F.coalesce(F.try_divide(F.col(f"l{v}"), F.col("n")), F.lit(0.0))
        base = [
            F.lit(v).alias("l"),
            (ratio >= ACCEPTED_RATIO).alias("achieved"),
            F.col(f"l{v}").alias("l_diverse_groups"),
            F.col("n").alias("total_groups"),
            ratio.alias("ratio"),
        ]
        if not detail:
            out.append(F.struct(*base))
            continue
        for i, s in enumerate(sensitive):
            extra = [F.lit(s).alias("attribute"), F.col(f"a{i}").alias("average_diversity")]
            out.append(F.struct(*base, *extra))
    return rows(totals, out)


def _l_metric(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str], ls: Sequence[int], detail: bool) -> DataFrame:
    qi, sensitive = _checked(df, qi), present(df, sensitive)
    if not sensitive:
        raise ValueError("no sensitive column found")
    distinct = _distinct_per_class(value_profile(df, qi, sensitive), qi, sensitive)
    return _l_rows(distinct, sensitive, ls, detail)


def l_diversity(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str], ls: Sequence[int] = LS) -> DataFrame:
    """A class is l-diverse if every sensitive column has at least l distinct known values in it.

    Distinct values are counted by grouping twice, which spreads a huge class over its values and needs
    no row expansion per distinct aggregate.
    """
    return _l_metric(df, qi, sensitive, ls, detail=False)


def l_diversity_detail(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str], ls: Sequence[int] = LS) -> DataFrame:
    """Adds the mean number of distinct values per sensitive column over the classes."""
    return _l_metric(df, qi, sensitive, ls, detail=True)


# --- t-closeness ---------------------------------------------------------------------------------


def _distances(profile: DataFrame, qi: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """Per class and attribute i: the total variation distance as an exact fraction _num{i} / _den{i}.

    With c_v rows of value v among N overall, c_gv among the n_g of class g:
    2*N*n_g*TV = N*n_g + sum over the values in g of (|c_v*n_g - c_gv*N| - c_v*n_g),
    because values absent from g add their overall share. All terms are integers.
    """
    known = F.when(F.col(VALUE).isNotNull(), F.col(ROWS))
    # Overall shares are taken over all rows, those with null quasi-identifiers included.
    kept = profile.filter(_complete(qi))
    shared = attach_totals(kept, profile, [ATTRIBUTE, VALUE], {"_value_rows": F.sum(ROWS)}, spread=qi)
    sized = attach_totals(
        shared,
        kept,
        [*qi, ATTRIBUTE],
        {"_class_rows": F.coalesce(F.sum(known), F.lit(0))},
        spread=[ATTRIBUTE, VALUE],
    )
    totals = profile.groupBy(ATTRIBUTE).agg(F.coalesce(F.sum(known), F.lit(0)).alias("_all_rows"))
    # One row per sensitive column.
    full = sized.join(F.broadcast(totals), ATTRIBUTE)

    def exact(name: str) -> Column:
        return F.col(name).cast("decimal(20,0)")

    c_v, c_gv, n_g, n = exact("_value_rows"), exact(ROWS), exact("_class_rows"), exact("_all_rows")
    term = (F.abs(c_v * n_g - c_gv * n) - c_v * n_g).cast(_EXACT)
    aggs = []
    for i in range(len(sensitive)):
        mine = F.col(ATTRIBUTE) == i
        aggs += [
            F.coalesce(F.sum(F.when(mine & F.col(VALUE).isNotNull(), term)), F.lit(0)).cast(_EXACT).alias(f"_sum{i}"),
            F.max(F.when(mine, n_g)).alias(f"_g{i}"),
            F.max(F.when(mine, n)).alias(f"_n{i}"),
        ]
    per_class = full.groupBy(*qi).agg(*aggs)
    out = []
    for i in range(len(sensitive)):
        g, n_i = F.col(f"_g{i}"), F.col(f"_n{i}")
        # A class without any known value is at 1/2; an attribute without any known value is at 0.
        num = F.when(n_i == 0, F.lit(0)).when(g == 0, F.lit(1)).otherwise((n_i * g).cast(_EXACT) + F.col(f"_sum{i}"))
        den = F.when((n_i == 0) | (g == 0), F.lit(2)).otherwise(F.lit(2) * (n_i * g).cast(_EXACT))
        out += [num.cast(_EXACT).alias(f"_num{i}"), den.cast(_EXACT).alias(f"_den{i}")]
    return per_class.select(*qi, *out)


def _t_rows(distances: DataFrame, sensitive: Sequence[str], ts: Sequence[float], detail: bool) -> DataFrame:
    def within(i: int, t: float) -> Column:
        num, den = Decimal(str(t)).as_integer_ratio()
        return (F.col(f"_num{i}") * F.lit(den)).cast(_EXACT) <= (F.col(f"_den{i}") * F.lit(num)).cast(_EXACT)

    close = [reduce(lambda a, b: a & b, [within(i, t) for i in range(len(sensitive))]) for t in ts]
    means = [F.avg(F.col(f"_num{i}").cast("double") / F.col(f"_den{i}").cast("double")).alias(f"a{i}") for i in range(len(sensitive))]
    totals = distances.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"t{j}") for j, c in enumerate(close)], *means)
    out = []
    for j, t in enumerate(ts):
        ratio = F.coalesce(F.try_divide(F.col(f"t{j}"), F.col("n")), F.lit(0.0))
        base = [
            F.lit(float(t)).alias("t"),
            (ratio >= ACCEPTED_RATIO).alias("achieved"),
            F.col(f"t{j}").alias("t_close_groups"),
            F.col("n").alias("total_groups"),
            ratio.alias("ratio"),
        ]
        if not detail:
            out.append(F.struct(*base))
            continue
        for i, s in enumerate(sensitive):
            extra = [F.lit(s).alias("attribute"), F.col(f"a{i}").alias("average_distance")]
            out.append(F.struct(*base, *extra))
    return rows(totals, out)


def _t_metric(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str], ts: Sequence[float], detail: bool) -> DataFrame:
    qi, sensitive = _checked(df, qi), present(df, sensitive)
    if not sensitive:
        raise ValueError("no sensitive column found")
    profile = materialise(value_profile(df, qi, sensitive), "profile")  # read several times below
    return _t_rows(_distances(profile, qi, sensitive), sensitive, ts, detail)


def t_closeness(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str], ts: Sequence[float] = TS) -> DataFrame:
    """A class is t-close if for every sensitive column the total variation distance between its value
    shares and the overall ones is at most t, compared exactly."""
    return _t_metric(df, qi, sensitive, ts, detail=False)


def t_closeness_detail(df: DataFrame, qi: Sequence[str], sensitive: Sequence[str], ts: Sequence[float] = TS) -> DataFrame:
    """Adds the mean total variation distance per sensitive column over the classes."""
    return _t_metric(df, qi, sensitive, ts, detail=True)


# --- re-identification risk ----------------------------------------------------------------------


def _risk_level(share: Column) -> Column:
    return F.when(share > HIGH_RISK, F.lit("HIGH")).when(share > MEDIUM_RISK, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def _risk_row(classes: DataFrame) -> DataFrame:
    totals = classes.agg(F.coalesce(F.sum("class_size"), F.lit(0)).alias("total_records"), F.count("*").alias("unique_combinations"))
    ratio = F.try_divide(F.col("unique_combinations"), F.col("total_records"))
    return totals.select("*", ratio.alias("uniqueness_ratio"), _risk_level(ratio).alias("risk_level"))


def reidentification_risk(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """Distinct quasi-identifier combinations per record; combinations with nulls count."""
    return _risk_row(equivalence_classes(df, qi, null_keys="group"))


def risk_detail(df: DataFrame, qi: Sequence[str]) -> DataFrame:
    """Records and classes by class size."""
    size = F.col("class_size")
    totals = equivalence_classes(df, qi, null_keys="group").agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("total_records"),
        F.count("*").alias("unique_combinations"),
        F.count_if(size == 1).alias("single_records"),
        F.count_if(size <= 3).alias("small_groups_1_3"),
        F.count_if((size >= 4) & (size <= 10)).alias("medium_groups_4_10"),
        F.count_if(size > 10).alias("large_groups_10_plus"),
    )
    single = F.try_divide(F.col("single_records"), F.col("total_records"))
    small = F.try_divide(F.col("small_groups_1_3"), F.col("total_records"))
    return totals.select(
        "*",
        (F.lit(100.0) * single).alias("single_record_risk_percentage"),
        (F.lit(100.0) * small).alias("small_group_risk_percentage"),
        _risk_level(single).alias("overall_risk_level"),
    )


# --- report --------------------------------------------------------------------------------------


def metric_rows(df: DataFrame, family: str, metric: str, param: str | None = None) -> DataFrame:
    """(family, metric, param, field, value_num, value_str), one row per cell of a metric table."""
    label = F.concat(F.lit(f"{param}="), F.col(param).cast("string")) if param else F.lit(None).cast("string")
    cells = []
    for c, t in df.dtypes:
        if c == param:
            continue
        if t == "boolean":
            number, text = F.col(c).cast("int").cast("double"), F.col(c).cast("string")
        elif t == "string":
            number, text = F.lit(None).cast("double"), F.col(c)
        else:
            number, text = F.col(c).cast("double"), F.lit(None).cast("string")
        cells.append(F.struct(F.lit(c).alias("field"), number.alias("value_num"), text.alias("value_str")))
    return df.select(
        F.lit(family).alias("family"), F.lit(metric).alias("metric"), label.alias("param"), F.inline(F.array(*cells))
    )


def privacy_report(
    df: DataFrame,
    qi: Sequence[str] = QUASI_IDENTIFIERS,
    sensitive: Sequence[str] = SENSITIVE,
) -> DataFrame:
    """k-anonymity, l-diversity, t-closeness and risk as metric rows, from one stored value profile."""
    qi, sensitive = _checked(df, present(df, qi)), present(df, sensitive)
    if not sensitive:
        parts = [("k_anonymity", k_anonymity(df, qi), "k"), ("reidentification_risk", reidentification_risk(df, qi), None)]
        return _report_rows(parts)
    return report_of_profile(materialise(value_profile(df, qi, sensitive), "profile"), qi, sensitive)


def report_of_profile(profile: DataFrame, qi: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """The privacy report of the rows that a (stored) value profile counts."""
    classes = _classes_of(profile, qi)
    return _report_rows(
        [
            ("k_anonymity", _k_rows(classes.filter(_complete(qi)), KS, detail=False), "k"),
            ("l_diversity", _l_rows(_distinct_per_class(profile, qi, sensitive), sensitive, LS, detail=False), "l"),
            ("t_closeness", _t_rows(_distances(profile, qi, sensitive), sensitive, TS, detail=False), "t"),
            ("reidentification_risk", _risk_row(classes), None),
        ]
    )


def _report_rows(parts: Sequence[tuple[str, DataFrame, str | None]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [metric_rows(table, "privacy", name, param) for name, table, param in parts])
