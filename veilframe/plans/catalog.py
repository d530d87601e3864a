"""The queries registered with the driver: every operator over whole tables.

Names are aliased and doubles rounded so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.dates import bucketize, parse_date
from veilframe.operators import charts, clean, features, models, ordered, privacy, profile, pseudonyms, roles, synthesis, utility
from veilframe.plans import person as views
from veilframe.plans import workflows
from veilframe.plans.person import person, variant
from veilframe.session import scratch_path
from veilframe.sources import mapping, report, store, tables
from veilframe.streaming.dropfolder import ingest_dropfolder, latest_report

AS_OF = "2024-01-01"
SECRET = "catalog"
PLACE = ["race", "state", "city"]
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def dated(df: DataFrame) -> DataFrame:
    """Dates as text, for comparison."""
    dates = [c for c, t in df.dtypes if t == "date"]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return variant(spark, sf, views.WIDE_PERSON_SQL)


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    return variant(spark, sf, views.SHIFTED_PERSON_SQL)


def doubled(spark: SparkSession, sf: str) -> DataFrame:
    return variant(spark, sf, views.DOUBLED_PERSON_SQL)


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    return variant(spark, sf, views.GAPPED_PERSON_SQL)


def table(name: str) -> Query:
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


lineitem, orders, events, customer = table("lineitem"), table("orders"), table("events"), table("customer")


def pair(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"original": person(spark, sf), "pseudonymised": shifted(spark, sf)}


# --- sources and sinks ---------------------------------------------------------------------------


def _people_csv(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    people, path = person(spark, sf), scratch_path(spark, "people")
    tables.write_table(people, path, "csv")
    return path, people


def read_people(spark: SparkSession, sf: str) -> DataFrame:
    path, people = _people_csv(spark, sf)
    return dated(tables.read_people(spark, path, schema=people.schema))


def read_first_people(spark: SparkSession, sf: str) -> DataFrame:
    path, people = _people_csv(spark, sf)
    return dated(tables.read_people(spark, path, n_records=100, order_by=["healthcare_expenses", "id"], schema=people.schema))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with newlines, quotes and commas, written and read again."""
    people, path = variant(spark, sf, views.QUOTED_PERSON_SQL), scratch_path(spark, "quoted")
    tables.write_table(people, path, "csv")
    return tables.read_people(spark, path, schema=people.schema)


def csv_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same cells from files that are cut into splits wherever a line ends."""
    people, path = variant(spark, sf, views.QUOTED_PERSON_SQL), scratch_path(spark, "quoted")
    tables.write_table(people, path, "csv")
    return tables.read_people(spark, path, schema=people.schema, split_bytes=0)


def first_people_unordered(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a limit without an order keeps, the same rows at a second use."""
    people = tables.first_rows(person(spark, sf), 100)
    again = people.join(people.select("id"), "id", "left_semi")
    return again.agg(F.count("*").alias("n"))


def write_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "table")
    tables.write_table(person(spark, sf), path)
    return dated(tables.read_people(spark, path, fmt="parquet", schema=None))


def _feature_rows(df: DataFrame) -> DataFrame:
    parts = [
        df.select("row_key", F.lit(side).alias("side"), F.posexplode(side).alias("position", "value"))
        for side in ("condition", "target")
    ]
    return rounded(parts[0].unionByName(parts[1]))


def feature_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "features")
    store.write_features(workflows.prepare_features(person(spark, sf), AS_OF).features, path)
    return _feature_rows(store.read_features(spark, path)[0])


def parameter_store(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters fitted on one table, stored, and applied to another."""
    people, scaler, codes = person(spark, sf), scratch_path(spark, "scaler"), scratch_path(spark, "codes")
    store.save_params(features.fit_scaler(people, ["healthcare_expenses"]), scaler)
    store.save_params(features.fit_encoder(people, ["gender", "race"]), codes)
    scaled = features.apply_scaler(shifted(spark, sf), store.load_params(spark, scaler), "standard")
    done = features.apply_encoder(scaled, store.load_params(spark, codes))
    return rounded(done.select("id", "gender", "race", "healthcare_expenses"))


def mapping_store(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs on overlapping tables: every id keeps one pseudonym."""
    people, path = person(spark, sf), scratch_path(spark, "mapping")
    pseudonyms.extend_mapping(people.filter("gender = 'M'"), "id", path)
    known = pseudonyms.extend_mapping(people, "id", path)
    return known.groupBy("original").agg(
        F.count("*").alias("pseudonyms"), F.max(F.length("pseudonym")).cast("bigint").alias("pseudonym_length")
    )


def report_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    metrics = privacy.privacy_report(person(spark, sf), PLACE, ["gender", "marital"])
    report.write_report(metrics.select(F.lit("person").alias("dataset"), "*"), path)
    return rounded(report.read_report(spark, path))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path, people = _people_csv(spark, sf)
    out = scratch_path(spark, "ingested")
    query = ingest_dropfolder(spark, path, out, scratch_path(spark, "offsets"), schema=people.schema, secret=SECRET)
    query.awaitTermination()
    return dated(spark.read.schema(people.schema).parquet(out))


def stream_ingest_mapped(spark: SparkSession, sf: str) -> DataFrame:
    path, people = _people_csv(spark, sf)
    out, ids = scratch_path(spark, "ingested"), scratch_path(spark, "mapping")
    query = ingest_dropfolder(
        spark, path, out, scratch_path(spark, "offsets"), schema=people.schema, mode="random", mapping_path=ids
    )
    query.awaitTermination()
    return dated(spark.read.schema(people.schema).parquet(out).drop("id", "batch"))


def stream_ingest_mapped_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Random ids of a drop folder, summarised: no row and no id is lost."""
    path, people = _people_csv(spark, sf)
    out, ids = scratch_path(spark, "ingested"), scratch_path(spark, "mapping")
    query = ingest_dropfolder(
        spark, path, out, scratch_path(spark, "offsets"), schema=people.schema, mode="random", mapping_path=ids
    )
    query.awaitTermination()
    done = spark.read.schema(people.schema).parquet(out)
    return done.agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct_ids"))


def stream_report(spark: SparkSession, sf: str) -> DataFrame:
    """The privacy report that stands after the last of several files has arrived."""
    people, path = person(spark, sf), scratch_path(spark, "people")
    tables.write_table(people.repartition(5, "id"), path, "csv")
    out, reports = scratch_path(spark, "ingested"), scratch_path(spark, "reports")
    query = ingest_dropfolder(
        spark, path, out, scratch_path(spark, "offsets"), schema=people.schema, secret=SECRET, max_files=2, report=reports, qi=PLACE, sensitive=["gender", "marital"]
    )
    query.awaitTermination()
    return rounded(latest_report(spark, reports).drop("dataset"))


# --- profiling -----------------------------------------------------------------------------------


def column_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return roles.column_catalogue({"person": wide(spark, sf), "orders": orders(spark, sf)}, distinct="exact").drop("dtype")


def column_catalogue_token(spark: SparkSession, sf: str) -> DataFrame:
    found = roles.column_catalogue({"person": wide(spark, sf)}, match="token")
    return found.select("column", "role", "content", "n_rows", "n_missing")


def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dataset_stats({"person": person(spark, sf), "pseudonymised": pseudonyms.mask_columns(wide(spark, sf))})


# --- cleaning ------------------------------------------------------------------------------------


def large_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers that doubles cannot tell apart, and decimals."""
    big = F.lit(9007199254740992).cast("bigint") + F.col("l_orderkey")
    gaps = lineitem(spark, sf).select(
        "l_orderkey",
        F.when(F.col("l_linenumber") > 1, big).alias("big"),
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("decimal(12,2)")).alias("exact"),
    )
    filled = clean.impute_median(gaps, ["big", "exact"])
    return filled.groupBy("l_orderkey").agg(F.max("big").alias("big"), F.max("exact").cast("double").alias("exact"))


def fill_by_group(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["birthdate", "ssn", "zip", "marital"]
    people = person(spark, sf).select("id", "gender", *cols)
    return dated(ordered.fill_directional(people, ["id"], partition_by=["gender"], columns=cols))


def clean_report(spark: SparkSession, sf: str) -> DataFrame:
    people = doubled(spark, sf)
    return clean.clean_report(people, clean.clean(people))


def preprocess(spark: SparkSession, sf: str) -> DataFrame:
    path, people = _people_csv(spark, sf)
    return dated(workflows.preprocess(spark, path, scratch_path(spark, "cleaned"), schema=people.schema)[0])


# --- dates, scaling, encoding --------------------------------------------------------------------


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates from text where some texts are no dates."""
    people = person(spark, sf)
    text = F.when(F.col("id").endswith("5"), F.lit("not a date")).otherwise(F.col("birthdate").cast("string"))
    return people.select("id", parse_date(text).cast("string").alias("birthdate"))


def onehot_cities(spark: SparkSession, sf: str) -> DataFrame:
    """Levels with a dot, and levels that differ in case only."""
    people = person(spark, sf)
    level = F.when(F.col("id").endswith("1"), F.lit("St. Louis")).when(F.col("id").endswith("2"), F.lit("White")).otherwise(F.lit("white"))
    done = features.encode(people.select("id", level.alias("city")), ["city"], "onehot", max_levels=10)
    return done.toDF("id", "dotted", "upper", "lower")


def price_bands(spark: SparkSession, sf: str) -> DataFrame:
    band = bucketize(F.col("o_totalprice"), [0, 50_000, 150_000, 300_000], ["low", "middle", "high"])
    return orders(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def split_features(spark: SparkSession, sf: str) -> DataFrame:
    return _feature_rows(workflows.prepare_features(person(spark, sf), AS_OF).features)


def prepare_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(workflows.prepare_features(person(spark, sf), AS_OF).table)


# --- pseudonyms ----------------------------------------------------------------------------------


def pseudonymise_id(spark: SparkSession, sf: str) -> DataFrame:
    """Random ids, summarised: all rows there, one pseudonym per id, all of UUID length."""
    people, path = doubled(spark, sf), scratch_path(spark, "mapping")
    done = pseudonyms.pseudonymise_id(people, "id", path)
    per_id = done.groupBy("id", "last").agg(F.count("*").alias("n"))
    return per_id.groupBy("last").agg(
        F.count("*").alias("pseudonyms"), F.sum("n").alias("n"), F.max(F.length("id")).cast("bigint").alias("id_length")
    )


def mapping_stats(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "mapping")
    pseudonyms.extend_mapping(person(spark, sf), "id", path)
    pseudonyms.extend_mapping(customer(spark, sf), "c_custkey", path, namespace="customer")
    pseudonyms.extend_mapping(person(spark, sf), "id", path)
    return pseudonyms.mapping_stats(mapping.load_mapping(spark, path))


# --- utility and synthesis -----------------------------------------------------------------------


def model_utility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.model_utility(person(spark, sf), shifted(spark, sf), "id"))


def model_utility_known(spark: SparkSession, sf: str) -> DataFrame:
    """Models whose scores follow from the tables: a feature tells the target, in the second synthetic table the wrong way round."""
    flag = lambda value: F.when(F.col("gender") == value, 1.0).otherwise(0.0).alias("flag")
    side = lambda df, value: df.where("gender IS NOT NULL").select("id", "gender", flag(value))
    original = side(person(spark, sf), "M")
    same = models.model_utility(original, side(shifted(spark, sf), "M"), "id")
    turned = models.model_utility(original, side(shifted(spark, sf), "F"), "id")
    return rounded(same.withColumn("feature", F.lit("same")).unionByName(turned.withColumn("feature", F.lit("turned"))))


def validate(spark: SparkSession, sf: str) -> DataFrame:
    anonymised = pseudonyms.mask_columns(shifted(spark, sf))
    return rounded(workflows.validate(person(spark, sf), anonymised, models=[]), 3)


def validate_with_models(spark: SparkSession, sf: str) -> DataFrame:
    original, anonymised = person(spark, sf), pseudonyms.mask_columns(shifted(spark, sf))
    return workflows.validate(original, anonymised)


def _density(series: dict[str, DataFrame], digits: int) -> DataFrame:
    edges = {c: F.round(c, 4) for c in ("bin_start", "bin_end")}
    return charts.density_histogram(series).withColumns({**edges, "density": F.round("density", digits)})


def _aged(spark: SparkSession, sf: str) -> DataFrame:
    return features.generalise_birthdate(person(spark, sf), AS_OF)


CONDITION = ["gender", "healthcare_expenses", "healthcare_coverage", "age_group"]
TARGET = ["city", "state", "zip", "race", "age"]


def _model(spark: SparkSession, sf: str) -> synthesis.ConditionalModel:
    return synthesis.fit_conditional(_aged(spark, sf), "id", CONDITION, TARGET)


def fit_conditional(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf).donors


def sample_conditional(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthesis.sample_conditional(_model(spark, sf)))


def sample_conditional_n(spark: SparkSession, sf: str) -> DataFrame:
    """Twice as many rows as there are people."""
    n = 2 * person(spark, sf).count()
    return rounded(synthesis.sample_conditional(_model(spark, sf), n=n, seed=7).withColumnRenamed("id", "draw"))


def assemble_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    people = person(spark, sf)
    return synthesis.assemble_synthetic(people.select("id", "zip", "race"), people.select("id", "gender"), "id")


def synthetic_identities(spark: SparkSession, sf: str) -> DataFrame:
    people = wide(spark, sf).select("id", "gender", "drivers", "lat")
    named = synthesis.synthetic_identities(people, "id")
    return named.toDF(*[c.lower() for c in named.columns])


def _named(df: DataFrame) -> DataFrame:
    return rounded(dated(df)).toDF(*[c.lower() for c in df.columns])


def conform(spark: SparkSession, sf: str) -> DataFrame:
    return _named(synthesis.conform(wide(spark, sf)))


def synthesise(spark: SparkSession, sf: str) -> DataFrame:
    return _named(synthesis.synthesise(person(spark, sf), AS_OF))


def synthesise_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """From a table whose ids are missing or repeat."""
    return _named(synthesis.synthesise(variant(spark, sf, views.LOOSE_PERSON_SQL), AS_OF))


def anonymise(spark: SparkSession, sf: str) -> DataFrame:
    return workflows.anonymise(person(spark, sf), AS_OF, mapping_path=scratch_path(spark, "mapping"))[1]


def anonymise_no_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(workflows.anonymise_no_synthesis(person(spark, sf), AS_OF, mode="keyed", secret=SECRET, models=[])[1], 3)


def anonymise_no_synthesis_with_models(spark: SparkSession, sf: str) -> DataFrame:
    return workflows.anonymise_no_synthesis(person(spark, sf), AS_OF, mode="keyed", secret=SECRET)[1]


def anonymise_files_with_models(spark: SparkSession, sf: str) -> DataFrame:
    path, people = _people_csv(spark, sf)
    return workflows.anonymise_files(spark, path, scratch_path(spark, "run"), AS_OF, synthesis=False, mode="keyed", secret=SECRET, reader={"schema": people.schema})


def anonymise_files(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run from a CSV file to its stored report, without synthesis."""
    path, people = _people_csv(spark, sf)
    options = {"synthesis": False, "mode": "keyed", "secret": SECRET, "models": [], "reader": {"schema": people.schema}}
    return rounded(workflows.anonymise_files(spark, path, scratch_path(spark, "run"), AS_OF, **options), 3)


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_people": read_people,
    "read_first_people": read_first_people,
    "first_people_unordered": first_people_unordered,
    "csv_round_trip": csv_round_trip,
    "csv_split": csv_split,
    "write_table": write_table,
    "feature_store": feature_store,
    "parameter_store": parameter_store,
    "mapping_store": mapping_store,
    "report_store": report_store,
    "stream_ingest": stream_ingest,
    "stream_ingest_mapped": stream_ingest_mapped,
    "stream_ingest_mapped_ids": stream_ingest_mapped_ids,
    "stream_report": stream_report,
    # profiling
    "profile": lambda s, sf: profile.profile_table(doubled(s, sf)),
    "profile_lineitem": lambda s, sf: profile.profile_table(lineitem(s, sf)),
    "missing_by_column": lambda s, sf: rounded(profile.missing_by_column(person(s, sf))),
    "dtype_counts": lambda s, sf: roles.dtype_summary(roles.column_catalogue({"person": person(s, sf), "lineitem": lineitem(s, sf)}, distinct="approx")),
    "column_catalogue": column_catalogue,
    "column_catalogue_token": column_catalogue_token,
    "dataset_stats": dataset_stats,
    "describe": lambda s, sf: rounded(profile.describe_numeric(person(s, sf)), 4),
    "describe_lineitem": lambda s, sf: rounded(profile.describe_numeric(lineitem(s, sf)), 4),
    "value_counts": lambda s, sf: profile.value_counts(person(s, sf)),
    "value_counts_lineitem": lambda s, sf: profile.value_counts(lineitem(s, sf)),
    # cleaning
    "dedupe": lambda s, sf: dated(clean.drop_duplicate_rows(doubled(s, sf))),
    "impute_median": lambda s, sf: rounded(clean.impute_median(gapped(s, sf)).drop("birthdate"), 3),
    "impute_median_exact": large_medians,
    "impute_mode": lambda s, sf: clean.impute_mode(gapped(s, sf)).select("id", "marital", "zip", "passport"),
    "sparse_columns": lambda s, sf: clean.drop_sparse_columns(gapped(s, sf)),
    "sparse_rows": lambda s, sf: clean.drop_sparse_rows(gapped(s, sf).select("id", "birthdate", "marital", "zip", "passport", "lat"), 0.5).select("id", "marital", "zip"),
    "fill_directional": lambda s, sf: dated(ordered.fill_directional(person(s, sf), ["id"])),
    "fill_directional_by": fill_by_group,
    "fill_constant": lambda s, sf: clean.fill_constant(gapped(s, sf).select("id", "healthcare_expenses", "lat")),
    "clean": lambda s, sf: dated(clean.clean(doubled(s, sf))),
    "clean_gaps": lambda s, sf: clean.clean(gapped(s, sf)),
    "clean_report": clean_report,
    "preprocess": preprocess,
    # dates, scaling, encoding
    "parse_dates": parse_dates,
    "age_features": lambda s, sf: _aged(s, sf).select("id", "age", "birth_month", "birth_year", "age_group"),
    "bucketize": price_bands,
    "minmax": lambda s, sf: rounded(features.scale_minmax(gapped(s, sf), ["healthcare_expenses", "healthcare_coverage", "lon"]).select("id", "healthcare_expenses", "healthcare_coverage", "lon")),
    "minmax_lineitem": lambda s, sf: rounded(features.scale_minmax(lineitem(s, sf), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")),
    "standard": lambda s, sf: rounded(features.scale_standard(gapped(s, sf), ["healthcare_expenses", "healthcare_coverage", "lon"]).select("id", "healthcare_expenses", "healthcare_coverage", "lon")),
    "label_encode": lambda s, sf: features.encode(person(s, sf), ["race", "marital", "city", "zip", "last"]).select("id", "race", "marital", "city", "zip", "last"),
    "onehot": lambda s, sf: features.encode(person(s, sf).select("id", "race", "marital"), ["race", "marital"], "onehot", max_levels=100),
    "onehot_cities": onehot_cities,
    "split_features": split_features,
    "prepare_features": prepare_features,
    # pseudonyms
    "pseudonymise_id": pseudonymise_id,
    "pseudonymise_id_keyed": lambda s, sf: pseudonyms.pseudonymise_id(person(s, sf).select("id", "last"), mode="keyed", secret=SECRET),
    "pseudonymise_hash": lambda s, sf: pseudonyms.mask_columns(wide(s, sf)).select("id", "ssn", "first", "last", "address", "city", "state", "zip"),
    "redact": lambda s, sf: pseudonyms.redact(wide(s, sf)).select("id", "drivers", "passport", "maiden", "lat", "lon"),
    "pseudonymise_table": lambda s, sf: dated(pseudonyms.pseudonymise_table(wide(s, sf), mode="keyed", secret=SECRET)),
    "mapping_stats": mapping_stats,
    # privacy
    "equivalence_classes": lambda s, sf: privacy.equivalence_classes(person(s, sf), PLACE + ["zip"]),
    "equivalence_classes_with_nulls": lambda s, sf: privacy.equivalence_classes(person(s, sf), PLACE + ["zip"], null_keys="group"),
    "k_anonymity": lambda s, sf: privacy.k_anonymity(person(s, sf), PLACE + ["zip", "gender"]),
    "k_anonymity_orders": lambda s, sf: privacy.k_anonymity(orders(s, sf), ["o_orderpriority", "o_orderstatus"]),
    "k_anonymity_order_customers": lambda s, sf: privacy.k_anonymity(orders(s, sf), ["o_orderpriority", "o_orderstatus", "o_custkey"]),
    "k_anonymity_detail": lambda s, sf: rounded(privacy.k_anonymity_detail(person(s, sf), PLACE + ["zip", "gender"])),
    "l_diversity": lambda s, sf: rounded(privacy.l_diversity(person(s, sf), PLACE, ["gender", "marital"])),
    "l_diversity_lineitem": lambda s, sf: rounded(privacy.l_diversity(lineitem(s, sf), ["l_suppkey", "l_returnflag"], ["l_linestatus", "l_quantity"])),
    "l_diversity_overlap": lambda s, sf: rounded(privacy.l_diversity(person(s, sf), [*PLACE, "gender"], ["gender", "marital"])),
    "l_diversity_detail": lambda s, sf: rounded(privacy.l_diversity_detail(person(s, sf), PLACE, ["gender", "marital"])),
    "t_closeness": lambda s, sf: rounded(privacy.t_closeness(person(s, sf), PLACE, ["gender", "marital"])),
    "t_closeness_lineitem": lambda s, sf: rounded(privacy.t_closeness(lineitem(s, sf), ["l_suppkey"], ["l_returnflag", "l_quantity"])),
    "t_closeness_detail": lambda s, sf: rounded(privacy.t_closeness_detail(person(s, sf), PLACE, ["gender", "marital"])),
    "reid_risk": lambda s, sf: rounded(privacy.reidentification_risk(person(s, sf), PLACE + ["zip", "gender"])),
    "risk_detail": lambda s, sf: rounded(privacy.risk_detail(person(s, sf), PLACE + ["zip", "gender"])),
    "privacy_report": lambda s, sf: rounded(privacy.privacy_report(person(s, sf), PLACE + ["zip"], ["gender", "marital"])),
    # utility
    "holdout_split": lambda s, sf: utility.holdout_split(person(s, sf).select("id"), "id"),
    "similarity": lambda s, sf: rounded(utility.similarity(person(s, sf), shifted(s, sf)), 3),
    "matrix_fidelity": lambda s, sf: rounded(utility.matrix_fidelity(person(s, sf), shifted(s, sf), "id"), 3),
    "synthetic_quality": lambda s, sf: rounded(utility.synthetic_quality(shifted(s, sf)), 4),
    "compare_tables_lineitem": lambda s, sf: rounded(utility.compare_tables(lineitem(s, sf), lineitem(s, sf).filter("l_linenumber > 1")), 3),
    "compare_tables": lambda s, sf: rounded(utility.compare_tables(wide(s, sf), shifted(s, sf)), 3),
    "model_utility": model_utility,
    "model_utility_known": model_utility_known,
    "validate": validate,
    "validate_with_models": validate_with_models,
    # synthesis
    "fit_conditional": fit_conditional,
    "sample_conditional": sample_conditional,
    "sample_conditional_n": sample_conditional_n,
    "assemble_synthetic": assemble_synthetic,
    "synthetic_identities": synthetic_identities,
    "conform": conform,
    "synthesise": synthesise,
    "synthesise_gaps": synthesise_gaps,
    # chart data
    "histogram": lambda s, sf: rounded(charts.histogram(pair(s, sf), "healthcare_expenses")),
    "histogram_events": lambda s, sf: rounded(charts.histogram({"events": events(s, sf)}, "value", bins=50)),
    "density_histogram": lambda s, sf: _density(pair(s, sf), 12),
    "density_histogram_lineitem": lambda s, sf: _density({"lineitem": lineitem(s, sf)}, 9),
    "category_counts": lambda s, sf: charts.category_counts(pair(s, sf), "gender"),
    "box_stats": lambda s, sf: rounded(charts.box_stats(pair(s, sf), "healthcare_expenses"), 4),
    "box_stats_events": lambda s, sf: rounded(charts.box_stats({"events": events(s, sf)}, "value"), 4),
    "k_achieved": lambda s, sf: charts.k_achieved_series(person(s, sf), PLACE),
    # workflows
    "anonymise": anonymise,
    "anonymise_no_synthesis": anonymise_no_synthesis,
    "anonymise_no_synthesis_with_models": anonymise_no_synthesis_with_models,
    "anonymise_files": anonymise_files,
    "anonymise_files_with_models": anonymise_files_with_models,
}
