import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe import session
from veilframe.operators.privacy import privacy_report
from veilframe.plans import workflows as L
from veilframe.schema import PERSON_SCHEMA
from veilframe.session import durable_dir, scratch_path
from veilframe.sources.mapping import load_mapping
from veilframe.sources.report import read_report, write_report
from veilframe.sources.tables import first_rows, read_people, write_table
from veilframe.streaming.dropfolder import ingest_dropfolder


def _csv(folder, name, body, header=",".join(PERSON_SCHEMA.names)):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(f"{header}\n{body}\n")


def person_line(i, first="Ann", zip_code="02101", lat="1.5"):
    return f'p{i},1990-01-02,,12{i}-45-6789,D,P,,{first},Doe,,M,S,white,none,F,here,"1 Main St, Apt 2",Boston,MA,Suffolk,{zip_code},{lat},2.5,10.5,20.5'


def test_csv_types_and_missing_texts(spark, tmp_path):
    _csv(tmp_path, "a.csv", "\n".join([person_line(1), person_line(2, first="NaN", zip_code="NA", lat="NaN")]))
    df = read_people(spark, str(tmp_path)).orderBy("Id")
    assert df.schema == PERSON_SCHEMA
    one, two = df.collect()
    assert (one["ZIP"], one["ADDRESS"], one["BIRTHDATE"].year) == ("02101", "1 Main St, Apt 2", 1990)
    assert (two["FIRST"], two["ZIP"], two["LAT"]) == (None, None, None)


def test_wrong_header_and_missing_file_raise(spark, tmp_path):
    _csv(tmp_path, "a.csv", "1,2", header="a,b")
    with pytest.raises(Exception):
        read_people(spark, str(tmp_path)).collect()
    with pytest.raises(Exception):
        read_people(spark, str(tmp_path / "nothing")).collect()


def test_keyed_ids_need_a_secret(spark, tmp_path):
    with pytest.raises(ValueError, match="secret"):
        ingest_dropfolder(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "offsets"))


def test_first_rows(spark):
    df = spark.range(100).repartition(7)
    assert rows(first_rows(df, 5, ["id"])) == [(i,) for i in range(5)]
    some = first_rows(df, 30)
    assert some.count() == 30 and rows(some) == rows(some) and first_rows(df, 500).count() == 100


def test_cells_with_newlines_quotes_and_commas(spark, tmp_path):
    cells = ["two\nlines", "win\r\nlines", 'say "hi", you', "a,b", "plain"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, text string")
    write_table(df, str(tmp_path / "csv"), "csv")
    assert rows(read_people(spark, str(tmp_path / "csv"), schema=df.schema)) == rows(df)


def test_report_round_trip(spark, small_person):
    path = scratch_path(spark, "report")
    metrics = privacy_report(small_person, ["race"], ["gender"]).select(F.lit("d").alias("dataset"), "*")
    write_report(metrics, path)
    assert rows(read_report(spark, path)) == rows(metrics)
    lines = [r[0] for r in spark.read.text(f"{path}/text").collect()]
    assert "d.privacy.reidentification_risk.risk_level: LOW" in lines and len(lines) == metrics.count()
    assert all(json.loads(r[0])["family"] == "privacy" for r in spark.read.text(f"{path}/json").collect())


def test_durable_dir_comes_from_the_session(spark, tmp_path):
    assert durable_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://elsewhere"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.durable_dir(Cluster)


@pytest.mark.parametrize("mode", ["keyed", "random"])
def test_dropfolder_takes_every_file_once(spark, tmp_path, mode):
    inbox, out, offsets = (str(tmp_path / d) for d in ("inbox", "out", "offsets"))
    options = {"mode": mode, "mapping_path": str(tmp_path / "mapping"), "max_files": 1}

    def run():
        ingest_dropfolder(spark, inbox, out, offsets, secret="s", **options).awaitTermination()
        return spark.read.schema(_masked_schema()).parquet(out)

    _csv(inbox, "a.csv", person_line(1))
    _csv(inbox, "b.csv", person_line(2))
    first = rows(run(), "SSN", "Id")
    assert len(first) == 2
    _csv(inbox, "c.csv", "\n".join([person_line(1), person_line(3)]))
    second = rows(run(), "SSN", "Id")
    assert len(second) == 4 and set(first) <= set(second) and len({i for _, i in second}) == 3
    assert rows(run(), "SSN", "Id") == second
    assert {r["LAT"] for r in run().collect()} == {"LAT_Redacted"}


def _masked_schema():
    return ", ".join(f"{f.name} {'string' if f.name in ('LAT', 'LON') else f.dataType.simpleString()}" for f in PERSON_SCHEMA.fields)


def test_preprocess(spark, tmp_path, small_person):
    path = str(tmp_path / "people")
    write_table(small_person.unionByName(small_person.limit(10)), path, "csv")
    cleaned, profile, catalogue = L.preprocess(spark, path, str(tmp_path / "cleaned"), schema=small_person.schema)
    assert profile.first()["duplicate_records"] == 10 and cleaned.count() == 150
    assert catalogue.count() == 14 and cleaned.filter("ssn is null or zip is null or first is null").count() == 0


def test_whole_workflow(spark, small_person):
    mapping = scratch_path(spark, "mapping")
    tables, report = L.anonymise(small_person, "2024-01-01", mapping_path=mapping, n_synthetic=200, models=["random_forest"], trees=5, max_depth=3)
    assert tables["synthetic"].count() == 200 and tables["pseudonymised"].count() == 150
    assert "birthdate" not in tables["pseudonymised"].columns
    assert not set(rows(tables["pseudonymised"], "id")) & set(rows(small_person, "id"))
    found = {(r["dataset"], r["metric"], r["param"], r["field"]): r["value_num"] for r in report.collect()}
    assert found["original", "structure", None, "total_records"] == 150
    assert found["synthetic", "reidentification_risk", None, "total_records"] == 200
    assert found["pseudonymised", "statistical_similarity", "column=overall", "similarity_score"] == 1.0
    assert ("synthetic", "ml_performance", "model=random_forest", "accuracy_difference") in found
    assert found["synthetic", "k_anonymity", "k=2", "total_groups"] > 0

    _, short = L.anonymise_no_synthesis(small_person, "2024-01-01", mode="keyed", secret="s", models=[])
    assert {r["dataset"] for r in short.select("dataset").distinct().collect()} == {"original", "pseudonymised"}


def test_whole_run_on_files(spark, tmp_path, small_person):
    path, out = str(tmp_path / "people"), str(tmp_path / "out")
    write_table(small_person, path, "csv")
    report = L.anonymise_files(
        spark, path, out, "2024-01-01", n_records=120, order_by=["id"], models=[], reader={"schema": small_person.schema}
    )
    assert sorted(os.listdir(out)) == [
        "catalogue", "codes", "features", "mapping", "processed", "pseudonymised", "report", "scaler", "synthetic"
    ]
    assert {spark.read.parquet(f"{out}/{t}").count() for t in ("processed", "features", "pseudonymised", "synthetic")} == {120}
    assert load_mapping(spark, f"{out}/mapping").count() == 120
    assert {r["dataset"] for r in report.select("dataset").distinct().collect()} == {"original", "pseudonymised", "synthetic"}


@pytest.mark.parametrize("per_scan", [1, 32])
def test_wide_tables_are_profiled_in_pieces(spark, monkeypatch, per_scan):
    from veilframe.operators import quantiles

    monkeypatch.setattr(quantiles, "COLUMNS_PER_SCAN", per_scan)
    df = spark.range(11).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(5)])
    assert quantiles.exact_quantiles(df, df.columns, [0.5]) == {f"c{i}": [5.0 * i] for i in range(5)}
