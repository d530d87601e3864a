import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.schema import PERSON_SCHEMA
from veilframe.sources.split_csv import largest_file, read_split_csv, records
from veilframe.sources.tables import read_people, write_table

SCHEMA = "a string, b string, n int"


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def struct(spark, ddl=SCHEMA):
    return spark.createDataFrame([], ddl).schema


def test_one_file_by_many_tasks(spark, tmp_path, small_splits):
    """Cells with newlines, carriage returns, quotes and commas, short ones and some over several splits."""
    rng = random.Random(8)
    parts = ["x", "\n", "\r\n", '"', '""', ",", " ", "é", "\n\n", '"\n"', "word " * 30]
    cell = lambda: "z" + "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 9, 60]))) + "z"
    table = spark.createDataFrame([(cell(), rng.choice([None, cell()]), i) for i in range(300)], SCHEMA).coalesce(1)
    path = str(tmp_path / "t")
    write_table(table, path, "csv")
    found = records(spark, path)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 40
    assert found.count() == 301 and found.where("first").count() == 1
    got = read_people(spark, path, schema=SCHEMA, split_bytes=100)
    assert rows(got) == rows(read_people(spark, path, schema=SCHEMA)) == rows(table)


def test_several_files_and_odd_ends(spark, tmp_path, small_splits):
    files = {
        "one.csv": 'a,b,n\n1,"x\ny",2\n\n3,,4',  # an empty line, and no newline at the end
        "crlf.csv": 'a,b,n\r\n5,"p\r\nq",6\r\n7,"say ""hi""",8\r\n',
        "head.csv": "A,B,N\n",
        "long.csv": 'a,b,n\n"' + "w\n" * 3_000 + '",end,9\n',
        "empty.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = rows(read_split_csv(spark, str(tmp_path), struct(spark)))
    plain = spark.read.schema(SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    assert got == rows(plain) and len(got) == 5
    assert largest_file(spark, str(tmp_path)) == len(files["long.csv"])


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,n,b\n1,2,3\n")
    with pytest.raises(ValueError, match="header"):
        read_split_csv(spark, str(tmp_path), struct(spark))


def test_people_from_splits(spark, tmp_path, small_person, small_splits):
    path = str(tmp_path / "people")
    write_table(small_person.coalesce(1), path, "csv")
    split = read_people(spark, path, schema=small_person.schema, split_bytes=0)
    assert rows(split) == rows(read_people(spark, path, schema=small_person.schema))
    few = read_people(spark, path, 10, ["id"], schema=small_person.schema, split_bytes=0)
    assert rows(few) == rows(read_people(spark, path, 10, ["id"], schema=small_person.schema))
    assert PERSON_SCHEMA and split.where(F.col("birthdate").isNotNull()).count() > 0
