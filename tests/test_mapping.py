import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators import pseudonyms as N
from veilframe.session import scratch_path
from veilframe.sources import files, mapping


def ids(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("id-"), "id").alias("k"))


def test_a_small_batch_opens_its_own_buckets_only(spark):
    """The files of all other buckets are spoilt: whoever reads them fails."""
    path = scratch_path(spark, "mapping")
    before = dict(rows(N.extend_mapping(ids(spark, 0, 500), "k", path), "original", "pseudonym"))
    batch = ids(spark, 7, 10)
    bucket = F.expr(f"pmod(hash(k), {mapping.BUCKETS})")
    mine = {r[0] for r in batch.select(bucket).collect()}
    spoilt = 0
    for file in glob.glob(f"{path}/namespace=person/data/*/part-*.parquet"):
        if int(os.path.basename(file).split("_")[-1].split(".")[0]) not in mine:
            os.remove(file)
            spoilt += 1
            with open(file, "wb") as out:
                out.write(b"no parquet")
    assert spoilt > 50
    done = N.pseudonymise_id(batch.withColumn("x", F.col("k")), "k", path)
    assert dict(rows(done, "x", "k")) == {k: before[k] for k in ("id-7", "id-8", "id-9")}


def test_many_ids_are_joined_without_an_exchange_of_the_mapping(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW_IDS", 10)
    path = scratch_path(spark, "mapping")
    first = N.extend_mapping(ids(spark, 0, 300), "k", path)
    second = N.extend_mapping(ids(spark, 100, 400), "k", path)
    assert set(rows(first)) < set(rows(second)) and second.count() == 400
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = N.apply_mapping(ids(spark, 0, 400), "k", second)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    right = plan[plan.index("FileScan parquet") - 400 :]
    assert plan.count("Exchange") == 1 and f"SelectedBucketsCount: {mapping.BUCKETS} out of {mapping.BUCKETS}" in right


def test_two_writers_agree_on_every_id(spark):
    path = scratch_path(spark, "mapping")
    starts = [0, 40, 80, 20, 60, 0]
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(lambda a: dict(rows(N.extend_mapping(ids(spark, a, a + 100), "k", path), "original", "pseudonym")), starts))
    held = dict(rows(mapping.load_mapping(spark, path), "original", "pseudonym"))
    assert len(held) == len(set(held.values())) == 180
    for a, seen in zip(starts, found):
        assert {f"id-{i}" for i in range(a, a + 100)} <= set(seen) and all(held[k] == v for k, v in seen.items())
    assert rows(N.mapping_stats(mapping.load_mapping(spark, path))) == [("person", 180, 180, 0)]
    commits = files.names_in(spark, f"{path}/namespace=person/commits")
    assert commits == [f"{i + 1:020d}" for i in range(len(commits))]  # nothing beside them is left


def test_the_loser_reads_and_retries(spark, monkeypatch):
    """Another writer publishes between the read and the commit of this one."""
    path, stored, calls = scratch_path(spark, "mapping"), mapping._store, []

    def late(commit, new):
        folder = stored(commit, new)
        calls.append(folder)
        if len(calls) == 1:
            N.extend_mapping(ids(spark, 0, 10), "k", path)
        return folder

    monkeypatch.setattr(mapping, "_store", late)
    mine = dict(rows(N.extend_mapping(ids(spark, 5, 20), "k", path), "original", "pseudonym"))
    assert len(calls) == 3 and len(mine) == 20
    assert rows(N.mapping_stats(mapping.load_mapping(spark, path))) == [("person", 20, 20, 0)]
    assert calls[0] not in files.names_in(spark, f"{path}/namespace=person/data")


def test_compaction_keeps_ids_and_readers(spark, monkeypatch):
    monkeypatch.setattr(mapping, "FOLDERS", 3)
    path = scratch_path(spark, "mapping")
    reader = N.extend_mapping(ids(spark, 0, 20), "k", path)
    seen = dict(rows(reader, "original", "pseudonym"))
    for a in (10, 20, 30, 40):
        now = dict(rows(N.extend_mapping(ids(spark, a, a + 20), "k", path), "original", "pseudonym"))
        assert all(now[k] == v for k, v in seen.items())
        seen = now
    commit = mapping.latest(spark, path, "person")
    assert len(seen) == 60 and len(commit.folders) == 2  # four were rewritten, one came after
    assert dict(rows(reader, "original", "pseudonym")).items() <= seen.items()
    assert dict(rows(mapping.compact_mapping(spark, path), "original", "pseudonym")) == seen
    assert len(mapping.latest(spark, path, "person").folders) == 1
    assert len(mapping.drop_unused(spark, path)) == 6 and mapping.drop_unused(spark, path) == []
    assert dict(rows(mapping.load_mapping(spark, path), "original", "pseudonym")) == seen


def test_compaction_beside_writers(spark):
    """What is added while folders are rewritten stays; a second compaction of the same folders gives up."""
    path = scratch_path(spark, "mapping")
    for a in (0, 10):
        N.extend_mapping(ids(spark, a, a + 10), "k", path)
    old = mapping.latest(spark, path, "person")
    N.extend_mapping(ids(spark, 20, 30), "k", path)
    assert len(mapping.compact(spark, old).folders) == 2
    assert mapping.compact(spark, old) == mapping.latest(spark, path, "person")
    assert mapping.load_mapping(spark, path).count() == 30


def test_namespaces_nulls_and_odd_names(spark):
    path = scratch_path(spark, "mapping")
    assert mapping.load_mapping(spark, path) is None
    odd = spark.createDataFrame([("a'b",), ("",), (None,), ("a'b",), ("ü/\\",)], "k string")
    assert {o for o, in rows(N.extend_mapping(odd, "k", path, "it's / 50 %"), "original")} == {"a'b", "", "ü/\\"}
    N.extend_mapping(odd.where("false"), "k", path, "none")
    assert mapping.load_mapping(spark, path, "none").count() == 0
    assert rows(N.mapping_stats(mapping.load_mapping(spark, path))) == [("it's / 50 %", 3, 3, 0)]
    done = N.pseudonymise_id(odd.withColumn("x", F.col("k")), "k", path, "it's / 50 %").collect()
    assert len(done) == 5 and sum(r["k"] is None for r in done) == 1 and len({r["k"] for r in done}) == 4


def test_heavy_and_null_ids(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    known = N.extend_mapping(df, "k", scratch_path(spark, "mapping"))
    plain = rows(df.join(known.select(F.col("original").alias("k"), "pseudonym"), "k", "left"), "id", "pseudonym")
    assert rows(N.apply_mapping(df, "k", known, min_rows=100), "id", "k") == rows(N.apply_mapping(df, "k", known), "id", "k") == plain


def test_publishing_needs_a_new_name(spark, tmp_path):
    path = f"{tmp_path}/a/1"
    assert files.publish(spark, path, "é") and not files.publish(spark, path, "other")
    assert files.read_text(spark, path) == "é" and files.names_in(spark, f"{tmp_path}/a") == ["1"]
    with pytest.raises(Exception, match="FileNotFound|does not exist"):
        files.read_text(spark, f"{tmp_path}/a/2")
