"""Record files: what is written is read, indexes prune, failed writes leave nothing."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lamina.sources.record_files import footer, opened, register

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    register(spark)
    return spark


def saved(df, path, mode="append", **options):
    df.write.format("records").options(**options).mode(mode).save(str(path))


def test_documents_round_trip(store, tmp_path):
    docs = store.read.parquet(f"{SF}/documents.parquet")
    saved(docs.repartition(3), tmp_path / "d", index="doc_id", shard_rows="30", block_rows="8")
    back = store.read.format("records").load(str(tmp_path / "d"))
    assert back.schema == docs.schema and back.exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert sorted(x[0] for x in back.select("doc_id").collect()) == sorted(x[0] for x in docs.select("doc_id").collect())
    shards = list(Path(tmp_path / "d").glob("write-*/*.rec"))
    rows = [sum(b["rows"] for b in footer(*opened(str(s)))) for s in shards]
    assert max(rows) <= 30 and sum(rows) == docs.count() and all(b["rows"] <= 8 for s in shards for b in footer(*opened(str(s))))


def test_pruned(store, tmp_path):
    rows = store.range(1000).select("id", F.floor(F.col("id") / 100).cast("int").alias("distance"), F.col("id").cast("string").alias("x"))
    saved(rows.coalesce(1), tmp_path / "p", index="distance", shard_rows="100", block_rows="10")
    read = lambda **o: store.read.format("records").options(**o).load(str(tmp_path / "p"))
    assert read().rdd.getNumPartitions() == 10
    for where, n, parts in [("distance = 3", 100, 1), ("distance in (2, 9)", 200, 2), ("distance > 6", 300, 4), ("distance >= 4 and distance < 6", 200, 3), ("distance = 77", 0, 1), ("distance is null", 0, 10), ("x = '5'", 1, 10)]:
        got = read().where(where)
        assert got.count() == n and got.rdd.getNumPartitions() == parts, where
    some = read(number="true").where("_record in (5, 999, 401)")
    assert {(r["_record"], r["id"]) for r in some.collect()} == {(5, 5), (999, 999), (401, 401)} and some.rdd.getNumPartitions() == 3


def test_appends_and_overwrites(store, tmp_path):
    one = store.createDataFrame([(1, "a", [1.5]), (None, None, None)], "k int, s string, v array<double>")
    saved(one, tmp_path / "a", index="k")
    saved(one.limit(0), tmp_path / "a", index="k")
    saved(one, tmp_path / "a", index="k")
    back = lambda **o: store.read.format("records").options(**o).load(str(tmp_path / "a"))
    assert Counter(map(str, back().collect())) == Counter(map(str, one.collect() * 2))
    assert sorted(r["_record"] for r in back(number="true").collect()) == [0, 1, 2, 3] and back().where("k = 1").count() == 2
    saved(store.range(3).toDF("z"), tmp_path / "a", "overwrite")
    assert back().columns == ["z"] and back().count() == 3 and len(list(Path(tmp_path / "a").glob("write-*"))) == 1
    with pytest.raises(Exception, match="one schema"):
        saved(one, tmp_path / "a")
        back().count()
    with pytest.raises(Exception, match="no record files"):
        store.read.format("records").load(str(tmp_path / "none")).count()


def test_a_failed_task_leaves_no_file(store, tmp_path):
    good = store.range(40, numPartitions=4)
    saved(good, tmp_path / "f", index="id")
    before = sorted(p for p in tmp_path.rglob("*") if p.is_file())
    bad = good.select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            saved(bad, tmp_path / "f", mode, index="id", block_rows="2", shard_rows="3")
        assert sorted(p for p in tmp_path.rglob("*") if p.is_file()) == before
    with pytest.raises(Exception, match="no column"):
        saved(good, tmp_path / "f", index="other")
    whole = next(Path(tmp_path / "f").glob("write-*/*.rec"))
    whole.write_bytes(whole.read_bytes()[:-3])
    with pytest.raises(Exception, match="not a whole record file"):
        store.read.format("records").load(str(tmp_path / "f")).count()
