"""Epochs that stop and go on repeat and lose no row."""

import json
from collections import defaultdict
from pathlib import Path

import pytest

from lamina.streaming import epochs as E

SF = "/root/testdata/sf0.001"


def steps(spark, stream, folder, upto, stop=True):
    """Runs the stream into a Parquet folder a batch, until so many batches stand; then stops it."""

    class Enough(Exception):
        pass

    def hook(batch, number):
        if number >= upto:
            raise Enough
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number:04d}")

    q = stream.writeStream.foreachBatch(hook).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        q.processAllAvailable()
    except Exception as e:
        assert "Enough" in str(e)
    q.stop()


def seen(spark, folder):
    out = defaultdict(list)
    for p in sorted(Path(folder, "out").iterdir()):
        for r in spark.read.parquet(str(p)).orderBy("_epoch", "_position").collect():
            out[r["_epoch"]].append((r["_position"], r["doc_id"], p.name))
    return out


def table(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.option("parquet.block.size", 1 << 16).mode("overwrite").parquet(path)
    return path


def test_restarts(spark, tmp_path):
    path, folder = table(spark, tmp_path), str(tmp_path / "run")
    own = lambda: E.epochs(spark, path, f"{folder}/state", 7, 47, 3)
    steps(spark, own(), folder, 4)  # fails in its fifth batch, which was planned
    spark.range(1).selectExpr("id doc_id", "'late' text", "'en' lang", "'s' source", "1L n_chars").write.mode("append").parquet(path)
    steps(spark, own(), folder, 9)
    steps(spark, own(), folder, 10**9)
    steps(spark, own(), folder, 10**9)  # nothing is left
    got = seen(spark, folder)
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(got) == [0, 1, 2]
    for rows in got.values():
        assert [p for p, *_ in rows] == list(range(len(ids))) and sorted(i for _, i, _ in rows) == ids
        sizes = [sum(b == name for *_, b in rows) for name in sorted({b for *_, b in rows})]
        assert sizes == [47] * (len(ids) // 47) + [len(ids) % 47]
    assert len({tuple(i for _, i, _ in rows) for rows in got.values()}) == 3
    whole = str(tmp_path / "whole")
    (tmp_path / "whole" / "state").mkdir(parents=True)
    Path(whole, "state", "groups.json").write_text(Path(folder, "state", "groups.json").read_text())
    steps(spark, E.epochs(spark, path, f"{whole}/state", 7, 1000, 3), whole, 10**9)  # without a stop, in larger batches: the same order
    assert {e: [(p, i) for p, i, _ in rows] for e, rows in seen(spark, whole).items()} == {e: [(p, i) for p, i, _ in rows] for e, rows in got.items()}


def test_clean_stop_between_batches(spark, tmp_path):
    path, state = table(spark, tmp_path), str(tmp_path / "state")
    options = {"path": path, "state": state, "seed": "1", "rows": "90"}
    r = E.EpochReader(options, ["doc_id", "_epoch", "_position"])
    a = r.latestOffset()
    first = r.partitions(r.initialOffset(), a)
    assert a == {"epoch": 0, "position": 90} and sum(p.last - p.first for p in first) == 90
    assert r.latestOffset() == {"epoch": 0, "position": 180}  # said, but never planned
    again = E.EpochReader(options, ["doc_id", "_epoch", "_position"])
    assert again.latestOffset() == {"epoch": 0, "position": 180}
    assert again.partitions(again.initialOffset(), a) == first  # a batch that is planned anew is the same
    assert E.EpochReader(options, ["doc_id"]).latestOffset() == {"epoch": 0, "position": 180}
    over = again.partitions({"epoch": 0, "position": 180}, {"epoch": 1, "position": 30})
    assert sum(p.last - p.first for p in over) == r.total - 180 + 30 and again.partitions(a, a) == []
    rows = [x for p in first for b in again.read(p) for x in b.to_pylist()]
    assert [x["_position"] for x in rows] == list(range(90)) and len({x["doc_id"] for x in rows}) == 90
    with pytest.raises(ValueError, match="another seed"):
        E.EpochReader(options | {"seed": "2"}, ["doc_id"])
    with pytest.raises(ValueError, match="no rows"):
        E.row_groups(state)
    assert json.loads(Path(state, "offset.json").read_text())
