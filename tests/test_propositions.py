"""Propositional rows and division against definitions by hand and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import propositions as P
from lamina.functions import tokens as T
from lamina.operators import division, unify


@pytest.fixture(scope="module")
def vocabulary(spark):
    names = [f"p{k}_{i}" for k in range(3) for i in (1, 2, 10)]
    return T.collected(T.proposition_vocabulary(spark.createDataFrame([(n,) for n in names], "name string")))


def ids(vocabulary, symbols):
    return [vocabulary[s] for s in symbols.split()]


def test_prompts(spark, vocabulary):
    assert [vocabulary[n] for n in ("p0_1", "p0_2", "p0_10", "p1_1")] == [10, 11, 12, 13]
    good = {
        "p0_1 , p0_10 ⊢ p1_2 <START>": (["p0_1", "p0_10"], "p1_2"),
        "⊢ p1_2 <START>": ([], "p1_2"),
        "p0_2 , ⊢ p1_2 <START>": (["p0_2"], "p1_2"),
        "p0_1 ⊢ p0_1 <SEP> p0_2 ⊢ p1_2 <START> <PAD>": (["p0_2"], "p1_2"),
        "( p0_1 ∧ ( p0_2 → p0_1 ) ) , p0_2 ⊢ ( p1_1 → p1_2 ) <START>": (["(p0_1∧(p0_2→p0_1))", "p0_2"], "(p1_1→p1_2)"),
        "p0_1 ⊢ <PAD> p1_2 <START> p0_1": (["p0_1"], "p1_2"),
    }
    bad = ["", "<START>", "p0_1 ⊢ p1_1", "p0_1 ⊢ p1_1 <START> <START>", "p0_1 p0_2 ⊢ p1_1 <START>", "p0_1 ⊢ <START>", "p0_1 , p1_1 <START>", "p0_1 ⊢ p1_1 ⊢ p1_2 <START>", ", p0_1 ⊢ p1_1 <START>", "p0_1 ∧ p0_2 ⊢ p1_1 <START>", "( p0_1 ) ⊢ p1_1 <START>", "( p0_1 ∧ p0_2 ⊢ p1_1 <START>", "p0_1 ⊢ p1_1 , <START>", "p0_1 <EOT> ⊢ p1_1 <START>"]
    data = [(k, ids(vocabulary, k)) for k in [*good, *bad]] + [("alien", [99, 1, 10, 8]), ("null", None)]
    d = spark.createDataFrame(data, "k string, row array<int>").withColumn("d", P.decode_prompt(F.col("row"), T.name_map(vocabulary)))
    for r in d.collect():
        if r["k"] in good:
            assert (r["d"]["ants"], r["d"]["cons"], r["d"]["error"]) == (*good[r["k"]], None), r
        else:
            assert r["d"]["error"] and r["d"]["ants"] is None and r["d"]["cons"] is None, r


def test_completions(spark, vocabulary):
    good = {"p0_1 → p1_1 <EOT>": "p0_1 → p1_1", "p0_10 ∧ p0_2 → p1_1 ∧ p1_10 <EOT>": "p0_10 ∧ p0_2 → p1_1 ∧ p1_10"}
    bad = ["", "<EOT>", "p0_1 → p1_1", "p0_1 p0_2 → p1_1 <EOT>", "p0_1 → <EOT>", "→ p1_1 <EOT>", "p0_1 → p1_1 → p1_2 <EOT>", "( p0_1 ∧ p0_2 ) → p1_1 <EOT>", "p0_1 , p0_2 → p1_1 <EOT>", "p0_1 ∧ p0_2 <EOT>", "p0_1 → p1_1 <PAD> <EOT>", "p0_1 → p1_1 <SEP> p0_1 → p1_1 <EOT>", "p0_1 ∧ → p1_1 <EOT>"]
    data = [(k, ids(vocabulary, k)) for k in [*good, *bad]] + [("alien", [10, 3, 99, 9]), ("null", None)]
    d = spark.createDataFrame(data, "k string, row array<int>").withColumn("d", P.decode_completion(F.col("row"), T.name_map(vocabulary)))
    for r in d.collect():
        if r["k"] in good:
            left, right = good[r["k"]].split(" → ")
            assert (r["d"]["text"], r["d"]["lhs"], r["d"]["rhs"], r["d"]["error"]) == (good[r["k"]], left.split(" ∧ "), right.split(" ∧ "), None)
        else:
            assert r["d"]["error"] and r["d"]["text"] is None, r


def test_encoding(spark, vocabulary):
    d = spark.createDataFrame([("p0_1, p0_10 ⊢\tp1_2", "p0_1∧p0_2 → p1_1")], "s string, c string")
    own, names = T.id_map(vocabulary), T.name_map(vocabulary)
    r = d.select(P.prompt_ids(F.col("s"), own).alias("p"), P.completion_ids(F.col("c"), own).alias("c")).first()
    assert r["p"] == ids(vocabulary, "p0_1 , p0_10 ⊢ p1_2 <START>") and r["c"] == ids(vocabulary, "p0_1 ∧ p0_2 → p1_1 <EOT>")
    for bad in ("p0", "p0_", "p_1", "p9_9", "x", "p0_1;p0_2", "<PAD>"):
        with pytest.raises(Exception, match="unknown token"):
            spark.createDataFrame([(bad,)], "s string").select(P.prompt_ids(F.col("s"), own)).collect()
    row = F.array(*map(F.lit, [0, *r["p"], 0]))
    got = spark.range(1).select(P.readable(row, names), P.readable(row, names, special=False), P.readable(row, names, padding=True)).first()
    assert tuple(got) == ("p0_1,p0_10⊢p1_2<START>", "p0_1,p0_10⊢p1_2", "<PAD>p0_1,p0_10⊢p1_2<START><PAD>")


def test_division(spark):
    r = np.random.default_rng(3)
    facts = [(q, f"f{k}") for q in range(40) for k in r.integers(0, 12, 7)] + [(1, None), (50, None)]
    rules = [(i, [f"f{k}" for k in r.integers(0, 13, int(r.integers(1, 5)))]) for i in range(60)] + [(100, []), (101, ["f1", None]), (102, ["f1", "f1"]), (103, None)]
    have = {q: {f for x, f in facts if x == q} for q in {q for q, _ in facts}}
    want = {(q, i) for q, own in have.items() for i, need in rules if need is not None and None not in need and set(need) <= own}
    got = division.applicable(spark.createDataFrame(facts, "qid long, fact string"), spark.createDataFrame(rules, "rule_id int, need array<string>"))
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def shuffled(spark, df):
    """Rows that the stages of a query hand on, all of them together."""
    store, array = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteRecords() for s in (all_.apply(i) for all_ in [store.stageList(None, False, False, array, None)] for i in range(all_.size())))
    before = total()
    rows = df().collect()
    return rows, total() - before


def test_division_asks_equal_sets_once(spark):
    """Queries and rules of few sets: 22,500 pairs, whose needs are not held against facts pair by pair."""
    n, names = 150, [f"p{i}" for i in range(6)]
    facts = spark.createDataFrame([(q, f) for q in range(n) for f in names], "qid long, fact string")
    rules = spark.createDataFrame([(r, names) for r in range(n)], "rule_id int, need array<string>")
    got, moved = shuffled(spark, lambda: division.applicable(facts, rules))
    assert {(r["qid"], r["rule_id"]) for r in got} == {(q, r) for q in range(n) for r in range(n)} and len(got) == n * n
    assert moved < n * n


def test_division_writes_little(spark, tmp_path):
    """2,400,000 pairs of one set of facts and one of needs: their files hold far less than a byte a pair."""
    n, m = 400, 6000
    facts = spark.range(n).select(F.col("id").alias("qid"), F.lit("p").alias("fact"))
    rules = spark.range(m).select((F.col("id") * 7919 % 1000003).alias("rule_id"), F.array(F.lit("p")).alias("need"))
    division.applicable(facts, rules).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == n * m
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < n * m / 4


def test_division_keeps_null_ids(spark):
    facts = spark.createDataFrame([(1, "p"), (None, "p")], "qid long, fact string")
    rules = spark.createDataFrame([(2, ["p"]), (None, ["p"])], "rule_id int, need array<string>")
    assert sorted(map(str, division.applicable(facts, rules).collect())) == sorted(f"Row(qid={q}, rule_id={r})" for q in (1, None) for r in (2, None))


def test_division_without_broadcast(spark, monkeypatch):
    facts = spark.createDataFrame([(q, f"p{i}") for q in range(20) for i in range(q % 4)] + [(30, None), (None, "p0")], "qid long, fact string")
    rules = spark.createDataFrame([(r, [f"p{i}" for i in range(r % 3)]) for r in range(9)] + [(20, ["p0", None]), (21, None), (22, ["q"])], "rule_id int, need array<string>")
    want = sorted(map(str, division.applicable(facts, rules).collect()))
    monkeypatch.setattr(unify, "MOST_RULES", 3)
    assert sorted(map(str, division.applicable(facts, rules).collect())) == want
    assert len(want) == sum(sum(r % 3 <= q % 4 for r in range(9)) for q in range(20) if q % 4) + 3 + 6
