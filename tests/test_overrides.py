"""Adapters with demonstrations from a task's options, and settings that one adapter has for itself."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import atoms as A
from lamina.plans import tasks

TEXTS = {1: "r0_1(x1) → r1_1(x1)", 2: "r0_2(x1) → r1_2(x1)", 3: "r0_3(x1) → r1_3(x1)", 4: "r0_4(x1) → r1_4(x1)"}


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame([(q, 0, "r0_1(a)", "r2_1(b)") for q in range(40)], "qid int, step int, f string, g string")
    rows = d.select("qid", "step", F.lit(0).alias("src_layer"), F.array(A.parse_atom(F.col("f"))).alias("facts"), A.parse_atom(F.col("g")).alias("goal"))
    r = spark.createDataFrame(list(TEXTS.items()), "rule_id int, s string").withColumn("c", A.parse_clause(F.col("s")))
    return rows, r.select("rule_id", "c.lhs", "c.rhs")


def shown(tables, options, **other):
    """The demonstrations' rules in each query's prompt, in order."""
    rows, rules = tables
    candidates = lambda open_: open_.select("qid", F.explode(F.array(*map(F.lit, TEXTS))).alias("rule_id")).withColumn("rank", F.col("rule_id"))
    base = lambda d: d.withColumn("answer", F.array_join("prompt", ""))
    adapter = tasks.demonstrated(base, options, candidates, rules, ["k"], oracle=lambda open_: open_.select("qid", F.lit(3).alias("rule_id")), **other)
    out = {}
    for r in adapter(rows).collect():
        *demos, prompt = r["answer"].split("<SEP>")
        assert prompt == "r0_1(a)⊢r2_1(b)<START>"
        out[r["qid"]] = [next(i for i in TEXTS if x == f"r0_{i}(k)→r1_{i}(k)") for x in demos]
    assert sorted(out) == list(range(40))
    return out


def test_settings(tables):
    plain = tasks.Options()
    some = tasks.Options(least_demos=1, most_demos=3)
    assert not any(shown(tables, plain).values())
    got = shown(tables, some)
    assert {len(x) for x in got.values()} == {1, 2, 3} and all(len(set(x)) == len(x) for x in got.values())
    assert got == shown(tables, plain, least_demos=1, most_demos=3)  # as if the task had them
    assert {len(x) for x in shown(tables, some, least_demos=2, most_demos=2).values()} == {2}
    assert all(3 in x for x in shown(tables, some, include_oracle=True).values())
    assert all(x == [1, 2, 3, 4] for x in shown(tables, some, demo_all=True).values())
    assert any(len(set(x)) < len(x) for x in shown(tables, some, least_demos=3, unique=False).values())
    assert all(1 not in x for x in shown(tables, some, distribution="zipf_headless").values())


def test_errors(tables):
    some = tasks.Options(least_demos=1, most_demos=3)
    for bad in ({"least_demos": 4}, {"alpha": -1.0}, {"distribution": "none"}, {"seed": 3}, {"other": 1}):
        with pytest.raises(ValueError):
            shown(tables, some, **bad)
    with pytest.raises(ValueError, match="oracle"):
        tasks.demonstrated(lambda d: d, some, lambda d: d, tables[1], ["k"], include_oracle=True)
