"""Rows that come as one task are dealt over all cores before they are decoded, parsed and matched."""

import pytest
from pyspark.sql import functions as F

from lamina import queries
from lamina.operators import evaluate, schema_match, unify

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["decode_completion", "decode_prompt", "schema_match_rules"])
def test_queries_spread_rows(spark, name):
    assert "Repartition" in plan(queries.QUERIES[name](spark, SF))


def test_operators_spread_rows(spark, monkeypatch):
    seen, cut = [], evaluate.cut
    monkeypatch.setattr(evaluate, "cut", lambda df: (seen.append("Repartition" in plan(df)), cut(df))[1])
    bank = unify.bank(spark, ["r0_1(x1) → r1_1(x1)"])
    one = spark.createDataFrame([(1, 0, "r0_1(a) → r1_1(a)", None)], "key int, src_layer int, statement string, expected string").coalesce(1)
    assert [r["correct"] for r in evaluate.match_rules(one, bank).collect()] == [True] and seen[0]
    names, none = F.create_map(F.lit(11), F.lit("a")), F.array().cast("array<int>")
    seen.clear()
    assert evaluate.completion_paths(one.limit(0).select("key", none.alias("prompt"), none.alias("completion")), names, bank).count() == 0 and seen[0]
    clause = one.select("key", F.array().cast("array<struct<predicate:string,args:array<string>>>").alias("lhs")).withColumn("rhs", F.col("lhs"))
    assert "Repartition" in plan(schema_match.schema_matches(clause, bank))


def test_ranking_vectors_of_shown_rules(spark):
    """A bank of 100,000 rules of which four are shown: distances as of whole vectors, in vectors of four places."""
    from lamina.operators import cluster, demos

    d = spark.createDataFrame([(q, 25_000 * (1 + (q + p) % 4), p + 1, 1) for q in range(4) for p in range(2)], "qid long, rule_id int, place int, rank int")
    whole, short = (demos.ranking_vectors(d, 100_000, 3, among).withColumnRenamed("qid", "vec_id") for among in (None, d))
    of = lambda v: {(r["i"], r["j"]): r["d"] for r in demos.distances(v, v).collect()}
    assert of(whole) == of(short) and {len(r["v"]) for r in short.collect()} == {4}
    assert {len(r["v"]) for r in cluster.vectors_of(d, 100_000, 3, "1").collect()} == {4}
    near = {r["vec_id"]: (r["medoid"], r["d"]) for r in demos.nearest(short, short.where("vec_id in (0, 2)")).collect()}
    want = of(whole)
    assert near == {j: min(((i, want[i, j]) for i in (0, 2)), key=lambda x: (x[1], x[0])) for j in range(4)}


def test_medoids_without_a_join_of_vectors(spark):
    """Assigning vectors to medoids and costing them meets no shuffled or broadcast table of all assignments."""
    from lamina.operators import demos

    v = spark.createDataFrame([(i, [i % 7, i // 7]) for i in range(60)], "vec_id long, v array<int>")
    best, _ = demos.k_medoids(v, [1, 50], 3)
    assert "Aggregate [vec_id" not in plan(best) and "Aggregate [j" not in plan(best)


def test_distances_in_blocks(spark, monkeypatch):
    """More queries than are broadcast, with null, short and broken vectors: pairs in blocks and parts as by definition."""
    from lamina.operators import demos

    monkeypatch.setattr(demos, "QUERIES", 7)
    monkeypatch.setattr(demos, "VECTORS", 9)
    own = {i: [i * i % 11, -i, i % 3] for i in range(20)} | {20: None, 21: [1], 22: [1, None, 3], 23: [], 24: []}
    v = spark.createDataFrame(list(own.items()), "vec_id long, v array<int>")
    got = demos.distances(v, v)
    ok = lambda a, b: a is not None and b is not None and len(a) == len(b) and None not in a + b
    want = {(i, j): float(sum(abs(x - y) for x, y in zip(a, b))) if ok(a, b) else None for i, a in own.items() for j, b in own.items()}
    rows = got.collect()
    assert {(r["i"], r["j"]): r["d"] for r in rows} == want and len(rows) == len(want)
    assert "CoGroup" in plan(got) or "FlatMapCoGroups" in plan(got)
