"""Selection of demonstrations by clusters: candidate rankings from fresh queries, and a grid of settings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chance import uniform
from ..plans.banks import Bank
from ..plans.generate import sample_problem
from ..session import cut
from .augment import sample_demos
from .chain import reachable
from .demos import distances, k_medoids, ranking_vectors
from .unify import applicable, bounded, facts_of, paired


def fresh_queries(spark: SparkSession, bank: Bank, layer: int, distance: int, n: int, seed: int, most_facts: int = 3) -> DataFrame:
    """qid (0 to n - 1), atoms, goal: the step at ``layer`` of a newly sampled problem; null where it has none."""
    payload = bank.to_json()

    def run(batches):
        own = Bank.from_json(payload)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            facts, goals = [], []
            for i in ids:
                got = None
                try:
                    _, goal, steps = sample_problem(own, distance, np.random.default_rng([seed, layer, i]), most_facts=most_facts, attempts=128)
                    got = next((s[1] for s in steps if s[0] == layer), None)
                except RuntimeError:
                    pass
                facts.append(None if got is None else [{"predicate": p, "args": list(a)} for p, a in got])
                goals.append(None if got is None else goal[0])
            kind = pa.list_(pa.struct([("predicate", pa.string()), ("args", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(facts, kind), pa.array(goals, pa.string())], ["qid", "atoms", "goal"])

    return spark.range(0, n, 1, max(1, min(n // 50, 1000))).mapInArrow(run, "qid long, atoms array<struct<predicate:string,args:array<string>>>, goal string")


def ranks_of(queries: DataFrame, rules: DataFrame, layer: int, n_layers: int, most_lhs: int) -> DataFrame:
    """qid, rule_id, rank of all rules of the layer, each query (qid, atoms, goal: a predicate) with its own goal.

    What a rule reaches is worked out once, as its last frontier, and each query looks its goal up.
    """
    own = rules.where(F.col("src_layer") == layer)
    last = reachable(rules, n_layers).groupBy("rule_id").agg(F.max_by("frontier", "layer").alias("frontier"))
    asked = paired(queries.select("qid", "goal"), own.select("rule_id").join(last, "rule_id"))
    fits = applicable(facts_of(queries.select("qid", "atoms")), own, most_lhs).withColumn("can", F.lit(True))
    can, reach = F.coalesce("can", F.lit(False)), F.array_contains("frontier", F.col("goal"))
    rank = F.when(can & reach, 1).when(can, 2).when(reach, 3).otherwise(4)
    return asked.join(fits, ["qid", "rule_id"], "left").select("qid", "rule_id", rank.alias("rank"))


def candidate_rankings(spark: SparkSession, bank: Bank, layer: int, distance: int, n: int, seed: int, most_lhs: int, actual: DataFrame) -> DataFrame:
    """qid, rule_id, rank of ``n`` fresh queries; one that could not be sampled takes the ``actual`` ranking (rule_id, rank)."""
    rules = bank.frames(spark)["rules"]
    q = cut(fresh_queries(spark, bank, layer, distance, n, seed))
    ranked = ranks_of(q.where("goal is not null"), rules, layer, bank.spec.n_layers, most_lhs)
    failed = paired(q.where("goal is null").select("qid"), actual.select("rule_id", "rank"))
    return cut(ranked.unionByName(failed.select("qid", "rule_id", "rank")))


def vectors_of(demos: DataFrame, n_rules: int, unselected: int, seed: str) -> DataFrame:
    """vec_id, v from demonstrations (qid, rule_id, rank): places from 1 by rank, weakest first, ties at random. A vector has the rules that any of them shows."""
    w = Window.partitionBy("qid").orderBy(F.desc("rank"), uniform(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string"), F.col("rule_id").cast("string"))), "rule_id")
    return ranking_vectors(demos.withColumn("place", F.row_number().over(w)), n_rules, unselected, demos).withColumnRenamed("qid", "vec_id")


def select_grid(candidates: DataFrame, actual: DataFrame, n_rules: int, alphas: list[float], numbers: list[int], ks: list[int], seed: str, distribution: str = "zipf_per_rule", unselected: int | None = None, unique: bool = True, rounds: int = 100) -> DataFrame:
    """k, alpha, n_demos, place, rule_id, rank: for each setting, the demonstrations of the medoid nearest to the actual query's.

    ``candidates`` (qid, rule_id, rank; ids from 0) and ``actual`` (rule_id, rank) rank the rules 1 to ``n_rules``.
    Demonstrations of a weight and number are sampled once, and their vectors serve every k. Medoids start from the
    candidates of least seeded hash; at most as many as there are. Ranks shown are the actual query's, 4 where it has none.
    """
    out = None
    everyone = candidates.select("qid", "rule_id", "rank").unionByName(actual.select(F.lit(-1).cast("long").alias("qid"), "rule_id", "rank"))
    first = [r["qid"] for r in candidates.select("qid").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("qid").cast("string"))), "qid").limit(max(ks)).collect()]
    for alpha in alphas:
        for n in numbers:
            shown = cut(sample_demos(everyone, n, distribution, f"{seed}|{alpha}|{n}", alpha, unique=unique))
            v = cut(vectors_of(shown, n_rules, n + 1 if unselected is None else unselected, seed))
            for k in ks:
                start = first[:k]
                medoids = k_medoids(v.where("vec_id >= 0"), start, rounds)[1] if start else []
                near = distances(v.where("vec_id = -1"), v.where(F.col("vec_id").isin(*medoids) if medoids else F.col("vec_id") == -1)).agg(F.min(F.struct("d", "i")).alias("b"))
                own = shown.join(F.broadcast(near.select(F.col("b.i").alias("qid"))), "qid").select("place", "rule_id")
                ranks = own.join(bounded(actual.select("rule_id", "rank")), "rule_id", "left")
                one = ranks.select(F.lit(k).alias("k"), F.lit(alpha).alias("alpha"), F.lit(n).alias("n_demos"), "place", "rule_id", F.coalesce("rank", F.lit(4)).alias("rank"))
                out = one if out is None else out.unionByName(one)
    return out


def with_oracle(selected: DataFrame, oracle: DataFrame) -> DataFrame:
    """Selected demonstrations (qid, place, rule_id, rank) with the oracle's rule (qid, rule_id) in the last place, as rank 1, if it is missing."""
    by = Window.partitionBy("qid")
    s = selected.join(oracle.select("qid", F.col("rule_id").alias("_o")), "qid", "left").withColumn("_has", F.max((F.col("rule_id") == F.col("_o")).cast("int")).over(by)).withColumn("_last", F.max("place").over(by))
    swap = F.col("_o").isNotNull() & (F.col("_has") == 0) & (F.col("place") == F.col("_last"))
    return s.withColumn("rank", F.when(swap, 1).otherwise(F.col("rank"))).withColumn("rule_id", F.when(swap, F.col("_o")).otherwise(F.col("rule_id"))).drop("_o", "_has", "_last")
