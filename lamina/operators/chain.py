"""Derivation across layers: reachability by predicates, exact steps over facts, sampled chains, path checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.atoms import predicates, subset
from ..functions.chance import uniform
from .goals import interned
from .unify import bounded, facts_of, fire, paired, substitutions


def reachable(rules: DataFrame, n_layers: int) -> DataFrame:
    """rule_id, layer, frontier: predicates derivable layer by layer from each rule's right side.

    The frontier is replaced at every layer, not added to, and ends where no rule fires. ``rules`` is a bank:
    each round is one broadcast join of frontiers with a layer's rules.
    """
    state = rules.select("rule_id", (F.col("src_layer") + 1).alias("layer"), F.array_sort(predicates(F.col("rhs"))).alias("frontier"))
    out, nxt = state, bounded(rules).select(F.col("src_layer").alias("layer"), predicates(F.col("lhs")).alias("need"), predicates(F.col("rhs")).alias("gives"))
    for _ in range(n_layers):
        fired = state.join(nxt, "layer").where(subset(F.col("need"), F.col("frontier")))
        state = fired.groupBy("rule_id", "layer").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("gives")))).alias("frontier")).withColumn("layer", F.col("layer") + 1)
        out = out.unionByName(state)
    return out


def goal_reachable(rules: DataFrame, goal: str, n_layers: int, last_only: bool = False) -> DataFrame:
    """rule_id, reaches: whether the goal's predicate is in a frontier, at any layer or in the last one only."""
    r = reachable(rules, n_layers)
    if last_only:
        r = r.groupBy("rule_id").agg(F.max_by("frontier", "layer").alias("frontier"))
    return r.groupBy("rule_id").agg(F.max(F.array_contains("frontier", goal)).alias("reaches"))


def exact_steps(facts: DataFrame, rules: DataFrame, steps: int, most_lhs: int) -> DataFrame:
    """qid, atoms: every state after exactly ``steps`` steps, a step replacing the facts by one rule's right side.

    ``facts`` are of layer 0. Equal states of a query meet once a round, by content. Without a goal all states are asked
    for; ``goals.reaches_goal`` is the search for one.
    """
    if steps == 0:
        return facts.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("predicate", "args"))).alias("atoms"))
    facts, names = facts.withColumnRenamed("qid", "sid"), None
    for k in range(steps):
        own = rules.where(F.col("src_layer") == k)
        fired = fire(substitutions(facts.withColumnRenamed("sid", "qid"), own, most_lhs, cap=None), own).select(F.col("qid").alias("sid"), F.col("rhs").alias("atoms"))
        fired = fired.withColumnRenamed("sid", "qid") if names is None else fired.join(names, "sid").drop("sid")
        state = interned(fired.select("qid", "atoms"))
        names, facts = state.select("sid", "qid"), facts_of(state.select(F.col("sid").alias("qid"), "atoms")).withColumnRenamed("qid", "sid")
    return state.select("qid", "atoms")


def sample_chain(facts: DataFrame, rules: DataFrame, distance: int, most_lhs: int, seed: str) -> DataFrame:
    """qid, step_idx, rule_id, lhs, rhs: at each step one rule uniformly of those that apply, by its first
    substitution; the derived facts replace the old. Queries without an applicable rule end early."""
    steps = []
    for k in range(distance):
        own = rules.where(F.col("src_layer") == k)
        fired = fire(substitutions(facts, own, most_lhs, cap=1), own)
        pick = Window.partitionBy("qid").orderBy(uniform(F.concat_ws("|", F.lit(seed), "qid", F.lit(k), "rule_id")), "rule_id")
        one = fired.withColumn("_n", F.row_number().over(pick)).where("_n = 1")
        steps.append(one.select("qid", F.lit(k).alias("step_idx"), "rule_id", "lhs", "rhs"))
        facts = facts_of(one.select("qid", F.col("rhs").alias("atoms")))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def rank_rules(facts: DataFrame, rules: DataFrame, goal: str, most_lhs: int, n_layers: int, layer: int = 0) -> DataFrame:
    """qid, rule_id, rank of the layer's rules: 1 applies and reaches the goal, 2 applies, 3 reaches, 4 neither."""
    from .unify import applicable

    own = rules.where(F.col("src_layer") == layer)
    reach = own.select("rule_id").join(goal_reachable(rules, goal, n_layers), "rule_id")
    asked = paired(facts.select("qid").distinct(), reach)
    can = applicable(facts, own, most_lhs).withColumn("can", F.lit(True))
    rank = F.when(F.col("can") & F.col("reaches"), 1).when(F.col("can"), 2).when(F.col("reaches"), 3).otherwise(4)
    return asked.join(can, ["qid", "rule_id"], "left").withColumn("can", F.coalesce("can", F.lit(False))).select("qid", "rule_id", rank.alias("rank"))


def validate_path(paths: DataFrame) -> DataFrame:
    """From path_id, facts, goal and steps (array of struct<known, lhs, rhs>, texts): success, n_steps, reason.

    A fold: a step must be a known rule and its left side hold in the facts, which its right side then
    replaces; the first step that derives the goal ends the path. The first failure names the reason; its step counts.
    """
    start = F.struct(F.col("facts").alias("facts"), F.lit(0).alias("n"), F.lit(False).alias("won"), F.lit("").alias("why"))

    def step(s, x):
        over = s["won"] | (s["why"] != "")
        why = F.when(over, s["why"]).when(~x["known"], "unknown_rule").when(F.size(F.array_except(x["lhs"], s["facts"])) > 0, "inapplicable").otherwise("")
        go = ~over & (why == "")
        return F.struct(F.when(go, x["rhs"]).otherwise(s["facts"]).alias("facts"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"), (s["won"] | (go & F.array_contains(x["rhs"], F.col("goal")))).alias("won"), why.alias("why"))

    end = F.aggregate("steps", start, step)
    return paths.select("path_id", end["won"].alias("success"), end["n"].alias("n_steps"), F.when(end["won"], "").when(end["why"] != "", end["why"]).otherwise("goal_not_reached").alias("reason"))
