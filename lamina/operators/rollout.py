"""Closed loops: a model proposes one clause a step, and facts follow it until the goal, a failure or the last step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import conjunction_text, parse_clause, subset, substitute
from ..session import cut, spread
from .metrics import rate
from .schema_match import schema_matches
from .unify import bounded, facts_of, substitutions, supported

REASONS = ("decode_error", "unknown_rule", "wrong_rule", "inapplicable", "goal_not_reached")


def instances(clauses: DataFrame, rules: DataFrame, most_lhs: int) -> DataFrame:
    """key, rule_id: the first rule of the clause's layer of which it is an instance. From key, src_layer, lhs, rhs."""
    facts = facts_of(clauses.select(F.col("key").alias("qid"), F.col("lhs").alias("atoms")))
    hit = supported(substitutions(facts, rules, most_lhs, once=True), rules)
    hit = hit.select(F.col("qid").alias("key"), "rule_id", substitute(F.col("lhs"), F.col("binding")).alias("_l"), substitute(F.col("rhs"), F.col("binding")).alias("_r"))
    hit = hit.join(bounded(rules).select("rule_id", "src_layer"), "rule_id")
    return clauses.join(hit, ["key", "src_layer"]).where((F.col("_l") == F.col("lhs")) & (F.col("_r") == F.col("rhs"))).groupBy("key").agg(F.min("rule_id").alias("rule_id"))


def rollout(examples: DataFrame, rules: DataFrame, adapter: Callable[[DataFrame], DataFrame], most_steps: int, most_lhs: int) -> DataFrame:
    """One row per example: qid, success, reason, n_steps, final_layer, final_facts (text), steps (the statements).

    ``examples`` has a unique qid, start_layer, facts (sorted atoms) and goal. At every step ``adapter`` gets
    all open rows (qid, step, src_layer, facts, goal) and returns them with one more column ``answer``, the
    model's clause as text; it may call a model in batches. A clause that doesn't parse is a decode_error; one
    that is no instance of a rule of its layer is an unknown_rule, or a wrong_rule if only predicates' names
    differ from some rule's; one whose left side isn't held is inapplicable. Else its right side replaces the
    facts. The step of a failure counts. A null answer is a decode error; no examples give no rows.

    Each step is cut from its history, so plans stay of one size and only open rows are read again.
    """
    state = spread(examples).select("qid", F.lit(0).alias("step"), F.col("start_layer").cast("int").alias("src_layer"), "facts", "goal", F.array().cast("array<string>").alias("steps"))
    ended = []
    close = lambda d, reason: d.select("qid", F.isnull(reason).alias("success"), reason.alias("reason"), F.col("step").alias("n_steps"), F.col("src_layer").alias("final_layer"), conjunction_text(F.col("facts")).alias("final_facts"), "steps")
    for _ in range(most_steps):
        asked = adapter(state.drop("steps")).select("qid", "answer")
        said = cut(state.join(asked, "qid", "left").withColumn("c", parse_clause(F.col("answer"))))
        clauses = said.where("c is not null").select(F.col("qid").alias("key"), "src_layer", "c.lhs", "c.rhs")
        known = instances(clauses, rules, most_lhs)
        strange = clauses.join(known, "key", "left_anti")
        like = _alike(strange, rules)
        j = said.join(known.withColumnRenamed("key", "qid"), "qid", "left").join(like.withColumnRenamed("key", "qid"), "qid", "left")
        reason = F.when(F.col("c").isNull(), "decode_error").when(F.col("rule_id").isNull(), F.when(F.col("matched"), "wrong_rule").otherwise("unknown_rule"))
        reason = reason.when(~subset(F.col("c.lhs"), F.col("facts")), "inapplicable")
        j = j.withColumn("reason", reason).withColumn("steps", F.concat("steps", F.array("answer"))).withColumn("step", F.col("step") + 1)
        j = cut(j.select("qid", "step", "src_layer", "facts", "goal", "steps", "reason", "c"))
        ended.append(close(j.where("reason is not null"), F.col("reason")))
        went = j.where("reason is null").select("qid", "step", (F.col("src_layer") + 1).alias("src_layer"), F.col("c.rhs").alias("facts"), "goal", "steps")
        won = F.array_contains("facts", F.col("goal"))
        ended.append(close(went.where(won), F.lit(None).cast("string")))
        state = went.where(~won)
    out = close(state, F.lit("goal_not_reached"))
    for e in ended:
        out = out.unionByName(e)
    return out


def _alike(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """key, matched against the rules of each clause's own layer."""
    tagged = lambda d, *names: d.select(*names, "src_layer", "lhs", "rhs")
    layers = [r["src_layer"] for r in rules.select("src_layer").distinct().collect()]  # a bank's layers
    out = None
    for k in layers:
        one = schema_matches(tagged(clauses, "key").where(F.col("src_layer") == k), rules.where(F.col("src_layer") == k))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else clauses.select("key", F.lit(False).alias("matched"))


def rollout_metrics(results: DataFrame) -> DataFrame:
    """Counts and rates of success and of every reason, and the mean number of steps; rates of nothing are 0."""
    n = F.count(F.lit(1))
    counts = {"success": F.count_if("success")} | {k: F.count_if(F.coalesce(F.col("reason") == k, F.lit(False))) for k in REASONS}
    return results.agg(n.alias("n"), *(c.alias(f"n_{k}") for k, c in counts.items()), *(rate(c, n).alias(f"{k}_rate") for k, c in counts.items()), F.coalesce(F.avg("n_steps"), F.lit(0.0)).alias("avg_steps"))
