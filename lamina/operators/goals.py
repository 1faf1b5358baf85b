"""Whether a goal is derivable in exactly so many steps: demand flows back from the goal, states forward within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import is_variable
from ..session import cut
from .unify import _agrees, _shape, applicable, bounded, facts_of, fire, small, substitutions

#: More needs than these of one goal, number of steps and rule are replaced by none: demand may be too wide, never too narrow.
MOST_NEEDS = 8
NEED = "array<struct<v:string,c:string>>"


def interned(states: DataFrame) -> DataFrame:
    """Distinct rows with ``sid``, a number of their own: equal by content, not by a hash. A written table."""
    return cut(states.distinct().withColumn("sid", F.monotonically_increasing_id()))


def feeds(rules: DataFrame) -> DataFrame:
    """rule_id, before, pairs: rules ``before`` whose right side has, for each atom of the rule's left side, one that may become it.

    ``pairs`` are the terms (mine, theirs) that must then be equal: of those left-side atoms for which just one of the other
    rule's atoms will do.
    """
    side = lambda s, name: rules.select(F.col("rule_id").alias(name), F.size("lhs").alias(f"n_{name}"), F.posexplode(s).alias(f"pos_{name}", "a")).select(name, f"n_{name}", f"pos_{name}", F.col("a.predicate").alias("p"), F.size("a.args").alias("arity"), F.col("a.args").alias(f"args_{name}"))
    mine, theirs = side("lhs", "rule_id"), side("rhs", "before")
    theirs = F.broadcast(theirs) if small(rules) else theirs
    pairs = F.zip_with("args_rule_id", "args_before", lambda m, t: F.struct(m.alias("m"), t.alias("t")))
    met = mine.join(theirs, ["p", "arity"]).withColumn("pairs", pairs).where(F.forall("pairs", lambda x: is_variable(x["m"]) | is_variable(x["t"]) | (x["m"] == x["t"])))
    by_atom = met.groupBy("rule_id", "before", "n_rule_id", "pos_rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("pairs").alias("pairs"))
    both = by_atom.groupBy("rule_id", "before", "n_rule_id").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list(F.when(F.col("n") == 1, F.col("pairs")))).alias("pairs"))
    return both.where("n = n_rule_id").select("rule_id", "before", "pairs")


def _consistent(values: Column) -> Column:
    """Pairs (v, c): constants equal to themselves, and each variable with one value."""
    own = F.filter(values, lambda x: is_variable(x["v"]))
    return F.forall(values, lambda x: is_variable(x["v"]) | (x["v"] == x["c"])) & (F.size(F.array_distinct(F.transform(own, lambda x: x["v"]))) == F.size(own))


def demand(goals: DataFrame, rules: DataFrame, most_steps: int) -> DataFrame:
    """goal, left, rule_id, gid, need: the rules that may be of use ``left`` steps before ``goal`` (distinct), and values they need.

    One step before, a rule must have the goal on its right side; earlier, a right side that may hold the
    left side of a rule that is of use later. ``need`` maps variables to the values that follow from the goal; a
    state's rule that lacks them cannot lead to it. One table is written for each step.
    """
    heads = rules.select("rule_id", F.explode("rhs").alias("a")).select("rule_id", F.col("a.predicate").alias("p"), F.size("a.args").alias("arity"), *_shape(F.col("a.args")))
    heads = F.broadcast(heads) if small(rules) else heads
    asked = goals.select("goal", F.col("goal.predicate").alias("p"), F.size("goal.args").alias("arity")).join(heads, ["p", "arity"]).where(_agrees(F.col("goal.args")))
    pair = F.zip_with("vars", "at", lambda v, i: F.struct(v.alias("v"), F.element_at("goal.args", i).alias("c")))
    now = cut(asked.select("goal", "rule_id", F.array_sort(pair).cast(NEED).alias("need")).distinct().groupBy("goal", "rule_id").agg(F.array_sort(F.collect_set("need")).alias("needs")))
    out = now.withColumn("left", F.lit(1))
    step = cut(feeds(rules)) if most_steps > 1 else None
    for left in range(2, most_steps + 1):
        own = now.select("goal", "rule_id", F.explode("needs").alias("need")).join(bounded(step), "rule_id")
        known = F.map_from_arrays(F.transform("need", lambda x: x["v"]), F.transform("need", lambda x: x["c"]))
        given = F.transform("pairs", lambda x: F.struct(x["t"].alias("v"), F.when(is_variable(x["m"]), F.try_element_at(F.col("_known"), x["m"])).otherwise(x["m"]).alias("c")))
        own = own.withColumn("_known", known).withColumn("_v", F.array_distinct(F.filter(given, lambda x: x["c"].isNotNull()))).where(_consistent(F.col("_v")))
        need = F.array_sort(F.filter("_v", lambda x: is_variable(x["v"]))).cast(NEED)
        back = own.select("goal", F.col("before").alias("rule_id"), need.alias("need")).groupBy("goal", "rule_id").agg(F.array_sort(F.collect_set("need")).alias("needs"))
        now = cut(back.withColumn("needs", F.when(F.size("needs") > MOST_NEEDS, F.array(F.array().cast(NEED))).otherwise(F.col("needs"))))
        out = out.unionByName(now.withColumn("left", F.lit(left)))
    return out.select("goal", "left", "rule_id", F.posexplode("needs").alias("gid", "n")).select("goal", "left", "rule_id", "gid", F.map_from_entries("n").alias("need"))


def reaches_goal(states: DataFrame, bank: DataFrame, most_steps: int, most_lhs: int) -> DataFrame:
    """qid, reaches from states (qid, atoms, goal, steps): whether the goal holds after exactly so many more steps.

    Each step replaces the atoms by the right side of any rule that applies. A state meets only the rules that the demand
    for its goal allows with as many steps left, with the values it asks for. Equal states of a query and goal meet
    once a round; the last step asks whether a demanded rule applies and builds nothing; a query that is won leaves.
    Fewer than no steps reach nothing; more than ``most_steps`` are an error. Null atoms are no state.
    """
    over = F.when(F.col("steps") > most_steps, F.raise_error(F.lit("more steps than most_steps")).cast("int")).otherwise(F.col("steps"))
    asked = cut(states.select("qid", "goal", over.alias("left"), F.array_sort(F.array_distinct("atoms")).alias("atoms")))
    won = asked.where((F.col("left") == 0) & F.array_contains("atoms", F.col("goal"))).select("qid")
    if most_steps:
        wanted = demand(asked.where("left > 0").select("goal").distinct(), bank, most_steps)
        open_ = interned(asked.where("left > 0 and atoms is not null"))
        for _ in range(most_steps):
            given = open_.join(wanted, ["goal", "left"])
            facts = facts_of(open_.select(F.col("sid").alias("qid"), "atoms"))
            ask = lambda rows: rows.select(F.col("sid").alias("qid"), "rule_id", "gid", "need")
            last = applicable(facts, bank, most_lhs, ask(given.where("left = 1"))).select(F.col("qid").alias("sid")).distinct()
            here = cut(open_.join(last, "sid").select("qid"))
            won = won.unionByName(here)
            fired = fire(substitutions(facts, bank, most_lhs, None, given=ask(given.where("left > 1"))), bank).select(F.col("qid").alias("sid"), F.col("rhs").alias("new"))
            nxt = fired.join(open_.where("left > 1").select("sid", "qid", "goal", "left"), "sid").join(here.distinct(), "qid", "left_anti")
            open_ = interned(nxt.select("qid", "goal", (F.col("left") - 1).alias("left"), F.array_distinct("new").alias("atoms")))
            if open_.isEmpty():
                break
    return asked.select("qid").distinct().join(won.distinct().withColumn("_w", F.lit(True)), "qid", "left").select("qid", F.coalesce("_w", F.lit(False)).alias("reaches"))
