"""Conjunctive matching of rules against facts, and what follows from a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.atoms import RULE_TYPE, is_variable, parse_rule, subset, substitute, variables
from ..session import cut
from .bodies import PLAN, Bodies, closed, closes, plan, used_by, values

FACTS_A_PART = 100_000  # of capped matching: an atom's choices are many times its facts
FEW_RULES = 8  # a plan of joins for each, where a body is one cycle
MOST_RULES = 100_000  # a bank is configuration; larger ones are joined without broadcast


def bank(spark: SparkSession, texts: list[str], layers: list[int] | None = None) -> DataFrame:
    """A literal rule bank: rule_id (by place), src_layer, lhs, rhs."""
    rows = []
    for i, text in enumerate(texts):
        lhs, rhs = parse_rule(text)
        rows.append((i + 1, layers[i] if layers else 0, lhs, rhs))
    side = RULE_TYPE[len("struct<") : -1].replace("lhs:", "lhs ").replace(",rhs:", ", rhs ")
    return spark.createDataFrame(rows, f"rule_id int, src_layer int, {side}")


def small(rules: DataFrame) -> bool:
    """Whether a bank has at most ``MOST_RULES`` rules; counts at most one row beyond the limit."""
    return rules.limit(MOST_RULES + 1).count() <= MOST_RULES


def bounded(rules: DataFrame) -> DataFrame:
    """The rules, marked for broadcast if they are few enough."""
    return F.broadcast(rules) if small(rules) else rules


def paired(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row with every rule (rule_id, ...) of a bank, where that is the result asked for: ranks of all rules.

    A bank that is few is broadcast; a larger one is dealt into parts of some ten thousand rules, and rows to each part.
    """
    if small(rules):
        return rows.withColumn("_o", F.lit(1)).join(F.broadcast(rules.withColumn("_o", F.lit(1))), "_o").drop("_o")
    parts = 1 + rules.count() // 10_000
    own = rules.withColumn("_o", F.pmod(F.xxhash64("rule_id"), F.lit(parts)).cast("int"))
    return rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(own, "_o").drop("_o")


def _shape(terms) -> list:
    """What an atom's terms ask of a fact's arguments: vars (each once), at (their first places, from 1), same (pairs of places
    with one variable) and fixed (places with a constant). Worked out once a rule, not once a fact."""
    at = F.transform(terms, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i"), F.array_position(terms, t).cast("int").alias("j")))
    first = F.filter(at, lambda x: is_variable(x["t"]) & (x["i"] == x["j"]))
    same = F.filter(at, lambda x: is_variable(x["t"]) & (x["i"] != x["j"]))
    return [F.transform(first, lambda x: x["t"]).alias("vars"), F.transform(first, lambda x: x["i"]).alias("at"), same.alias("same"), F.filter(at, lambda x: ~is_variable(x["t"])).alias("fixed")]


def _agrees(args):
    """Whether arguments, as many as there are terms, fit the shape in columns vars, at, same and fixed."""
    return F.forall("same", lambda x: F.element_at(args, x["i"]) == F.element_at(args, x["j"])) & F.forall("fixed", lambda x: F.element_at(args, x["i"]) == x["t"])


def _match(args, terms):
    """Pairs of term and constant, and whether they agree: constants equal, each variable with one value."""
    pairs = F.array_distinct(F.zip_with(terms, args, lambda v, c: F.struct(v.alias("v"), c.alias("c"))))
    bound = F.filter(pairs, lambda p: is_variable(p["v"]))
    ok = F.forall(pairs, lambda p: is_variable(p["v"]) | (p["v"] == p["c"])) & (F.size(F.array_distinct(F.transform(bound, lambda p: p["v"]))) == F.size(bound))
    names = F.transform(bound, lambda p: p["v"])
    return F.filter(bound, lambda p, i: F.array_position(names, p["v"]) == i + 1), ok  # one pair a variable, also where they disagree


def _plans(rules: DataFrame, most_lhs: int) -> tuple[DataFrame, dict, bool]:
    """rule_id and the rules' plans, what of them is in use, and whether they are few enough for broadcast.

    Few rules are planned on the driver, which holds the bank for broadcast anyway; more are by tasks.
    """
    spark, own = rules.sparkSession, rules.select("rule_id", "lhs").where(F.size("lhs").between(1, most_lhs))
    kind = f"rule_id {rules.schema['rule_id'].dataType.simpleString()}, {PLAN}"
    head = own.limit(MOST_RULES + 1).collect()
    if len(head) <= MOST_RULES:
        rows = [(r["rule_id"], *plan(r["lhs"])) for r in head]
        return F.broadcast(spark.createDataFrame(rows, kind)), used_by([r[3] for r in rows]), True
    made = F.udf(lambda lhs: plan(lhs), f"struct<{PLAN.replace(' ', ':', 1).replace(', twins ', ',twins:').replace(', stages ', ',stages:')}>", useArrow=True)
    plans = cut(own.select("rule_id", made("lhs").alias("p")).select("rule_id", "p.*"))
    return plans, used_by([r["stages"] for r in plans.select("stages").distinct().collect()]), False


def relation(facts: DataFrame, atoms: DataFrame, keys: list[str], given: DataFrame | None) -> DataFrame:
    """``keys``, fact_idx, b: facts that agree with an atom's terms, and, where ``given``, with the values asked for."""
    met = facts.join(atoms, ["p", "arity"]).where(_agrees(F.col("args"))).withColumn("b", F.map_from_arrays("vars", F.transform("at", lambda i: F.element_at("args", i))))
    if given is not None:
        met = met.join(given, ["qid", "rule_id"]).where(F.forall(F.map_entries(F.col("need")), lambda e: F.coalesce(F.try_element_at(F.col("b"), e["key"]) == e["value"], F.lit(True))))
    return met.select(*keys, "fact_idx", "b")


def _prepared(facts: DataFrame, rules: DataFrame, most_lhs: int, given: DataFrame | None) -> Bodies:
    plans, used, few = _plans(rules, most_lhs)
    keys = ["qid", "rule_id"] + (["gid"] if given is not None else [])
    atoms = rules.where(F.size("lhs").between(1, most_lhs)).select("rule_id", F.posexplode("lhs").alias("pos", "atom")).select("rule_id", "pos", F.col("atom.predicate").alias("p"), F.size("atom.args").alias("arity"), *_shape(F.col("atom.args")))
    facts = facts.select("qid", "fact_idx", F.col("predicate").alias("p"), F.size("args").alias("arity"), "args")
    if used["steps"]:  # each atom reads them, and of three or more each in turn is a table
        facts = cut(facts)
    rel = []
    for pos in range(max(used["steps"], default=-1) + 2):
        own = atoms.where(F.col("pos") == pos).drop("pos")
        r = relation(facts, F.broadcast(own) if few else own, keys, given)
        rel.append(cut(r) if len(used["steps"]) > 1 else r)
    return Bodies(rel, plans, keys, used, facts)


def _bindings(lhs: list):
    """The map of a body's variables, of which each is a column."""
    names = dict.fromkeys(t for a in lhs for t in a["args"] if t.startswith("x"))
    return F.create_map(*[c for v in names for c in (F.lit(v), F.col(v))]).alias("binding")


def substitutions(facts: DataFrame, rules: DataFrame, most_lhs: int, cap: int | None = 128, once: bool = False, given: DataFrame | None = None, used: bool = True) -> DataFrame:
    """qid, rule_id, binding, used for each way in which a rule's left side holds in a query's facts.

    ``facts`` (qid, fact_idx, predicate, args) meet the atoms of every rule by predicate and arity; then one more atom at a
    time joins within query and rule by the variables it shares. Facts may serve several atoms unless ``once``.
    Beyond ``cap`` solutions of a query and rule, those last in the order of fact positions are left out: after each
    atom only the first ``cap`` choices stay that lead to a solution, so no more are ever joined than ``cap`` times
    an atom's facts. (With ``once``, rules with two atoms of one predicate and arity are cut at the end alone.)
    Uncapped bodies with a cycle bind its variables first, by the atom with the fewest values.
    ``given`` (qid, rule_id, gid, need: variable to value) restricts queries to these rules and values; gid tells
    several needs of a query and rule apart. Bodies of no atom or more than ``most_lhs`` match nothing.
    Without ``used``, that column is left out and a query's facts are taken as distinct: uncapped, an atom all of whose variables a
    cycle has bound and checked is not joined again for its fact. Up to ``FEW_RULES`` rules, each one cycle with all its variables, are met on
    plain columns; there facts may repeat.
    """
    bare = not used and cap is None and not once
    if bare and given is None:
        head = rules.select("rule_id", "lhs").where(F.size("lhs").between(1, most_lhs)).limit(FEW_RULES + 1).collect()
        if 0 < len(head) <= FEW_RULES and all(closes(r["lhs"]) for r in head):
            kind = rules.schema["rule_id"].dataType
            each = [closed(facts, r["lhs"]).select("qid", F.lit(r["rule_id"]).cast(kind).alias("rule_id"), _bindings(r["lhs"])) for r in head]
            return reduce(DataFrame.unionByName, each)
    b = _prepared(facts.withColumn("fact_idx", F.lit(0)) if bare else facts, rules, most_lhs, given)
    state = b.rel[0].join(b.plans.select("rule_id", "k", "twins"), "rule_id").select(*b.keys, "k", "twins", F.col("b").alias("binding"), F.array("fact_idx").alias("used"))
    parts = 1 + b.facts.count() // FACTS_A_PART if cap is not None and len(b.rel) > 1 else 1
    dealt = lambda df, *by: df.repartition(parts, *b.keys, *by) if parts > 1 else df  # noqa: E731  # else Spark's parts are few, and a task sorts more as facts grow
    done = []
    for i in range(len(b.rel)):
        if cap is not None:
            state = b.open_prefixes(state, i) if b.used["steps"].get(i) or b.used["core"].get(i) else state
            n = F.row_number().over(Window.partitionBy(*b.keys).orderBy("used"))
            if once:
                n = F.when(F.col("twins") & (F.col("k") > i + 1), 0).otherwise(n)
            state = dealt(state).withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")
        elif i == 0:
            state = b.closed_cycles(state, 0, used=not bare)
        done.append(state.where(F.col("k") == i + 1))
        if i + 1 == len(b.rel):
            break
        if bare and i + 1 in b.used["closed"]:
            state = state.where(F.col("k") > i + 1)
            continue
        names = F.get("stages", F.lit(i))["full" if cap is None else "join"].alias("_names")
        by = b.plans.select("rule_id", names)
        nxt = b.rel[i + 1].join(by, "rule_id").select(*b.keys, "fact_idx", "b", values(F.col("b"), F.col("_names")).alias("_key"))
        state = state.where(F.col("k") > i + 1).join(by, "rule_id").withColumn("_key", values(F.col("binding"), F.col("_names")))
        met = dealt(state.drop("_names"), "_key").join(dealt(nxt, "_key"), [*b.keys, "_key"])
        if once:
            met = met.where(~F.array_contains("used", F.col("fact_idx")))
        fresh = F.map_filter("b", lambda v, _: ~F.map_contains_key(F.col("binding"), v))
        state = met.select(*b.keys, "k", "twins", F.map_concat("binding", fresh).alias("binding"), F.concat("used", F.array("fact_idx")).alias("used"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("k", "twins") if used else out.drop("k", "twins", "used")


def supported(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches that bind every variable of the right side."""
    rhs = bounded(rules).select("rule_id", "lhs", "rhs")
    return matches.join(rhs, "rule_id").where(subset(variables(F.col("rhs")), F.map_keys("binding")))


def applicable(facts: DataFrame, rules: DataFrame, most_lhs: int, given: DataFrame | None = None) -> DataFrame:
    """qid, rule_id of rules that apply: their first atoms' facts, held against all other atoms. No solution is ever built.

    Variables of the right side must be on the left side too.
    """
    b = _prepared(facts, rules, most_lhs, given)
    bound = rules.where(subset(variables(F.col("rhs")), variables(F.col("lhs")))).select("rule_id")
    state = b.rel[0].select(*b.keys, F.col("b").alias("binding")).join(bounded(bound), "rule_id")
    if b.used["steps"].get(0) or b.used["core"].get(0):
        state = b.open_prefixes(state, 0)
    return state.select("qid", "rule_id").distinct()


def fire(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches with both sides instantiated."""
    m = supported(matches, rules)
    return m.withColumn("lhs", substitute(F.col("lhs"), F.col("binding"))).withColumn("rhs", substitute(F.col("rhs"), F.col("binding")))


def facts_of(atoms: DataFrame) -> DataFrame:
    """qid and an array of atoms to one row per fact, in canonical order."""
    return atoms.select("qid", F.posexplode(F.array_sort(F.array_distinct("atoms"))).alias("fact_idx", "a")).select("qid", "fact_idx", F.col("a.predicate").alias("predicate"), F.col("a.args").alias("args"))
