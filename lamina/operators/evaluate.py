"""Scores of a model's answers as token rows: rules matched by source, completion paths, reachability of the goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import RULE_TYPE, clause_text, conjunction_text, let, parse_clause
from ..functions.decode import decode_completion, prompt_info
from ..session import cut, spread
from .goals import reaches_goal  # noqa: F401  a score like the others
from .metrics import rate
from .schema_match import alike_by, keyed_templates, signature
from .unify import _match, bounded, substitutions

#: Candidate rules are tried in this order.
SOURCES = ("active", "fixed", "demo")
TEXTS = dict(zip(SOURCES, ("active_rule_texts", "fixed_rule_texts", "demo_schema_texts")))


def rules_of_texts(texts: Column) -> Column:
    """Statements to an array of struct<pos, lhs, rhs>: malformed ones are left out, absent texts (null) stay null."""
    parsed = F.transform(texts, lambda t, i: F.struct(i.alias("pos"), parse_clause(t).alias("c")))
    good = F.filter(parsed, lambda p: p["c"].isNotNull())
    return F.transform(good, lambda p: F.struct(p["pos"].alias("pos"), p["c"]["lhs"].alias("lhs"), p["c"]["rhs"].alias("rhs")))


def _sources(answers: DataFrame, contexts: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Answers with ``_bank`` (the bank's rules are their active ones) and the contexts' rules: key, prio, pos, t."""
    if contexts is None:
        return answers.withColumn("_bank", F.lit(True)), None
    one = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in TEXTS.values()))
    one = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("one context for each example")).cast("long")).otherwise(F.col("_n")))
    both = cut(answers.join(one.where("_n >= 0"), "key", "left"))
    each = F.array(*(F.transform(rules_of_texts(F.col(TEXTS[source])), lambda r: F.struct(F.lit(prio).alias("prio"), r["pos"].alias("pos"), F.struct(r["lhs"].alias("lhs"), r["rhs"].alias("rhs")).cast(RULE_TYPE).alias("t"))) for prio, source in enumerate(SOURCES)))  # noqa: B023
    own = both.select("key", F.explode(F.flatten(F.filter(each, lambda x: x.isNotNull()))).alias("r")).select("key", "r.*")
    return both.select(*answers.columns, F.col(TEXTS["active"]).isNull().alias("_bank")), own


def _names(rule: Column) -> Column:
    """Equal for a rule and its instances: the predicates of either side with their arities, sorted."""
    side = lambda s: F.array_join(F.array_sort(_kinds(s)), " ")
    return F.concat_ws("|", side(rule["lhs"]), side(rule["rhs"]))


def _kinds(atoms: Column) -> Column:
    return F.transform(atoms, lambda a: F.concat(a["predicate"], F.lit("/"), F.size(a["args"]).cast("string")))


def _twins(rule: Column) -> Column:
    """Whether a side has two atoms of one predicate and arity, so that more than one order of atoms may match."""
    twice = lambda s: F.size(F.array_distinct(_kinds(s))) < F.size(s)
    return twice(rule["lhs"]) | twice(rule["rhs"])


def _terms(rule: Column) -> Column:
    """All terms of a rule, its atoms in the order of predicate and arity."""
    placed = lambda s: F.array_sort(F.transform(s, lambda a: F.struct(a["predicate"].alias("p"), F.size(a["args"]).alias("n"), a["args"].alias("args"))))
    return F.concat(*(F.flatten(F.transform(placed(rule[side]), lambda a: a["args"])) for side in ("lhs", "rhs")))


def instances(pairs: DataFrame) -> DataFrame:
    """Those of pairs (key, prio, pos, t, g, of equal names) where g is t with values for its variables, each atom used once.

    Where predicates differ within a side, sorted atoms stand opposite one another and terms are compared in place.
    Other pairs are matched as bodies are: g's atoms are facts that serve one atom of t each.
    """
    plain = pairs.where(~_twins(F.col("t")) & _match(_terms(F.col("g")), _terms(F.col("t")))[1]).select("key", "prio", "pos")
    hard = pairs.where(_twins(F.col("t")))
    if hard.isEmpty():
        return plain
    hard = cut(hard)
    tag = lambda r: F.concat(*(F.transform(r[side], lambda a: F.struct(F.concat(F.lit(side), a["predicate"]).alias("predicate"), a["args"].alias("args"))) for side in ("lhs", "rhs")))  # noqa: E731, B023
    rules = cut(hard.select("t").distinct().withColumn("rule_id", F.monotonically_increasing_id()))
    given = hard.join(rules, "t").select(F.col("key").alias("qid"), "rule_id", "prio", "pos")
    facts = hard.select("key", "g").distinct().select(F.col("key").alias("qid"), F.posexplode(tag(F.col("g"))).alias("fact_idx", "a")).select("qid", "fact_idx", "a.predicate", "a.args")
    most = hard.agg(F.max(F.size("t.lhs") + F.size("t.rhs"))).first()[0]
    found = substitutions(facts, rules.select("rule_id", tag(F.col("t")).alias("lhs")), most, cap=1, once=True, given=given.select("qid", "rule_id").distinct().select("*", F.lit(0).alias("gid"), F.create_map().cast("map<string,string>").alias("need")))
    return plain.unionByName(given.join(found.select("qid", "rule_id"), ["qid", "rule_id"]).select(F.col("qid").alias("key"), "prio", "pos"))


def match_rules(answers: DataFrame, bank: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One row for each answer: key, src_layer, statement, pos, match_source, decode_error, unknown, wrong, valid, correct.

    ``answers`` has a unique key, src_layer, statement (text, null if it could not be decoded) and expected (text or
    null). The bank's rules of an answer's layer are active, with their rule_id for pos, unless the answer's context
    (key and the arrays ``TEXTS``) brings active rules of its own, be they none; a context's fixed and demonstrated rules
    come after. At most one context a key: a second is an error. An answer that is no clause is a decode error. One that is
    an instance of a candidate is valid, by the first source and rule it is an instance of, and wrong if another statement
    was expected. Else it is wrong if only the predicates' names differ from some candidate's, and unknown if not even
    that. Rules and answers meet by equal predicates, and what is left by equal structures: both are equi-joins.
    """
    said = cut(spread(answers).withColumn("c", parse_clause(F.col("statement"))))
    ground = said.where("c is not null").select("key", "src_layer", F.struct("c.lhs", "c.rhs").cast(RULE_TYPE).alias("g"))
    ground, own = _sources(ground.withColumn("_s", _names(F.col("g"))), contexts)
    rules = bank.select("src_layer", F.lit(0).alias("prio"), F.col("rule_id").alias("pos"), F.struct("lhs", "rhs").cast(RULE_TYPE).alias("t"))
    pairs = ground.where("_bank").join(bounded(rules.withColumn("_s", _names(F.col("t")))), ["src_layer", "_s"]).select("key", "prio", "pos", "t", "g")
    if own is not None:
        pairs = pairs.unionByName(ground.join(own.withColumn("_s", _names(F.col("t"))), ["key", "_s"]).select("key", "prio", "pos", "t", "g"))
    exact = cut(instances(pairs).groupBy("key").agg(F.min(F.struct("prio", "pos")).alias("m")))
    left = ground.join(exact, "key", "left_anti").withColumn("_sig", signature(F.col("g.lhs"), F.col("g.rhs"))).drop("_s")
    shapes = keyed_templates(rules.select("src_layer", "t.lhs", "t.rhs")).select("src_layer", "_key", "_named", signature(F.col("lhs"), F.col("rhs")).alias("_sig")).distinct()
    alike = alike_by(left.where("_bank"), shapes, ["src_layer"], bounded)
    if own is not None:
        asked = own.join(left.select("key"), "key", "left_semi")
        texts = keyed_templates(asked.select("t").distinct().select("t", "t.lhs", "t.rhs"))  # each once, however many contexts it is in
        by_key = asked.select("key", "t").join(texts.select("t", "_key", "_named", signature(F.col("lhs"), F.col("rhs")).alias("_sig")), "t").drop("t").distinct()
        alike = alike.unionByName(alike_by(left, by_key, ["key"], lambda d: d)).distinct()
    j = said.join(exact, "key", "left").join(alike.withColumn("alike", F.lit(True)), "key", "left")
    failed, valid = F.col("c").isNull(), F.col("m").isNotNull()
    text = F.when(~failed, clause_text(F.col("c.lhs"), F.col("c.rhs")))
    other = valid & F.col("expected").isNotNull() & (text != F.col("expected"))
    alike_ = F.coalesce("alike", F.lit(False))
    source = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("m.prio") + 1)
    return j.select("key", "src_layer", text.alias("statement"), F.col("m.pos").alias("pos"), F.when(valid, source).alias("match_source"), failed.alias("decode_error"), (~failed & ~valid & ~alike_).alias("unknown"), ((~failed & ~valid & alike_) | F.coalesce(other, F.lit(False))).alias("wrong"), valid.alias("valid"), (valid & ~F.coalesce(other, F.lit(False))).alias("correct"))


def answers_of_rows(rows: DataFrame, names: Column, single: bool = True) -> DataFrame:
    """key, src_layer, statement, expected from key and id rows: xs (with the prompt), predicted and gold completions.

    A prompt that can't be read is an error, as it is the data's and not the model's; completions that can't are null.
    """
    from ..functions.decode import display_text

    layer = let(prompt_info(F.col("xs"), names), lambda p: F.when(p["error"].isNull(), p["src_layer"]).otherwise(F.raise_error(F.concat(F.lit("prompt: "), p["error"])).cast("int")))
    return spread(rows).select("key", layer.alias("src_layer"), display_text(F.col("predicted"), names, single).alias("statement"), display_text(F.col("gold"), names, single).alias("expected"))


def completion_paths(rows: DataFrame, names: Column, bank: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """One row for each of rows (key, prompt, completion: ids): key, success, reason, n_steps, final_layer, final_facts.

    A completion's statements are steps from the prompt's facts up the layers: each must be an instance of a rule
    (else unknown_rule), and its left side must hold in the facts (else inapplicable), which its right side
    replaces; the first that derives the goal ends the path. A failing step counts. A completion that can't be
    decoded has no steps. Steps are matched all at once, as a step's layer is its place, and then folded.
    """
    info, done = prompt_info(F.col("prompt"), names), decode_completion(F.col("completion"), names)
    ok = F.when(F.col("p.error").isNotNull(), F.raise_error(F.concat(F.lit("prompt: "), F.col("p.error"))).cast("boolean")).otherwise(F.lit(True))
    d = cut(spread(rows).select("key", info.alias("p"), done.alias("d")).where(ok))
    steps = d.where("d.error is null").select("key", "p.src_layer", F.posexplode("d.texts").alias("step", "statement"))
    asked = steps.select(F.struct("key", "step").alias("key"), (F.col("src_layer") + F.col("step")).alias("src_layer"), "statement", F.lit(None).cast("string").alias("expected"))
    by_step = contexts
    if contexts is not None:
        by_step = steps.select("key", "step").join(contexts, "key").withColumn("key", F.struct("key", "step")).drop("step")
    m = match_rules(asked, bank, by_step).select("key.key", F.col("key.step").alias("step"), "statement", "decode_error", "valid")
    path = m.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("step", parse_clause(F.col("statement")).cast(RULE_TYPE).alias("c"), "decode_error", "valid"))).alias("steps"))
    j = d.join(path, "key", "left")
    none = F.lit(None).cast("string")
    start = F.struct(F.col("p.ants").alias("facts"), F.lit(0).alias("n"), F.lit(0).alias("up"), F.lit(False).alias("won"), none.alias("why"))

    def step(s, x):
        over = s["won"] | s["why"].isNotNull()
        c = x["c"]
        why = F.when(x["decode_error"], "decode_error").when(~x["valid"], "unknown_rule").when(F.size(F.array_except(c["lhs"], s["facts"])) > 0, "inapplicable")
        go = ~over & why.isNull()
        return F.struct(
            F.when(go, c["rhs"]).otherwise(s["facts"]).alias("facts"),
            (s["n"] + (~over).cast("int")).alias("n"),
            (s["up"] + go.cast("int")).alias("up"),
            (s["won"] | (go & F.array_contains(c["rhs"], F.col("p.cons")))).alias("won"),
            F.when(over, s["why"]).otherwise(why).alias("why"),
        )

    j = j.withColumn("e", F.aggregate(F.coalesce("steps", F.array().cast("array<struct<step:int,c:" + RULE_TYPE + ",decode_error:boolean,valid:boolean>>")), start, step))
    reason = F.when(F.col("d.error").isNotNull(), "decode_error").when(~F.col("e.won"), F.coalesce("e.why", F.lit("goal_not_reached")))
    return j.select("key", F.col("e.won").alias("success"), reason.alias("reason"), F.col("e.n").alias("n_steps"), (F.col("p.src_layer") + F.col("e.up")).alias("final_layer"), conjunction_text(F.array_sort("e.facts")).alias("final_facts"))


PATH_REASONS = ("decode_error", "unknown_rule", "inapplicable", "goal_not_reached")


def path_metrics(paths: DataFrame) -> DataFrame:
    """Counts and rates of success and of every reason, and the mean number of steps; rates of nothing are 0."""
    n = F.count(F.lit(1))
    counts = {"success": F.count_if("success")} | {k: F.count_if(F.coalesce(F.col("reason") == k, F.lit(False))) for k in PATH_REASONS}
    return paths.agg(n.alias("n"), *(c.alias(f"n_{k}") for k, c in counts.items()), *(rate(c, n).alias(f"{k}_rate") for k, c in counts.items()), F.coalesce(F.avg("n_steps"), F.lit(0.0)).alias("avg_steps"))


def completions_valid(rows: DataFrame, names: Column, bank: DataFrame, form: str = "single", contexts: DataFrame | None = None) -> DataFrame:
    """key, valid: a single completion must be an instance of a rule of the prompt's layer, a full one a path to the goal."""
    if form == "full":
        return completion_paths(rows, names, bank, contexts).select("key", F.col("success").alias("valid"))
    if form != "single":
        raise ValueError("form is single or full")
    asked = answers_of_rows(rows.select("key", F.col("prompt").alias("xs"), F.col("completion").alias("predicted"), F.col("completion").alias("gold")), names)
    return match_rules(asked.withColumn("expected", F.lit(None).cast("string")), bank, contexts).select("key", "valid")


def first_transitions(rows: DataFrame) -> DataFrame:
    """Rows (src_layer) of the first transition."""
    return rows.where("src_layer = 0")


def first_transition_metrics(matches: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Counts and rates over the answers of the first transition; ``reached`` (key, reaches) tells which lead to the goal."""
    m = first_transitions(matches).join(reached, "key", "left") if reached is not None else first_transitions(matches).withColumn("reaches", F.lit(False))
    c = {k: F.count_if(F.coalesce(v, F.lit(False))) for k, v in {"valid": F.col("valid"), "reachable": F.col("valid") & F.col("reaches"), "decode_error": F.col("decode_error"), "unknown": F.col("unknown"), "wrong": F.col("wrong")}.items()}
    n = F.count(F.lit(1))
    return m.agg(n.alias("n"), *(v.alias(f"n_{k}") for k, v in c.items()), (n - c["valid"]).alias("n_invalid"), *(rate(v, n).alias(f"{k}_rate") for k, v in c.items()), rate(c["reachable"], c["valid"]).alias("reachable_given_valid"))


