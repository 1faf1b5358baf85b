"""Demonstrations before a prompt: one of seven distributions, an oracle's rule, random constants, order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.atoms import clause_text, substitute, variables
from ..functions.chance import gumbel, uniform
from ..functions.tokens import clause_tokens
from .demos import order_demos, rank_weights, with_replacement
from .unify import _match, bounded

RANKED = ("zipf", "zipf_headless", "zipf_per_rule", "zipf_per_rule_headless", "full_rank")
DISTRIBUTIONS = ("uniform", *RANKED, "cluster")
NEVER = float("inf")


def resolved_beta(beta: float | None, ranked: bool = True) -> float:
    """How sharply demonstrations are ordered: the given number, else best last or, unless ``ranked``, shuffled."""
    return float(beta) if beta is not None else NEVER if ranked else 0.0


def _key(seed: str, *what) -> Column:
    return F.concat_ws("|", F.lit(seed), *[F.col(w).cast("string") if isinstance(w, str) else w.cast("string") for w in what])


def oracle_schema(ranked: DataFrame, oracle: DataFrame) -> DataFrame:
    """qid, rule_id: the rule (qid, rule_id, rank, lhs, rhs) of which the oracle's ground rule (qid, lhs, rhs) is an instance.

    Sides are compared place by place in canonical order. Rank 1 comes first, then better ranks and lower ids; an
    oracle without a rule is an error.
    """
    o = oracle.select("qid", F.col("lhs").alias("_l"), F.col("rhs").alias("_r"))
    both = o.join(ranked, "qid", "left")
    names = lambda a, b: F.concat(F.transform(a, lambda x: x["predicate"]), F.array(F.lit("→")), F.transform(b, lambda x: x["predicate"]))
    sizes = lambda a, b: F.transform(F.concat(a, b), lambda x: F.size(x["args"]))
    args = lambda a, b: F.flatten(F.transform(F.concat(a, b), lambda x: x["args"]))
    same = (names(F.col("lhs"), F.col("rhs")) == names(F.col("_l"), F.col("_r"))) & (sizes(F.col("lhs"), F.col("rhs")) == sizes(F.col("_l"), F.col("_r")))
    ok = _match(args(F.col("_l"), F.col("_r")), args(F.col("lhs"), F.col("rhs")))[1]
    hit = F.when(same, ok).otherwise(F.lit(False))
    best = both.groupBy("qid").agg(F.min(F.when(hit, F.struct("rank", "rule_id"))).alias("b"))
    found = F.when(F.col("b").isNull(), F.raise_error(F.lit("the oracle's rule is not among the ranked rules")).cast("bigint")).otherwise(F.col("b.rule_id").cast("bigint"))
    return best.select("qid", found.alias("rule_id"))


def sample_demos(ranked: DataFrame, n: int | str, distribution: str, seed: str, alpha: float = 1.0, oracle: DataFrame | None = None, unique: bool = True, beta: float | None = None, in_order: bool = True) -> DataFrame:
    """qid, rule_id, rank, place (from 1, the last nearest to the prompt) of each query's demonstrations.

    ``ranked`` has qid, rule_id, rank, and a rule once a query; ``n`` is a number or the name of a column of
    ``ranked``, the same in all rows of a query. ``uniform`` draws by equal weights, the zipf kinds by rank ** -alpha,
    for each rank as a whole or ``per_rule``, the headless ones without rank 1; with ``unique`` a rule is drawn once and
    fewer rules are all there are. ``full_rank`` orders all rules by 5 - rank plus noise and takes the first. An
    ``oracle`` (qid, rule_id) is always among them, as rank 1; in ``full_rank`` it takes the weakest one's place, at
    random. Cluster selection is ``cluster.select``. Draws depend on seed, qid and rule_id alone.
    """
    if distribution not in DISTRIBUTIONS[:-1]:
        raise ValueError(f"distribution is one of {DISTRIBUTIONS[:-1]}, not {distribution!r}")
    count = F.lit(n) if isinstance(n, int) else F.col(n)
    beta = resolved_beta(beta, in_order)
    rows = ranked.withColumn("_want", count.cast("int"))
    if oracle is not None:
        rows = rows.join(oracle.select("qid", F.col("rule_id").alias("_oracle")), "qid", "left")
    else:
        rows = rows.withColumn("_oracle", F.lit(None).cast("bigint"))
    own = F.coalesce(F.col("rule_id") == F.col("_oracle"), F.lit(False))
    by = Window.partitionBy("qid")
    if distribution == "full_rank":
        noise = F.lit(0.0) if beta == NEVER else uniform(_key(seed, "qid", "rule_id")) if beta == 0 else gumbel(_key(seed, "qid", "rule_id")) / F.lit(beta)
        score = noise if beta == 0 else (F.lit(5) - F.col("rank")) + noise
        r = rows.withColumn("_at", F.row_number().over(by.orderBy(F.desc(score), "rank", "rule_id"))).withColumn("_k", F.least("_want", F.count(F.lit(1)).over(by)))
        missing = F.max((own & (F.col("_at") > F.col("_k"))).cast("int")).over(by) == 1
        r = r.withColumn("_miss", missing).withColumn("_spot", F.floor(uniform(_key(seed, F.lit("spot"), "qid")) * F.col("_k")).cast("int") + 1)
        r = r.where((F.col("_k") > 0) & ((F.col("_at") <= F.col("_k") - F.col("_miss").cast("int")) | own))
        # an oracle that was left out goes before the row now at its spot
        at = F.when(F.col("_miss") & own, F.col("_spot") - 0.5).otherwise(F.col("_at").cast("double"))
        return r.withColumn("place", F.row_number().over(by.orderBy(F.desc(at)))).select("qid", "rule_id", "rank", "place")
    if distribution == "uniform":
        w = rows.withColumn("weight", F.lit(1.0))
    else:
        w = rank_weights(rows, alpha, "per_rule" in distribution)
        if distribution.endswith("headless"):
            head = rows.where("rank <> 1")
            w = rank_weights(head, alpha, "per_rule" in distribution).unionByName(rows.where((F.col("rank") == 1) & own).withColumn("weight", F.lit(0.0)))
    if unique:
        # an oracle comes first, at no weight; the rest by log weight plus Gumbel noise, which leaves them as if renormalised
        key = F.when(own, F.lit(NEVER)).otherwise(F.log("weight") + gumbel(_key(seed, "qid", "rule_id")))
        drawn = w.withColumn("_n", F.row_number().over(by.orderBy(F.desc(key), "rule_id"))).where("_n <= _want").withColumn("_draw", F.lit(0))
    else:
        others = F.col("_want") - F.when(F.col("_oracle").isNotNull(), 1).otherwise(0)
        each = F.explode(F.when(others > 0, F.sequence(F.lit(1), others)).otherwise(F.array().cast("array<int>"))).alias("_draw")
        draws = rows.groupBy("qid").agg(F.first("_want").alias("_want"), F.first("_oracle").alias("_oracle")).select("qid", "_want", "_oracle", each)
        draws = draws.withColumn("u", uniform(_key(seed, "qid", "_draw")))
        forced = w.where(own & (F.col("_want") > 0)).select("qid", "rule_id", "rank", "_oracle", F.lit(0).alias("_draw"))
        drawn = with_replacement(w, draws, ["rule_id", "rank"]).select("qid", "rule_id", "rank", "_oracle", "_draw").unionByName(forced)
    drawn = drawn.withColumn("rank", F.when(own & ((F.col("_draw") == 0) | F.lit(unique)), 1).otherwise(F.col("rank"))).withColumn("_id", F.concat_ws("#", "rule_id", "_draw"))
    return order_demos(drawn, beta, f"{seed}|order", "_id").select("qid", "rule_id", "rank", "place")


def number_of_demos(queries: DataFrame, least: int, most: int, seed: str, oracle: bool = False) -> DataFrame:
    """Adds n_demos, uniform from ``least`` to ``most``; with an oracle at least one is needed, and possible."""
    if least > most or least < 0:
        raise ValueError("demonstrations: 0 <= least <= most")
    if oracle and least < 1:
        raise ValueError("an oracle needs at least one demonstration")
    return queries.withColumn("n_demos", (F.lit(least) + F.floor(uniform(_key(seed, F.lit("n"), "qid")) * (most - least + 1))).cast("int"))


def with_random_constants(rules: DataFrame, constants: list[str], seed: str, *key: str) -> DataFrame:
    """Rules (lhs, rhs) with a constant drawn for each variable by seed, ``key`` columns and the variable's place; both
    sides sorted again. Rules without variables stay."""
    if not constants:
        raise ValueError("constants are needed")
    pool = F.array(*map(F.lit, constants))
    names = F.array_sort(variables(F.concat("lhs", "rhs")))
    draw = lambda v: F.element_at(pool, (F.floor(uniform(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key], v)) * len(constants)) + 1).cast("int"))
    binding = F.map_from_arrays(names, F.transform(names, draw))
    return rules.withColumn("lhs", substitute(F.col("lhs"), binding)).withColumn("rhs", substitute(F.col("rhs"), binding))


def augmented(prompts: DataFrame, demos: DataFrame) -> DataFrame:
    """``prompts`` (qid, prompt: tokens) with the demonstrations (qid, place, lhs, rhs) before them, a <SEP> behind each;
    also demo_instances, their texts in order. Queries without any keep their prompt."""
    d = demos.select("qid", F.struct("place", clause_tokens(F.col("lhs"), F.col("rhs")).alias("t"), clause_text(F.col("lhs"), F.col("rhs")).alias("s")).alias("d"))
    d = d.groupBy("qid").agg(F.array_sort(F.collect_list("d")).alias("d"))
    before = F.flatten(F.transform("d", lambda x: F.concat(x["t"], F.array(F.lit("<SEP>")))))
    j = prompts.join(d, "qid", "left")
    return j.withColumn("prompt", F.when(F.col("d").isNull(), F.col("prompt")).otherwise(F.concat(before, "prompt"))).withColumn("demo_instances", F.coalesce(F.transform("d", lambda x: x["s"]), F.array().cast("array<string>"))).drop("d")


def augment(prompts: DataFrame, ranked: DataFrame, rules: DataFrame, constants: list[str], least: int, most: int, distribution: str, seed: str, everything: bool = False, oracle: DataFrame | None = None, **how) -> DataFrame:
    """Prompts (qid, prompt) with sampled demonstrations before them: how many, which, in what order, with which constants.

    ``ranked`` (qid, rule_id, rank) are the candidates, ``rules`` (rule_id, lhs, rhs) their schemas, a bank. With
    ``everything`` each query gets all its candidates in the order of rule_id, whatever the other settings.
    """
    if everything:
        w = Window.partitionBy("qid").orderBy("rule_id")
        chosen = ranked.select("qid", "rule_id", F.row_number().over(w).alias("place"))
    else:
        n = number_of_demos(prompts.select("qid"), least, most, seed, oracle is not None)
        chosen = sample_demos(ranked.join(n, "qid"), "n_demos", distribution, seed, oracle=oracle, **how)
    ground = with_random_constants(chosen.join(bounded(rules).select("rule_id", "lhs", "rhs"), "rule_id"), constants, seed, "qid", "place")
    return augmented(prompts, ground)


def demo_adapter(base: Callable[[DataFrame], DataFrame], add: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An adapter for ``rollout`` whose model sees prompts with demonstrations.

    ``add`` takes the open rows (qid, step, src_layer, facts, goal) and returns them with a prompt column; ``base``
    answers these. Rows that ``add`` leaves out go to ``base`` as they are, with a null prompt.
    """

    def adapter(rows: DataFrame) -> DataFrame:
        prompts = add(rows).select("qid", "prompt")
        return base(rows.join(prompts, "qid", "left"))

    return adapter


def rule_context(examples: DataFrame, active: DataFrame, fixed: DataFrame, demos: DataFrame) -> DataFrame:
    """key and the texts of the example's active rules, of fixed rules where it is of layer 1 (else none), and of its
    demonstrations with their ranks. ``active`` and ``demos`` have key, place, statement (and rank), ``fixed`` place, statement: a bank's."""
    listed = lambda d, name, *more: d.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "statement", *more))).alias(name))
    once = fixed.agg(F.array_sort(F.collect_list(F.struct("place", "statement"))).alias("f"))  # a bank's rules
    j = examples.select("key", "src_layer").join(listed(active, "a"), "key", "left").join(listed(demos, "d", "rank"), "key", "left").join(F.broadcast(once))
    none = F.array().cast("array<string>")
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x["statement"]), none)
    return j.select("key", texts("a").alias("active_rule_texts"), F.when(F.col("src_layer") == 1, texts("f")).otherwise(none).alias("fixed_rule_texts"), texts("d").alias("demo_schema_texts"), F.coalesce(F.transform("d", lambda x: x["rank"]), F.array().cast("array<int>")).alias("demo_ranks"))
