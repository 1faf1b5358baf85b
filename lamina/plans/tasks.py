"""Tasks: checked options, splits of banks between training and evaluation, and what a run needs to be told or shown."""

from __future__ import annotations

import argparse
import json
import math
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as T
from ..functions.atoms import ATOM_TYPE, let, parse_atom, parse_clause, parse_sequent
from ..functions.chance import uniform
from ..functions.decode import decode_completion, prompt_info, sequent_text
from ..operators.augment import DISTRIBUTIONS, augment, demo_adapter, resolved_beta
from ..operators.unify import bounded
from .banks import POOLS, Bank, BankSpec, build, build_hybrid
from .generate import STEP, problems, with_completions

# --- options


def distances(spec: int | tuple[int, int] | list[int]) -> list[int]:
    """One distance, an inclusive range in either order (a pair), or a list."""
    if isinstance(spec, int):
        return [spec]
    if isinstance(spec, tuple) and len(spec) == 2:
        return list(range(min(spec), max(spec) + 1))
    return [int(d) for d in spec]


def count_spec(text: str) -> int | tuple[int, ...]:
    """``8`` or ``8,6,4``."""
    parts = [int(x) for x in text.split(",")]
    return parts[0] if len(parts) == 1 else tuple(parts)


CONDITIONS = ("internalized", "icl", "hybrid")


def condition_list(text: str) -> tuple[str, ...]:
    names = tuple(x.strip() for x in text.split(",") if x.strip())
    if not names or set(names) - set(CONDITIONS):
        raise ValueError(f"conditions are {CONDITIONS}")
    return names


def constant_list(text: str) -> tuple[str, ...]:
    names = tuple(x.strip() for x in text.split(",") if x.strip())
    if not names:
        raise ValueError("constants are needed")
    return names


@dataclass(frozen=True)
class Options:
    """All settings of a task; combinations that make no sense are errors when it is made."""

    seed: int = 0
    distances: tuple[int, ...] = (1,)
    split: str = "none"  # none, transfer, fresh
    role: str = "train"  # train, eval
    objective: str = "autoregressive"
    completion_format: str = "single"
    fixed_length: str = "batch_max"
    most_facts: int = 3
    attempts: int = 1024
    most_matches: int = 128
    least_demos: int = 0
    most_demos: int = 0
    include_oracle: bool = False
    distribution: str = "uniform"
    alpha: float = 1.0
    in_order: bool = True
    beta: float | None = None
    demo_all: bool = False
    unique: bool = True
    cluster_samples: int = 100
    cluster_k: int = 5
    cluster_distribution: str = "zipf_per_rule"
    unselected: int | None = None
    step: int | None = None

    def __post_init__(self):
        one_of = {"split": ("none", "transfer", "fresh"), "role": ("train", "eval"), "objective": ("autoregressive", "all_at_once"), "completion_format": ("single", "full"), "fixed_length": ("batch_max", "next_pow2", "global_max"), "distribution": DISTRIBUTIONS, "cluster_distribution": DISTRIBUTIONS[1:5]}
        for name, values in one_of.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is one of {values}, not {getattr(self, name)!r}")
        if not self.distances or min(self.distances) < 1:
            raise ValueError("distances are 1 or more")
        if not 0 <= self.least_demos <= self.most_demos:
            raise ValueError("demonstrations: 0 <= least <= most")
        if self.include_oracle and self.most_demos < 1:
            raise ValueError("an oracle needs at least one demonstration")
        if min(self.most_facts, self.attempts, self.most_matches, self.cluster_samples, self.cluster_k) < 1:
            raise ValueError("facts, attempts, matches and clusters are 1 or more")
        if not math.isfinite(self.alpha) or self.alpha < 0 or (self.beta is not None and self.beta < 0):
            raise ValueError("alpha and beta are 0 or more")
        if self.split != "none" and self.distances != (2,):
            raise ValueError(f"the split {self.split!r} has problems of distance 2 alone")
        if self.step is not None and not 0 <= self.step < min(self.distances):
            raise ValueError("the step must be one of every problem")

    @property
    def forced_step(self) -> int | None:
        """The step that records show: the given one; the first in evaluation of a split; else any."""
        return self.step if self.step is not None else 0 if self.split != "none" and self.role == "eval" else None

    @property
    def order(self) -> float:
        return resolved_beta(self.beta, self.in_order)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Options:
        """Settings that an older text lacks have their defaults; unknown ones are an error."""
        d = json.loads(text)
        return cls(**d | {"distances": tuple(d.get("distances", (1,)))})


@dataclass(frozen=True)
class FreshOptions(Options):
    """Options of the fresh split, with the sizes of the banks that every record gets anew."""

    split: str = "fresh"
    distances: tuple[int, ...] = (2,)
    fresh_predicates: int = 4
    fresh_rules: int = 8
    name_length: int = 4

    def __post_init__(self):
        super().__post_init__()
        if min(self.fresh_predicates, self.fresh_rules, self.name_length) < 1:
            raise ValueError("fresh predicates, rules and names are 1 or more")


def options_from_json(text: str) -> Options:
    return (FreshOptions if "fresh_predicates" in json.loads(text) else Options).from_json(text)


def options_from_args(argv: list[str]) -> tuple[Options, BankSpec]:
    """Options and a bank's spec from command-line flags: every field has one, with its default."""
    p = argparse.ArgumentParser()
    lists = {"distances": lambda s: tuple(distances(tuple(int(x) for x in s.split("-"))) if "-" in s else [int(x) for x in s.split(",")])}
    truth = lambda s: {"true": True, "false": False}[s.lower()]
    for f in fields(Options):
        kind = lists.get(f.name) or (truth if isinstance(f.default, bool) else (lambda s: None if s == "none" else float(s) if "." in s or s == "inf" else int(s)) if f.default is None else type(f.default))
        p.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, type=kind, default=f.default)
    pair = lambda s: tuple(int(x) for x in s.split(","))
    d = BankSpec()
    spec = {"n_layers": int, "predicates_per_layer": count_spec, "rules_per_transition": count_spec, "arity": pair, "variables": int, "constants": constant_list, "k_in": pair, "k_out": pair}
    plain = {"predicates_per_layer": d.predicates_per_layer[0], "rules_per_transition": d.rules_per_transition[0]}
    for name, kind in spec.items():
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, type=kind, default=plain.get(name, getattr(d, name)))
    a = vars(p.parse_args(argv))
    return Options(**{f.name: a[f.name] for f in fields(Options)}), BankSpec(**{k: a[k] for k in spec})


def run_config(run_id: int | str, experiment: str, **parts) -> str:
    """What a run was told, as JSON: its id, its experiment and named parts that are not None.

    Data classes are written by their fields; numbers that JSON lacks, and whatever else it lacks, as text.
    """
    told = {"run_id": run_id, "experiment": experiment, **{k: v for k, v in parts.items() if v is not None}}
    text = json.dumps(told, default=lambda v: asdict(v) if is_dataclass(v) else str(v))
    return json.dumps(json.loads(text, parse_constant=str))


# --- records


def one_step(steps: DataFrame, seed: str, step: int | None = None) -> DataFrame:
    """One step of each problem (problem_id, distance, step_idx): the given one, an error if it has none such, or one by seed."""
    if step is not None:
        ok = F.when(F.col("distance") > step, F.col("step_idx") == step).otherwise(F.raise_error(F.lit(f"no step {step} in a problem")).cast("boolean"))
        return steps.where(ok)
    return steps.where(F.col("step_idx") == F.floor(uniform(F.concat_ws("|", F.lit(seed), F.col("problem_id").cast("string"))) * F.col("distance")))


def token_records(steps: DataFrame, ids: Column) -> DataFrame:
    """Adds prompt and completion (ids) to steps with ants, goal and completions (texts)."""
    s = parse_sequent(F.concat("ants", F.lit("⊢"), "goal"))
    clauses = F.transform("completions", lambda t: let(parse_clause(t), lambda c: T.clause_tokens(c["lhs"], c["rhs"])))
    return steps.withColumn("prompt", T.to_ids(let(s, lambda x: T.prompt_tokens(x["ants"], x["cons"])), ids)).withColumn("completion", T.to_ids(T.completion_tokens(clauses), ids))


def record_stats(records: DataFrame) -> DataFrame:
    """distance (null: all), records, max_token, max_prompt, max_completion, max_seq of records with prompt and completion ids."""
    top = F.greatest(F.array_max("prompt"), F.array_max("completion"))
    r = records.select("distance", top.alias("top"), F.size("prompt").alias("p"), F.size("completion").alias("c"))
    return r.groupingSets([[F.col("distance")], []], "distance").agg(F.count(F.lit(1)).alias("records"), F.max("top").alias("max_token"), F.max("p").alias("max_prompt"), F.max("c").alias("max_completion"), F.max(F.col("p") + F.col("c") - 1).alias("max_seq"))


def vocabulary_of(spark: SparkSession, *banks: Bank, sentinel_length: int | None = None) -> dict[str, int]:
    """One vocabulary for banks together, if asked for with sentinels for fresh names that are still to come."""
    names = spark.createDataFrame([(p,) for b in banks for p in b.arity] + [(p,) for p in (T.sentinels(sentinel_length) if sentinel_length else [])], "predicate string")
    constants = sorted({c for b in banks for c in b.spec.constants})
    return T.collected(T.vocabulary(T.bank_names(names, constants, max(b.spec.variables for b in banks))))


def previews(records: DataFrame, names: Column, n: int = 3) -> DataFrame:
    """The first ``n`` records (problem_id, distance, prompt, completion) as columns for people to read: the sequent, the
    completion's and the demonstrations' statements, and the layer that the prompt starts from. A report of n rows."""
    r = records.orderBy("problem_id").limit(n).withColumn("_p", prompt_info(F.col("prompt"), names)).withColumn("_s", T.segments(F.col("prompt")))
    told = lambda x: decode_completion(F.concat(x, F.array(F.lit(T.EOT))), names)["texts"][0]
    demos = F.transform(F.slice("_s", F.lit(1), F.size("_s") - 1), lambda x: told(x))
    texts = decode_completion(F.col("completion"), names)["texts"]
    return r.select("problem_id", "distance", F.col("_p.src_layer").alias("src_layer"), sequent_text(F.col("_p.ants"), F.col("_p.cons")).alias("sequent"), texts.alias("statements"), demos.alias("demos"), F.size("prompt").alias("n_prompt"), F.size("completion").alias("n_completion"))


def rollout_examples(steps: DataFrame, most_steps: int | None = None) -> DataFrame:
    """Examples of ``rollout`` from problems' steps: qid, start_layer, facts, goal, max_steps, oracle_statements."""
    own = F.collect_list(F.struct("step_idx", "ants", "statement"))
    g = steps.groupBy(F.col("problem_id").alias("qid"), "distance", "start_layer", "goal").agg(F.array_sort(own).alias("s"))
    facts = F.array_sort(F.transform(F.split(F.col("s")[0]["ants"], r",(?![^(]*\))"), parse_atom))
    return g.select("qid", "start_layer", facts.cast(f"array<{ATOM_TYPE}>").alias("facts"), parse_atom(F.col("goal")).cast(ATOM_TYPE).alias("goal"), (F.lit(most_steps) if most_steps else F.col("distance")).alias("max_steps"), F.transform("s", lambda x: x["statement"]).alias("oracle_statements"))


def hybrid_demos(steps: DataFrame, chosen: DataFrame) -> DataFrame:
    """qid, place, lhs, rhs: the fresh rules a problem's derivation used, once each, in order of use; a demonstration each.

    ``steps`` are all steps (problem_id, step_idx, template, source), ``chosen`` the problems' ids.
    """
    fresh = steps.where("source = 'fresh'").join(chosen.select("problem_id").distinct(), "problem_id", "left_semi")
    first = fresh.groupBy(F.col("problem_id").alias("qid"), "template").agg(F.min("step_idx").alias("at"))
    w = Window.partitionBy("qid").orderBy("at", "template")
    c = parse_clause(F.col("template"))
    return first.select("qid", F.row_number().over(w).alias("place"), c["lhs"].alias("lhs"), c["rhs"].alias("rhs"))


def hybrid_prompts(steps: DataFrame, chosen: DataFrame, noise: DataFrame, rules: DataFrame, constants: list[str], most: int, seed: str, distribution: str = "uniform", **how) -> DataFrame:
    """qid, prompt (tokens), n_fresh: chosen steps behind the demonstrations of the fresh rules they needed and, up to ``most`` in
    all, from none to all that fit of the base bank's rules (``noise``: qid, rule_id, rank)."""
    from ..operators.augment import augmented, sample_demos, with_random_constants

    s = parse_sequent(F.concat("ants", F.lit("⊢"), "goal"))
    prompts = chosen.select(F.col("problem_id").alias("qid"), let(s, lambda x: T.prompt_tokens(x["ants"], x["cons"])).alias("prompt"))
    need = hybrid_demos(steps, chosen)
    n = prompts.select("qid").join(need.groupBy("qid").agg(F.count(F.lit(1)).alias("n_fresh")), "qid", "left").fillna(0, ["n_fresh"])
    room = F.greatest(F.lit(most) - F.col("n_fresh"), F.lit(0))
    n = n.withColumn("_more", F.floor(uniform(F.concat_ws("|", F.lit(seed), F.lit("n"), F.col("qid").cast("string"))) * (room + 1)).cast("int"))
    more = sample_demos(noise.join(n, "qid").where("_more > 0"), "_more", distribution, seed, **how)
    more = more.join(bounded(rules).select("rule_id", "lhs", "rhs"), "rule_id").select("qid", (F.col("place") + 1_000).alias("place"), "lhs", "rhs")
    ground = with_random_constants(need.unionByName(more), constants, seed, "qid", "place")
    return augmented(prompts, ground).join(n.select("qid", "n_fresh"), "qid")


OF_DEMOS = ("least_demos", "most_demos", "include_oracle", "distribution", "alpha", "in_order", "beta", "demo_all", "unique")


def demonstrated(base: Callable[[DataFrame], DataFrame], options: Options, candidates: Callable[[DataFrame], DataFrame], rules: DataFrame, constants: list[str], oracle: Callable[[DataFrame], DataFrame] | None = None, **other) -> Callable[[DataFrame], DataFrame]:
    """An adapter for ``rollout`` whose model sees the demonstrations that ``options`` ask for, each setting of ``OF_DEMOS`` unless
    ``other`` gives one for this adapter. Together they are checked as options are.

    ``candidates`` gives the rules that open rows can be shown (qid, rule_id, rank), ``oracle`` the one to be among them
    (qid, rule_id), ``rules`` their schemas. Draws differ from step to step. ``base`` gets rows with a prompt (tokens).
    The distribution ``cluster`` is an error here once rows are asked for; its selection is ``cluster.select``.
    """
    if unknown := sorted(set(other) - set(OF_DEMOS)):
        raise ValueError(f"no settings of demonstrations: {unknown}")
    own = replace(options, **other)
    if own.include_oracle and oracle is None:
        raise ValueError("include_oracle needs an oracle")
    how = {"alpha": own.alpha, "unique": own.unique, "beta": own.beta, "in_order": own.in_order}

    def add(rows: DataFrame) -> DataFrame:
        prompts = rows.withColumn("prompt", T.prompt_tokens(F.col("facts"), F.col("goal")))
        if not own.most_demos and not own.demo_all:
            return prompts
        best = oracle(rows) if own.include_oracle and not own.demo_all else None
        least = max(own.least_demos, 1) if best is not None else own.least_demos
        step = rows.agg(F.max("step")).first()[0]  # all open rows are at one step
        return augment(prompts, candidates(rows), rules, constants, least, max(own.most_demos, least), own.distribution, f"{own.seed}|{step}", everything=own.demo_all, oracle=best, **how)

    return demo_adapter(base, add)


# --- splits and tasks


class Split(Protocol):
    """Which bank a role draws its problems from, and which steps it shows."""

    def bank(self, role: str) -> Bank: ...

    def steps(self, spark: SparkSession, options: Options, each: int) -> DataFrame: ...


def _steps(spark: SparkSession, bank: Bank, options: Options, each: int) -> DataFrame:
    return with_completions(problems(spark, bank, list(options.distances), each, options.seed), options.completion_format)


@dataclass(frozen=True)
class NoSplit:
    """Training and evaluation share one bank."""

    base: Bank

    def bank(self, role: str) -> Bank:
        return self.base

    def steps(self, spark: SparkSession, options: Options, each: int) -> DataFrame:
        return one_step(_steps(spark, self.base, options, each), f"{options.seed}|step", options.forced_step)


@dataclass(frozen=True)
class Transfer:
    """Evaluation has a bank with another first layer and the same rules above it."""

    train: Bank
    held: Bank

    def bank(self, role: str) -> Bank:
        return self.train if role == "train" else self.held

    def steps(self, spark: SparkSession, options: Options, each: int) -> DataFrame:
        return one_step(_steps(spark, self.bank(options.role), options, each), f"{options.seed}|step", options.forced_step)


@dataclass(frozen=True)
class Fresh:
    """Every problem has a first layer of its own (``fresh_steps``)."""

    base: Bank

    def bank(self, role: str) -> Bank:
        return self.base

    def steps(self, spark: SparkSession, options: Options, each: int) -> DataFrame:
        return one_step(with_completions(fresh_steps(spark, self.base, options, each), options.completion_format), f"{options.seed}|step", options.forced_step)


def fresh_steps(spark: SparkSession, base: Bank, options: Options, n: int) -> DataFrame:
    """Steps of ``n`` problems, each over a bank of its own with fresh first-layer predicates, and active_rule_texts: the
    bank's rules of the step's layer. A problem has its own seed; after three banks without a derivation it is an error."""
    import pyarrow as pa

    from .banks import fresh_layer0, fresh_names, render
    from .generate import sample_problem

    payload = base.to_json()
    size, rules, length = (getattr(options, k, d) for k, d in (("fresh_predicates", base.spec.predicates_per_layer[0]), ("fresh_rules", base.spec.rules_per_transition[0]), ("name_length", 4)))
    distance, seed, most, attempts = options.distances[0], options.seed, options.most_facts, options.attempts
    text = lambda atoms: ",".join(p + (f"({','.join(a)})" if a else "") for p, a in atoms)

    def run(batches):
        own = Bank.from_json(payload)
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, 7919, i])
                for _ in range(3):
                    bank = fresh_layer0(own, fresh_names(size, rng, length, own.arity), rules, rng)
                    try:
                        start, goal, steps = sample_problem(bank, distance, rng, most_facts=most, attempts=attempts)
                        break
                    except RuntimeError:
                        continue
                else:
                    raise RuntimeError(f"problem {i}: no derivation over three fresh banks")
                for k, (layer, facts, rule, g, source) in enumerate(steps):
                    rows.append((i, distance, start, text([goal]), k, layer, text(facts), render(g), render(rule), source, [render(r) for r in bank.of(layer)]))
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            columns = [c.split() for c in STEP.split(", ")]
            arrays = [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([r[-1] for r in rows], pa.list_(pa.string()))], [*(c for c, _ in columns), "active_rule_texts"])

    return spark.range(0, n, 1, max(1, min(n // 50, 10_000))).mapInArrow(run, f"{STEP}, active_rule_texts array<string>")


#: What is added to a factory's seed for each condition, for its single depths, and for the hybrid bank.
SEEDS = {"internalized": 1, "icl": 2, "hybrid": 3}
DEPTH_SEED, HYBRID_BANK_SEED = 1000, 5000


@dataclass
class TaskFactory:
    """Three conditions over one bank: rules to be learned by heart, shown before the prompt, or some of either."""

    seed: int
    spec: BankSpec = field(default_factory=BankSpec)
    train_depth: int = 3
    eval_depth: int = 5
    demos: Options = field(default_factory=lambda: Options(least_demos=1, most_demos=4, distribution="zipf_per_rule"))
    formats: Mapping[str, str] = field(default_factory=lambda: dict.fromkeys(CONDITIONS, "single"))

    def __post_init__(self):
        if not 1 <= self.train_depth <= self.eval_depth < self.spec.n_layers:
            raise ValueError("1 <= train_depth <= eval_depth < n_layers")
        self.bank = build(self.spec, self.seed)

    def hybrid_bank(self) -> Bank:
        return build_hybrid(self.bank, self.seed + HYBRID_BANK_SEED)[0]

    def options(self, condition: str, depth: int | None = None) -> Options:
        """Options of a condition over all training depths or, for evaluation, of one depth; each has a seed of its own."""
        if condition not in CONDITIONS:
            raise ValueError(f"conditions are {CONDITIONS}")
        if depth is not None and not 1 <= depth <= self.eval_depth:
            raise ValueError(f"depths are 1 to {self.eval_depth}")
        seed = self.seed + (SEEDS[condition] if depth is None else SEEDS[condition] * DEPTH_SEED + depth)
        shown = {} if condition != "internalized" else {"least_demos": 0, "most_demos": 0, "include_oracle": False}
        which = tuple(range(1, self.train_depth + 1)) if depth is None else (depth,)
        return replace(self.demos, seed=seed, distances=which, role="train" if depth is None else "eval", completion_format=self.formats[condition], **shown)

    def steps(self, spark: SparkSession, condition: str, each: int, depth: int | None = None, mode: str = "train") -> DataFrame:
        """Steps with completions: all steps of each problem, for the hybrid condition one of each."""
        o = self.options(condition, depth)
        if condition != "hybrid":
            return _steps(spark, self.bank, o, each)
        if mode not in POOLS:
            raise ValueError(f"modes are {sorted(POOLS)}")
        all_ = with_completions(problems(spark, self.hybrid_bank(), list(o.distances), each, o.seed, mode=mode), o.completion_format)
        return one_step(all_, f"{o.seed}|step")

    def per_depth(self, spark: SparkSession, condition: str, each: int) -> dict[int, DataFrame]:
        return {d: self.steps(spark, condition, each, d) for d in range(1, self.eval_depth + 1)}
