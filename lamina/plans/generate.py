"""Bulk generation of derivation problems and records: row-local sampling over a range of ids."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chance import distance_seed
from .banks import POOLS, Bank, Rule, render


def matches(lhs, facts, cap: int = 128) -> list[dict]:
    """Bindings under which all left atoms are facts, in the order of facts."""
    found = [{}]
    for predicate, terms in lhs:
        nxt = []
        for binding in found:
            for p, args in facts:
                if p != predicate or len(args) != len(terms):
                    continue
                b = dict(binding)
                if all((b.setdefault(t, c) if t.startswith("x") else t) == c for t, c in zip(terms, args)):
                    nxt.append(b)
        found = nxt
    return found[:cap]


def ground(atoms, binding) -> tuple:
    return tuple(sorted((p, tuple(binding.get(t, t) for t in a)) for p, a in atoms))


def _choose(rules: list[Rule], facts, rng):
    """One rule uniformly of those that apply, with one binding uniformly of its own."""
    ready = []
    for rule in rules:
        found = [b for b in matches(rule[0], facts) if all(t in b or not t.startswith("x") for _, a in rule[1] for t in a)]
        if found:
            ready.append((rule, found[int(rng.integers(len(found)))]))
    return ready[int(rng.integers(len(ready)))] if ready else None


def sample_problem(bank: Bank, distance: int, rng, most_facts: int = 3, attempts: int = 1024, mode: str | None = None, p_fresh: float = 0.0):
    """start layer, goal, and steps (layer, facts, rule, ground rule, source).

    ``mode`` adds fresh rules: each step draws its source, falls back to the other where none applies and is
    labelled by the one used; facts of fresh predicates come in where the step's source is fresh.
    """
    n = bank.spec.n_layers
    if not 1 <= distance < n:
        raise ValueError(f"distance must be 1 to {n - 1}")
    pools = POOLS[mode] if mode else ()
    atom = lambda p: (p, tuple(str(c) for c in rng.choice(bank.spec.constants, bank.arity[p])))
    for _ in range(attempts):
        start = int(rng.integers(0, n - distance))
        sources = [bool(mode) and rng.random() < p_fresh for _ in range(distance)]

        def fresh(k):
            return sorted({p for r in bank.of(k, pools) for p, _ in r[0]})

        pool = bank.layers[start] + (fresh(start) if sources[0] else [])
        take = rng.choice(len(pool), min(len(pool), int(rng.integers(1, most_facts + 1))), replace=False)
        facts, steps = tuple(sorted(atom(pool[i]) for i in take)), []
        if sources[0]:
            facts = tuple(sorted({p: (p, a) for p, a in [*facts, *map(atom, fresh(start))]}.values()))
        for k in range(distance):
            layer = start + k
            both = {True: bank.of(layer, pools), False: bank.of(layer)}
            got, source = _choose(both[sources[k]], facts, rng), sources[k]
            if not got and mode:
                got, source = _choose(both[not source], facts, rng), not source
            if not got:
                break
            rule, binding = got
            lhs, rhs = ground(rule[0], binding), ground(rule[1], binding)
            steps.append((layer, facts, rule, (lhs, rhs), "fresh" if source else "internalized"))
            facts = rhs
            if k + 1 < distance and sources[k + 1]:
                facts = tuple(sorted([*facts, *map(atom, fresh(layer + 1))]))
        else:
            return start, steps[-1][3][1][int(rng.integers(len(steps[-1][3][1])))], steps
    raise RuntimeError("no derivation of this length was found")


STEP = "problem_id long, distance int, start_layer int, goal string, step_idx int, src_layer int, ants string, statement string, template string, source string"


def problems(spark: SparkSession, bank: Bank, distances: list[int], each: int, seed: int, salt: int = 0, mode: str | None = None, p_fresh: float = 0.5, parts: int | None = None) -> DataFrame:
    """One row per step of ``each`` problems of every distance.

    Each problem has a seed of its own from (seed, distance, salt, id), so partitions and retries don't
    change it. The bank goes along as JSON, with the plan.
    """
    payload, wanted = bank.to_json(), list(distances)
    if not wanted or any(not 1 <= d < bank.spec.n_layers for d in wanted):
        raise ValueError("distances must lie between 1 and the number of layers less one")
    text = lambda atoms: ",".join(p + (f"({','.join(a)})" if a else "") for p, a in atoms)

    def run(batches):
        own = Bank.from_json(payload)
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                d = wanted[i // each]
                rng = np.random.default_rng([distance_seed(seed, d, salt), i])
                start, goal, steps = sample_problem(own, d, rng, mode=mode, p_fresh=p_fresh)
                for k, (layer, facts, rule, g, source) in enumerate(steps):
                    rows.append((i, d, start, text([goal]), k, layer, text(facts), render(g), render(rule), source))
            names = [c.split()[0] for c in STEP.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[c.split()[1]]) for k, c in enumerate(STEP.split(", "))], names)

    n = each * len(wanted)
    return spark.range(0, n, 1, parts or max(1, min(n // 200, 10_000))).mapInArrow(run, STEP)


def with_completions(steps: DataFrame, form: str = "single") -> DataFrame:
    """Adds completions: this step's statement, or those from this step to the end (``full``)."""
    from pyspark.sql.window import Window

    if form == "single":
        return steps.withColumn("completions", F.array("statement"))
    if form != "full":
        raise ValueError("form is single or full")
    w = Window.partitionBy("problem_id").orderBy("step_idx").rowsBetween(0, Window.unboundedFollowing)
    return steps.withColumn("completions", F.collect_list("statement").over(w))


def write_dataset(records: DataFrame, path: str, per_file: int = 10_000, meta: dict | None = None, overwrite: bool = False) -> None:
    """Parquet by distance, files of at most ``per_file`` records, beside a metadata table: counts and longest rows by
    distance and over all (distance null), and the configuration. Writers share out distances and problems by ranges. A folder that exists is an error unless ``overwrite``."""
    mode = "overwrite" if overwrite else "errorifexists"
    records.repartitionByRange("distance", "problem_id").write.mode(mode).partitionBy("distance").option("maxRecordsPerFile", per_file).parquet(f"{path}/records")
    written = records.sparkSession.read.parquet(f"{path}/records")
    size = lambda c: F.max(F.size(c)) if c in written.columns else F.lit(None).cast("int")
    both = {"prompt", "completion"} <= set(written.columns)
    seq = F.max(F.size("prompt") + F.size("completion") - 1) if both else F.lit(None).cast("int")
    top = F.max(F.greatest(F.array_max("prompt"), F.array_max("completion"))) if both else F.lit(None).cast("int")
    stats = written.groupingSets([[F.col("distance")], []], "distance").agg(F.countDistinct("problem_id").alias("examples"), F.count(F.lit(1)).alias("records"), F.max(F.length("statement")).alias("max_statement"), size("prompt").alias("max_prompt"), size("completion").alias("max_completion"), seq.alias("max_seq"), top.alias("max_token"))
    stats.withColumn("config", F.lit(json.dumps(meta or {}))).coalesce(1).write.mode(mode).json(f"{path}/metadata")


META = "distance int, examples long, records long, max_statement int, max_prompt int, max_completion int, max_seq int, max_token int, config string"


def read_metadata(spark: SparkSession, path: str, distances: list[int] | None = None, form: str | None = None) -> dict:
    """config, and the longest rows over the distances asked for (all if none are). A dataset without metadata, without a
    distance, or with completions of another form than asked for, is an error."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(META).json(f"{path}/metadata").collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"no metadata at {path}") from e
    config = json.loads(rows[0]["config"]) if rows else {}
    if form is not None and config.get("completion_format", "single") != form:
        raise ValueError(f"completions are {config.get('completion_format', 'single')!r}, not {form!r}")
    by = {r["distance"]: r for r in rows}
    if missing := sorted(set(distances or []) - set(by)):
        raise ValueError(f"no records of distances {missing}")
    own = [by[d] for d in distances] if distances else [r for d, r in by.items() if d is not None]
    names = [c.split()[0] for c in META.split(", ") if c.startswith("max_")]
    return {"config": config} | {n: max((r[n] for r in own if r[n] is not None), default=None) for n in names}


def read_dataset(spark: SparkSession, path: str, distances: list[int] | None = None, form: str | None = None) -> DataFrame:
    read_metadata(spark, path, distances, form)
    df = spark.read.parquet(f"{path}/records")
    return df if distances is None else df.where(F.col("distance").isin(*distances))
