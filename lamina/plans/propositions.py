"""Propositional banks and problems: rules between layers of plain propositions, matched as subsets."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.chance import distance_seed

Rule = tuple  # (left propositions, right propositions)
VERSION = 1


def place(name: str) -> tuple[int, int]:
    """(layer, number) of ``p<layer>_<number>``, the order of propositions."""
    layer, n = name[1:].split("_")
    return int(layer), int(n)


@dataclass
class PropositionBank:
    layers: int
    per_layer: int
    rules: list[tuple[int, Rule]]  # source layer, rule

    def names(self, layer: int) -> list[str]:
        return [f"p{layer}_{i + 1}" for i in range(self.per_layer)]

    def of(self, layer: int) -> list[Rule]:
        return [r for s, r in self.rules if s == layer]

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "layers": self.layers, "per_layer": self.per_layer, "rules": [{"src_layer": s, "lhs": a, "rhs": b, "statement": statement((a, b))} for s, (a, b) in self.rules]}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> PropositionBank:
        d = json.loads(text)
        if d.get("version") != VERSION:
            raise ValueError(f"bank version {d.get('version')!r}")
        side = lambda names: tuple(sorted(names, key=place))
        return cls(d["layers"], d["per_layer"], [(r["src_layer"], (side(r["lhs"]), side(r["rhs"]))) for r in d["rules"]])

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, s, statement(r), list(r[0]), list(r[1])) for i, (s, r) in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_id int, src_layer int, statement string, lhs array<string>, rhs array<string>")


def statement(rule: Rule) -> str:
    return f"{' ∧ '.join(rule[0])} → {' ∧ '.join(rule[1])}"


def _sides(names: list[str], most: int) -> int:
    """How many sides of at most ``most`` of the propositions there are."""
    from math import comb

    return sum(comb(len(names), k) for k in range(1, most + 1))


def build(layers: int, per_layer: int, n_rules: int, most_in: int, most_out: int, seed: int) -> PropositionBank:
    """``n_rules`` different rules from each layer to the next; sizes of sides are uniform, propositions of a side differ."""
    if layers < 2 or min(per_layer, n_rules, most_in, most_out) < 1:
        raise ValueError("two layers or more, and one or more of everything else")
    most_in, most_out = min(most_in, per_layer), min(most_out, per_layer)
    bank, rng = PropositionBank(layers, per_layer, []), np.random.default_rng(seed)
    if _sides(bank.names(0), most_in) * _sides(bank.names(0), most_out) < n_rules:
        raise ValueError("there are not so many different rules")
    for layer in range(layers - 1):
        found: set[Rule] = set()
        while len(found) < n_rules:
            pick = lambda k, most: tuple(sorted(rng.permutation(bank.names(k))[: int(rng.integers(1, most + 1))].tolist(), key=place))
            found.add((pick(layer, most_in), pick(layer + 1, most_out)))
        bank.rules += [(layer, r) for r in sorted(found, key=lambda r: (len(r[0]), [place(x) for x in r[0]], len(r[1]), [place(x) for x in r[1]]))]
    return bank


def sample_problem(bank: PropositionBank, distance: int, rng, most_facts: int = 3, attempts: int = 1024):
    """start layer, goal, steps (layer, facts, rule): at each step one rule uniformly of those whose left side holds."""
    if not 1 <= distance < bank.layers:
        raise ValueError(f"distance must be 1 to {bank.layers - 1}")
    most_facts = max(1, min(most_facts, bank.per_layer))
    for _ in range(attempts):
        start = int(rng.integers(0, bank.layers - distance))
        facts, steps = set(rng.permutation(bank.names(start))[: int(rng.integers(1, most_facts + 1))].tolist()), []
        for layer in range(start, start + distance):
            ready = [r for r in bank.of(layer) if facts.issuperset(r[0])]
            if not ready:
                break
            rule = ready[int(rng.integers(len(ready)))]
            steps.append((layer, sorted(facts, key=place), rule))
            facts = set(rule[1])
        else:
            last = sorted(facts, key=place)
            return start, last[int(rng.integers(len(last)))], steps
    raise RuntimeError("no derivation of this length was found")


STEP = "problem_id long, distance int, start_layer int, goal string, step_idx int, src_layer int, ants string, statement string"


def problems(spark: SparkSession, bank: PropositionBank, distances: list[int], each: int, seed: int, parts: int | None = None) -> DataFrame:
    """One row per step of ``each`` problems of every distance, each with a seed of its own."""
    payload, wanted = bank.to_json(), list(distances)
    if not wanted or any(not 1 <= d < bank.layers for d in wanted):
        raise ValueError("distances must lie between 1 and the number of layers less one")

    def run(batches):
        own = PropositionBank.from_json(payload)
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                d = wanted[i // each]
                start, goal, steps = sample_problem(own, d, np.random.default_rng([distance_seed(seed, d), i]))
                rows += [(i, d, start, goal, k, layer, ",".join(facts), statement(rule)) for k, (layer, facts, rule) in enumerate(steps)]
            columns = [c.split() for c in STEP.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], [c for c, _ in columns])

    n = each * len(wanted)
    return spark.range(0, n, 1, parts or max(1, min(n // 200, 10_000))).mapInArrow(run, STEP)
