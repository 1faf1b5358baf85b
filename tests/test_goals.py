"""Goal-directed search against a search of all states."""

import random

from pyspark.sql import functions as F

from lamina.functions.atoms import ATOM_TYPE
from lamina.operators import chain, goals, unify
from test_bodies import bank, search

RULES = [
    ([("a", ["x1", "x2"])], [("c", ["x2", "x1"])]),
    ([("a", ["x1", "x2"]), ("b", ["x2", "x3"])], [("c", ["x1", "x3"]), ("d", ["x3"])]),
    ([("b", ["x1", "x1"])], [("d", ["x1"])]),
    ([("c", ["x1", "x2"])], [("e", ["x1"]), ("e", ["x2"]), ("a", ["x1", "x2"])]),
    ([("c", ["x1", "x2"]), ("d", ["x2"])], [("f", ["x2", "x1"]), ("g", ["k0"])]),
    ([("d", ["k1"])], [("f", ["k1", "k1"])]),
    ([("e", ["x1"]), ("a", ["x1", "x2"])], [("g", ["x2"])]),
    ([("a", ["x1", "x2"])], [("h", ["x1", "x5"])]),
]


def rules(spark):
    out = bank(spark, [RULES[0][0]], RULES[0][1])
    for i, (lhs, rhs) in enumerate(RULES[1:], 1):
        out = out.unionByName(bank(spark, [lhs], rhs).withColumn("rule_id", F.lit(i)))
    return out


def after(state):
    out = set()
    for lhs, rhs in RULES:
        for b, _ in search(sorted(lhs), sorted((p, list(a)) for p, a in state)):
            if all(t in b or not t.startswith("x") for _, args in rhs for t in args):
                out.add(frozenset((p, tuple(b.get(t, t) for t in args)) for p, args in rhs))
    return out


def reaches(state, goal, steps):
    if steps == 0:
        return goal in state
    return steps > 0 and any(reaches(s, goal, steps - 1) for s in after(state))


def cases():
    """Half of the goals are atoms of a state that lies so many steps ahead, if there is one."""
    r, out = random.Random(2), []
    for q in range(70):
        k = lambda: f"k{r.randrange(3)}"
        state = frozenset((r.choice("ab"), (k(), k())) for _ in range(r.randrange(1, 5)))
        p, n = r.choice("acdefgh"), r.randrange(-1, 4)
        goal, ahead = (p, tuple(k() for _ in range({"d": 1, "e": 1, "g": 1}.get(p, 2)))), [state]
        for _ in range(n if q % 2 else 0):
            ahead = sorted({s for x in ahead for s in after(x)}, key=sorted) or ahead
        out.append((q, state, r.choice(sorted(r.choice(ahead))) if q % 2 else goal, n))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(q, [(p, list(a)) for p, a in sorted(s)], (g[0], list(g[1])), n) for q, s, g, n in rows], f"qid int, atoms array<{ATOM_TYPE}>, goal {ATOM_TYPE}, steps int")


def test_like_a_search(spark, monkeypatch):
    want = {q: reaches(s, g, n) for q, s, g, n in cases()}
    assert 10 < sum(want.values()) < 60
    states = frame(spark, cases()).unionByName(frame(spark, cases()[:5]))  # repeated rows
    got = {r["qid"]: r["reaches"] for r in goals.reaches_goal(states, rules(spark), 3, 2).collect()}
    assert got == want
    monkeypatch.setattr(goals, "MOST_NEEDS", 0)  # demand without values
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(0).cast("long"))  # all hashes collide
    some = states.where("qid % 3 = 0")
    assert {r["qid"]: r["reaches"] for r in goals.reaches_goal(some, rules(spark), 3, 2).collect()} == {q: w for q, w in want.items() if q % 3 == 0}


def test_demand_is_narrow(spark):
    goal = frame(spark, [(0, frozenset({("a", ("k0", "k1"))}), ("g", ("k2",)), 3)]).select("goal")
    got = {(r["left"], r["rule_id"]): r["need"] for r in goals.demand(goal, rules(spark), 2).collect()}
    assert got == {(1, 6): {"x2": "k2"}, (2, 3): {"x2": "k2"}}  # rule 6 needs e and a: rule 3 alone gives both


def test_states_after_steps(spark):
    start = {q: s for q, s, *_ in cases()[:12]}
    facts = unify.facts_of(frame(spark, cases()[:12]).select("qid", "atoms"))
    flat = rules(spark).withColumn("src_layer", F.when(F.col("rule_id") < 3, 0).otherwise(1))
    got = {(r["qid"], frozenset((a["predicate"], tuple(a["args"])) for a in r["atoms"])) for r in chain.exact_steps(facts, flat.where("rule_id < 3"), 1, 2).collect()}
    first = lambda s: {x for x in after(s) if x in {frozenset((p, tuple(b.get(t, t) for t in a)) for p, a in rhs) for lhs, rhs in RULES[:3] for b, _ in search(sorted(lhs), sorted((p, list(a)) for p, a in s))}}
    assert got == {(q, x) for q, s in start.items() for x in first(s)}
    assert chain.exact_steps(facts, flat, 0, 2).count() == 12


def test_nothing_asked(spark):
    none = frame(spark, cases()).limit(0)
    assert goals.reaches_goal(none, rules(spark), 2, 2).count() == 0
