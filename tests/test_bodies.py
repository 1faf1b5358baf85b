"""Bounded matching against a depth-first search: acyclic and cyclic bodies, caps, single-use facts, given values."""

import random
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.atoms import RULE_TYPE
from lamina.operators import bodies, unify


def search(lhs, facts, binding=None, used=()):
    """Solutions in the order of fact positions."""
    binding = binding or {}
    if not lhs:
        yield binding, list(used)
        return
    (p, args), rest = lhs[0], lhs[1:]
    for i, (q, own) in enumerate(facts):
        if p != q or len(args) != len(own):
            continue
        b = dict(binding)
        if all((b.setdefault(t, c) if t.startswith("x") else t) == c for t, c in zip(args, own)):
            yield from search(rest, facts, b, (*used, i))


RULES = [
    [("a", ["x1", "x2"]), ("b", ["x2", "x3"]), ("c", ["x3", "x1"])],
    [("a", ["x1", "x2"]), ("a", ["x2", "x3"]), ("a", ["x3", "x1"])],
    [("a", ["x1", "x2"]), ("b", ["x3", "x4"]), ("c", ["x2", "x3"])],
    [("d", ["x1", "x2", "x3"]), ("a", ["x1", "x4"]), ("b", ["x2", "x4"]), ("c", ["x3", "x4"])],
    [("a", ["x1", "x2"]), ("b", ["x2", "x3"]), ("a", ["x3", "x4"]), ("c", ["x4", "x1"])],
    [("e", ["x9"]), ("a", ["x1", "x2"]), ("b", ["x2", "x3"]), ("c", ["x3", "x1"])],
    [("a", ["x1", "x1"]), ("b", ["x1", "k0"])],
    [("a", ["x1", "x2"]), ("a", ["x1", "x2"])],
    [("e", ["x1"])],
    [("e", ["k1"]), ("a", ["x1", "x2"])],
    [("z", ["x1"]), ("a", ["x1", "x2"])],
    [("a", ["x1", "x2"]), ("a", ["x3", "x4"]), ("e", ["x5"])],
]


def bank(spark, rules, rhs=()):
    rows = [(i, 0, (lhs, list(rhs))) for i, lhs in enumerate(rules)]
    return spark.createDataFrame(rows, f"rule_id int, src_layer int, r {RULE_TYPE}").select("rule_id", "src_layer", "r.lhs", "r.rhs")


def cases(seed, queries, n):
    r = random.Random(seed)
    out = {}
    for q in range(queries):
        have = set()
        for _ in range(r.randrange(n)):
            p = r.choice("aaabbccde")
            have.add((p, tuple(f"k{r.randrange(4)}" for _ in range({"d": 3, "e": 1}.get(p, 2)))))
        out[q] = [(p, list(a)) for p, a in sorted(have)]
    return out


def frame(spark, facts):
    return spark.createDataFrame([(q, i, p, a) for q, fs in facts.items() for i, (p, a) in enumerate(fs)], "qid int, fact_idx int, predicate string, args array<string>")


def found(df):
    return sorted((r["qid"], r["rule_id"], tuple(sorted(r["binding"].items())), tuple(r["used"])) for r in df.collect())


@pytest.mark.parametrize(("cap", "once"), [(None, False), (3, False), (2, True)])
def test_like_a_search(spark, cap, once):
    facts = cases(7, 8, 26)
    want = []
    for q, fs in facts.items():
        for i, lhs in enumerate(RULES):
            got = search(lhs, fs)
            if once:
                got = (s for s in got if len(set(s[1])) == len(s[1]))
            want += [(q, i, tuple(sorted(b.items())), tuple(u)) for b, u in islice(got, cap)]
    assert found(unify.substitutions(frame(spark, facts), bank(spark, RULES), 4, cap, once)) == sorted(want)


def test_applies_like_a_search(spark):
    facts = cases(8, 12, 20)
    want = {(q, i) for q, fs in facts.items() for i, lhs in enumerate(RULES) if next(search(lhs, fs), None)}
    assert {tuple(r) for r in unify.applicable(frame(spark, facts), bank(spark, RULES), 4).collect()} == want
    unbound = bank(spark, RULES[:3], [("y", ["x1", "x8"])])
    assert unify.applicable(frame(spark, facts), unbound, 4).count() == 0


def test_given_values(spark):
    facts = cases(9, 6, 24)
    rows = [(q, i, g, {"x1": f"k{g}"} if g < 3 else {}) for q in facts for i in (0, 2, 3, 5) for g in (0, 2, 3) if (q + i + g) % 2]
    given = spark.createDataFrame(rows, "qid int, rule_id int, gid int, need map<string,string>")
    got = unify.substitutions(frame(spark, facts), bank(spark, RULES), 4, None, given=given)
    want = [(q, i, g, tuple(u)) for q, i, g, need in rows for b, u in search(RULES[i], facts[q]) if all(b.get(v, c) == c for v, c in need.items())]
    assert sorted((r["qid"], r["rule_id"], r["gid"], tuple(r["used"])) for r in got.collect()) == sorted(want)


def test_short_bodies_and_nothing(spark):
    facts = frame(spark, cases(3, 4, 20))
    own = bank(spark, RULES)
    assert {r["rule_id"] for r in unify.substitutions(facts, own, 1, None).collect()} <= {8}
    assert unify.substitutions(facts.limit(0), own, 4).count() == 0
    assert unify.substitutions(facts, own.limit(0), 4).count() == 0
    assert unify.substitutions(facts, bank(spark, [[]]), 2).count() == 0


def test_planned_by_tasks(spark, monkeypatch):
    facts, own = frame(spark, cases(5, 5, 22)), [RULES[i] for i in (0, 2, 6, 8, 9)]
    want = found(unify.substitutions(facts, bank(spark, own), 3, 5))
    monkeypatch.setattr(unify, "MOST_RULES", 3)
    assert found(unify.substitutions(facts, bank(spark, own), 3, 5)) == want


def rows_made(spark, df):
    """The most rows that any operator of an executed plan put out."""
    df.collect()
    top, plan, todo = 0, df._jdf.queryExecution().executedPlan(), []
    todo.append(plan)
    while todo:
        p = todo.pop()
        p = p.executedPlan() if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else p.plan() if p.getClass().getSimpleName().endswith("QueryStageExec") else p
        m = p.metrics().get("numOutputRows")
        if m.isDefined():
            top = max(top, m.get().value())
        for i in range(p.children().size()):
            todo.append(p.children().apply(i))
    return top


def test_capped_work_is_bounded(spark):
    """200 equal-predicate facts: 40,000 pairs and 8,000,000 triples, of which 5 are asked for."""
    n, cap = 200, 5
    facts = frame(spark, {0: [("a", [f"k{i:03}", "k"]) for i in range(n)]})
    rule = [[("a", ["x1", "x2"]), ("a", ["x3", "x4"]), ("a", ["x5", "x6"])]]
    got = unify.substitutions(facts, bank(spark, rule), 3, cap)
    assert sorted(r["used"] for r in got.collect()) == [[0, 0, i] for i in range(cap)]
    assert n <= rows_made(spark, got) <= cap * n


def test_plans():
    row = lambda lhs: [{"predicate": p, "args": a} for p, a in lhs]
    k, twins, stages = bodies.plan(row(RULES[0]))
    assert k == 3 and not twins and stages[0]["steps"] == [] and [c["z"] for c in stages[0]["core"]] == ["x3"] and stages[0]["root"] == ["x1", "x2"]
    assert stages[1]["steps"] == [{"e": 2, "w": -1, "shared": ["x1", "x3"]}] and stages[1]["core"] == []
    assert bodies.plan(row(RULES[2]))[2][0]["steps"] == [{"e": 1, "w": 2, "shared": ["x3"]}, {"e": 2, "w": -1, "shared": ["x2"]}]
    assert bodies.plan(row(RULES[7]))[1]


def test_cycles_meet_the_fewer(spark):
    """A hub with many out-edges: triangles through it are few, and no join makes all its wedges."""
    n = 150
    facts = [("a", ["h", f"m{i:03}"]) for i in range(n)] + [("b", [f"m{i:03}", "t"]) for i in range(n)] + [("c", ["t", "h"])] + [("c", [f"o{i:03}", "h"]) for i in range(n)]
    got = unify.substitutions(frame(spark, {0: sorted(facts)}), bank(spark, RULES[:1]), 3, None)
    assert got.count() == n


@pytest.mark.parametrize("own", [RULES[:1], [RULES[0], RULES[3]], [RULES[0], RULES[4], RULES[5], RULES[8]], RULES])
def test_bindings_alone(spark, own):
    """Without the facts used, the same bindings as often; a triangle's atoms are not joined again after its cycle."""
    facts = cases(11, 8, 30)
    b = lambda df: sorted((r["qid"], r["rule_id"], tuple(sorted(r["binding"].items()))) for r in df.collect())
    bare = unify.substitutions(frame(spark, facts), bank(spark, own), 4, None, used=False)
    assert sorted(bare.columns) == ["binding", "qid", "rule_id"]
    assert b(bare) == sorted((q, i, tuple(sorted(s.items()))) for q, fs in facts.items() for i, lhs in enumerate(own) for s, _ in search(lhs, fs))
    if own == RULES[:1]:
        assert "SortMergeJoin" not in (plan := bare._jdf.queryExecution().executedPlan().toString()) and "_st" not in plan.split("Exchange")[0]


def test_capped_parts_follow_the_facts(spark, monkeypatch):
    """Ten times the facts are dealt into ten times the parts, so that no task sorts more; results are those of one part."""
    rule = bank(spark, [[("a", ["x1", "x2"]), ("a", ["x3", "x4"])]])
    for n in (10, 100):
        facts = frame(spark, {q: [("a", [f"k{i}", "k"]) for i in range(4)] for q in range(n)})
        want = found(unify.substitutions(facts, rule, 2, 5))
        with monkeypatch.context() as m:
            m.setattr(unify, "FACTS_A_PART", 10)
            got = unify.substitutions(facts, rule, 2, 5)
            assert found(got) == want and len(want) == 5 * n
            assert got.rdd.getNumPartitions() >= 4 * n // 10


def _lines(spark, lines):
    """A fact for each two of a line's three values, twice, for one query."""
    rows = [(0, p, list(a)) for x, y, z in lines for p, a in (("a", (x, y)), ("b", (y, z)), ("c", (z, x)))]
    return spark.createDataFrame(rows + rows, "qid int, predicate string, args array<string>")


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_cycles_by_sets(spark, monkeypatch, few):
    """Triangles where all sets are too large to be held, some or none; repeated facts count once, null values and queries are not met."""
    monkeypatch.setattr(bodies, "FEW", few)
    r = np.random.default_rng(5)
    lines = {tuple(f"{k}{v}" for k, v in zip("uvw", t)) for t in r.integers(0, 7, (60, 3))}
    facts = _lines(spark, lines).unionByName(spark.createDataFrame([(0, "a", ["u0", None]), (0, "a", ["u0"]), (None, "a", ["u0", "v0"])], "qid int, predicate string, args array<string>"))
    got = unify.substitutions(facts, bank(spark, [[("a", ["x1", "x2"]), ("b", ["x2", "x3"]), ("c", ["x3", "x1"])]]), 3, cap=None, used=False).collect()
    ab, bc, ca = ({(t[i], t[(i + 1) % 3]) for t in lines} for i in range(3))
    want = {(x, y, z) for x, y in ab for v, z in bc if v == y and (z, x) in ca}
    assert sorted((b["x1"], b["x2"], b["x3"]) for b in (row["binding"] for row in got)) == sorted(want) and {(row["qid"], row["rule_id"]) for row in got} == {(0, 0)}


def test_cycles_hand_on_few_rows(spark):
    """No table of facts, of an atom's pairs or of counts is written on the way to a cycle."""
    n = 3000
    facts = _lines(spark, [(f"u{i}", f"v{i % 500}", f"w{i % 70}") for i in range(n)]).distinct()
    rule = bank(spark, [[("a", ["x1", "x2"]), ("b", ["x2", "x3"]), ("c", ["x3", "x1"])]])
    store, array = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    written = lambda: sum(s.outputRecords() for s in (all_.apply(i) for all_ in [store.stageList(None, False, False, array, None)] for i in range(all_.size())))
    before = written()
    m = unify.substitutions(facts.withColumn("fact_idx", F.xxhash64("predicate", "args")), rule, 3, cap=None, used=False)
    m.write.format("noop").mode("overwrite").save()
    made = written() - before
    assert m.count() >= n and made <= 3 * n
