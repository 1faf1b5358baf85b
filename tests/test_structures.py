"""Canonical keys of rules against trying every renaming, and instances against a search."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from lamina.functions.atoms import RULE_TYPE
from lamina.operators import evaluate, schema_match


def renamed(template, rule):
    """Whether a one-to-one renaming of predicates and values of variables make the template the rule."""

    def sides(a, b, names, values):
        if len(a) != len(b):
            return
        for order in permutations(b):
            n, t = dict(names), dict(values)
            if all(len(x["args"]) == len(y["args"]) and n.setdefault(x["predicate"], y["predicate"]) == y["predicate"] and all((t.setdefault(v, c) if v.startswith("x") else v) == c for v, c in zip(x["args"], y["args"])) for x, y in zip(a, order)) and len(set(n.values())) == len(n):
                yield n, t

    return any(True for n, t in sides(template[0], rule[0], {}, {}) for _ in sides(template[1], rule[1], n, t))


def instance(template, rule):
    def go(todo, left, binding):
        if not todo:
            return True
        (side, a), rest = todo[0], todo[1:]
        for i, (s, b) in enumerate(left):
            if s == side and a["predicate"] == b["predicate"] and len(a["args"]) == len(b["args"]):
                own = dict(binding)
                if all((own.setdefault(v, c) if v.startswith("x") else v) == c for v, c in zip(a["args"], b["args"])) and go(rest, left[:i] + left[i + 1 :], own):
                    return True
        return False

    tagged = lambda r: [(s, a) for s in (0, 1) for a in r[s]]
    return len(template[0]) == len(rule[0]) and len(template[1]) == len(rule[1]) and go(tagged(template), tagged(rule), {})


def random_rules(seed, n, terms, predicates="pqr", most=3):
    r, out = random.Random(seed), []
    for _ in range(n):
        side = lambda: [{"predicate": r.choice(predicates), "args": [r.choice(terms) for _ in range(r.randrange(3))]} for _ in range(r.randrange(1, most + 1))]
        out.append((side(), side()))
    return out


def ground_of(template, r):
    """The template with values and other predicates, atoms in another order."""
    values, names = {}, dict(zip("pqr", r.sample("uvwz", 3)))
    side = lambda s: r.sample([{"predicate": names[a["predicate"]], "args": [values.setdefault(t, r.choice("abcd")) if t.startswith("x") else t for t in a["args"]]} for a in s], len(s))
    return side(template[0]), side(template[1])


def test_keys_are_complete():
    r = random.Random(1)
    rules = random_rules(1, 60, ["a", "b", "c", "k"]) + [ground_of(t, r) for t in random_rules(2, 40, ["x1", "x2", "x3", "k"])]
    for t in random_rules(2, 40, ["x1", "x2", "x3", "k"]):
        keys = schema_match.pattern_keys(*t)
        for g in rules:
            named = frozenset(keys[0][1])
            assert (schema_match.canonical(*g, named) in {k for k, _ in keys}) == renamed(t, g)


def test_symmetric_rules_are_quick():
    many = [{"predicate": f"p{i}", "args": ["s", f"t{i}"]} for i in range(40)]
    other = [{"predicate": f"q{i * 7 % 40}", "args": ["u", f"w{i}"]} for i in range(40)]
    assert schema_match.canonical(many, many[:1]) == schema_match.canonical(other[::-1], other[3:4])
    assert schema_match.canonical(many, many[:1]) != schema_match.canonical(many, [{"predicate": "n", "args": ["s", "t0"]}])
    ring = lambda names: [{"predicate": "e", "args": [a, b]} for a, b in zip(names, names[1:] + names[:1])]
    assert schema_match.canonical(ring(list("abcdefgh")), many[:1]) == schema_match.canonical(ring(list("hacegbdf")), other[:1])
    assert schema_match.canonical(ring(list("abcdefgh")), many[:1]) != schema_match.canonical(ring(list("abcd")) + ring(list("efgh")), many[:1])


def frame(spark, rules, name):
    return spark.createDataFrame([(i, g) for i, g in enumerate(rules)], f"{name} int, r {RULE_TYPE}")


def test_schema_matches(spark):
    r = random.Random(3)
    templates = random_rules(4, 12, ["x1", "x2", "k"], most=2)
    rules = random_rules(5, 40, ["a", "b", "k"], most=2) + [ground_of(t, r) for t in templates] * 2
    got = schema_match.schema_matches(frame(spark, rules, "key").select("key", "r.lhs", "r.rhs").unionByName(spark.createDataFrame([(999, None)], f"key int, r {RULE_TYPE}").select("key", "r.lhs", "r.rhs")), frame(spark, templates, "rule_id").select("r.lhs", "r.rhs"))
    assert {x["key"]: x["matched"] for x in got.collect()} == {i: any(renamed(t, g) for t in templates) for i, g in enumerate(rules)} | {999: False}
    assert not schema_match.schema_matches(frame(spark, rules, "key").select("key", "r.lhs", "r.rhs"), frame(spark, templates, "rule_id").select("r.lhs", "r.rhs").limit(0)).where("matched").count()


def test_instances(spark):
    r = random.Random(6)
    templates = random_rules(7, 25, ["x1", "x2", "x3", "k"], "pq")
    values = lambda t: ([{"predicate": a["predicate"], "args": [v if not v.startswith("x") else {"x1": "a", "x2": r.choice("ab"), "x3": "b"}[v] for v in a["args"]]} for a in s] for s in t)
    rules = [tuple(values(t)) for t in templates] + random_rules(8, 40, ["a", "b", "k"], "pq")
    both = frame(spark, templates, "pos").withColumnRenamed("r", "t").crossJoin(frame(spark, rules, "key").withColumnRenamed("r", "g"))
    pairs = both.where(evaluate._names(F.col("t")) == evaluate._names(F.col("g"))).withColumn("prio", F.lit(0))
    got = {(x["key"], x["pos"]) for x in evaluate.instances(pairs).collect()}
    assert got == {(i, j) for i, g in enumerate(rules) for j, t in enumerate(templates) if instance(t, g)}
    assert evaluate.instances(pairs.limit(0)).count() == 0
