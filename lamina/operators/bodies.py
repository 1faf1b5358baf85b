"""How rule bodies are matched: plans of semi-joins and of variable-by-variable joins, and their execution as DataFrames.

A body's atoms are chosen in order. Before a prefix of them is kept, it is held against the atoms that are still to come,
so that what is kept leads to a solution. Atoms that hang together without a cycle need semi-joins alone:
one whose shared variables another has, or the prefix, is folded into that one. What is left has cycles; there
each variable is bound in turn, by whichever atom has the fewest values for it, and checked by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

FEW = 1000  # values of a variable that are held as one set
ROOT = -1
STEP = "struct<e:int,w:int,shared:array<string>>"
ATOM = "struct<pos:int,bound:array<string>>"
STAGE = f"struct<steps:array<{STEP}>,join:array<string>,full:array<string>,root:array<string>,bare:boolean,core:array<struct<z:string,atoms:array<{ATOM}>>>>"
PLAN = f"k int, twins boolean, stages array<{STAGE}>"


def plan(lhs: list) -> tuple:
    """k, twins (two atoms could be the same fact) and a stage for each proper prefix of the body.

    A stage has the folds (``e`` into ``w`` or the prefix by ``shared`` variables), the variables by which the next atom joins (``full``: once the first
    stage's core is bound too),
    and, if folding gets stuck, the core: ``root``, the prefix's variables in it (``bare``: all that it has), and the order in which others are bound.
    """
    own = [list(dict.fromkeys(t for t in a["args"] if t.startswith("x"))) for a in lhs]
    kinds = [(a["predicate"], len(a["args"])) for a in lhs]
    stages = []
    for i in range(len(lhs) - 1):
        known = {v for vs in own[: i + 1] for v in vs}
        edges = {j: set(own[j]) for j in range(i + 1, len(lhs))}
        steps = []
        while edges:
            for e in sorted(edges):
                rest = known.union(*(vs for j, vs in edges.items() if j != e))
                shared = edges[e] & rest
                into = ROOT if shared <= known else next((w for w in sorted(edges) if w != e and shared <= edges[w]), None)
                if into is not None:
                    steps.append({"e": e, "w": into, "shared": sorted(shared)})
                    del edges[e]
                    break
            else:
                break
        inside = set().union(*edges.values()) if edges else set()
        root, core = sorted(known & inside), []
        bound, todo = set(root), inside - known
        while todo:  # next the variable that most atoms with a bound one share
            z = min(todo, key=lambda v: (-sum(v in vs and bool(vs & bound) for vs in edges.values()), -sum(v in vs for vs in edges.values()), v))
            core.append({"z": z, "atoms": [{"pos": j, "bound": sorted(vs & bound)} for j, vs in sorted(edges.items()) if z in vs]})
            bound.add(z)
            todo.remove(z)
        stages.append({"steps": steps, "join": sorted(known & set(own[i + 1])), "full": [], "root": root, "bare": set(root) == known, "core": core})
    early = {c["z"] for c in stages[0]["core"]} if stages else set()
    for i, st in enumerate(stages):
        st["full"] = sorted(set(own[i + 1]) & early.union(*own[: i + 1]))
    return len(lhs), len(set(kinds)) < len(kinds), stages


def values(binding: Column, names: Column) -> Column:
    return F.transform(names, lambda v: F.element_at(binding, v))


def _has_core() -> Column:
    return F.coalesce(F.size("_st.core") > 0, F.lit(False))  # bodies of one atom have no stage


def _names(stage: Column) -> Column:
    """The variables whose values a core has, in order."""
    return F.concat(stage["root"], F.transform(stage["core"], lambda c: c["z"]))


class Bodies:
    """The relations of all atoms of all rules, ``rel[pos]`` with ``keys``, fact_idx and binding b, and the rules' plans.

    ``plans`` has rule_id and the columns ``PLAN``; ``used`` tells which folds and core atoms occur at all, so that
    no join is made for others. Relations that are read more than twice are written tables, as are the ``facts`` that several atoms read.
    """

    def __init__(self, rel: list[DataFrame], plans: DataFrame, keys: list[str], used: dict, facts: DataFrame):
        self.rel, self.plans, self.keys, self.used, self.facts = rel, plans, keys, used, facts

    def _with_stage(self, rows: DataFrame, i: int) -> DataFrame:
        return rows.join(self.plans.select("rule_id", F.get("stages", F.lit(i)).alias("_st")), "rule_id")

    def _held(self, rows: DataFrame, need: Column, key: Column, among: DataFrame) -> DataFrame:
        """Rows where ``need`` does not hold, or whose key is among ``keys``, _key. A left join, so rows are read once."""
        found = among.withColumn("_in", F.lit(True))
        out = rows.withColumn("_need", need).withColumn("_key", F.when(F.col("_need"), key)).drop("_st").join(found, [*self.keys, "_key"], "left")  # plans are not shuffled
        return out.where(~F.col("_need") | F.col("_in")).drop("_need", "_key", "_in")

    def open_prefixes(self, state: DataFrame, i: int) -> DataFrame:
        """Prefixes of atoms 0 to i that all later atoms can complete, each by itself or, within a cycle, together."""
        rel = list(self.rel)
        for t in range(self.used["steps"].get(i, 0)):
            step = F.get("_st.steps", F.lit(t))
            for e, w in sorted(p for s, u, *p in self.used["folds"] if (s, u) == (i, t)):
                mine = (step["e"] == e) & (step["w"] == w)
                mine = F.coalesce(mine, F.lit(False))
                source = self._with_stage(rel[e], i).where(mine).select(*self.keys, values(F.col("b"), step["shared"]).alias("_key")).distinct()
                if w == ROOT:
                    state = self._held(self._with_stage(state, i), mine, values(F.col("binding"), step["shared"]), source)
                else:
                    rel[w] = self._held(self._with_stage(rel[w], i), mine, values(F.col("b"), step["shared"]), source)
        if self.used["core"].get(i):
            full = self._core(self._with_stage(state, i), rel, i)
            ok = full.select(*self.keys, F.slice("_vals", F.lit(1), F.col("_n")).alias("_key")).distinct()
            state = self._held(self._with_stage(state, i), _has_core(), values(F.col("binding"), F.col("_st.root")), ok)
        return state

    def closed_cycles(self, state: DataFrame, i: int, used: bool = True) -> DataFrame:
        """Prefixes with every binding of their core's variables, for rules that have one; others as they are.

        Where ``used`` is not asked for and every prefix's variables are all in its core, the core's values are the bindings.
        """
        if not self.used["core"].get(i):
            return state
        full = self._core(self._with_stage(state, i), self.rel, i)
        if not used and i == 0 and self.used["bare"]:
            out = self._with_stage(full, i).join(self.plans.select("rule_id", "k", "twins"), "rule_id")
            return out.select(*self.keys, "k", "twins", F.map_from_arrays(_names(F.col("_st")), "_vals").alias("binding"), F.array().cast(state.schema["used"].dataType).alias("used"))
        full = full.withColumn("_key", F.slice("_vals", F.lit(1), F.col("_n"))).withColumn("_more", F.slice("_vals", F.col("_n") + 1, F.size("_vals"))).drop("_vals", "_n")
        state = self._with_stage(state, i).withColumn("_need", _has_core()).withColumn("_key", F.when(F.col("_need"), values(F.col("binding"), F.col("_st.root")))).drop("_st")
        out = self._with_stage(state.join(full, [*self.keys, "_key"], "left").where(~F.col("_need") | F.col("_more").isNotNull()), i)
        zs = F.transform("_st.core", lambda c: c["z"])
        more = F.when(F.col("_need"), F.map_concat("binding", F.map_from_arrays(zs, "_more"))).otherwise(F.col("binding"))
        return out.withColumn("binding", more).drop("_st", "_key", "_more", "_need")

    def _core(self, state: DataFrame, rel: list[DataFrame], i: int) -> DataFrame:
        """``keys``, _vals, _n: values of the core's variables, the prefix's ``_n`` first, that all its atoms have together."""
        have = state.where(F.size("_st.core") > 0).select(*self.keys, values(F.col("binding"), F.col("_st.root")).alias("_vals")).distinct()
        have = cut(have.withColumn("_n", F.size("_vals")))
        for s, atoms in enumerate(self.used["core"][i]):
            env = F.map_from_arrays(F.slice(_names(F.col("_st")), F.lit(1), F.size("_vals")), F.col("_vals"))
            at = {pos: F.filter(F.get("_st.core", F.lit(s))["atoms"], lambda a: a["pos"] == pos) for pos in atoms}  # noqa: B023
            now = self._with_stage(have, i).withColumn("_env", env)
            now = now.select(*have.columns, *[F.when(F.size(at[p]) > 0, values(F.col("_env"), F.get(at[p], F.lit(0))["bound"])).alias(f"_k{p}") for p in atoms])
            pairs, least = {}, []
            for pos in atoms:
                atom = at[pos]
                bound, z = F.get(atom, F.lit(0))["bound"], F.get("_st.core", F.lit(s))["z"]
                part = self._with_stage(rel[pos], i).where(F.size(atom) > 0)
                pairs[pos] = cut(part.select(*self.keys, values(F.col("b"), bound).alias("_key"), F.element_at("b", z).alias("_z")).distinct())
                counts = pairs[pos].groupBy(*self.keys, "_key").agg(F.count(F.lit(1)).alias(f"_n{pos}"))
                now = now.join(counts.withColumnRenamed("_key", f"_k{pos}"), [*self.keys, f"_k{pos}"], "left")
                now = now.where(F.col(f"_k{pos}").isNull() | F.col(f"_n{pos}").isNotNull())
                least.append(F.when(F.col(f"_k{pos}").isNotNull(), F.struct(F.col(f"_n{pos}").alias("n"), F.lit(pos).alias("pos"))))
            by = F.array_min(F.filter(F.array(*least), lambda x: x.isNotNull()))["pos"]
            now = cut(now.withColumn("_by", by).drop(*[f"_n{p}" for p in atoms]))
            kept = [F.col(c) for c in (*self.keys, "_vals", "_n")]
            done = now.where("_by is null").select(*kept)  # rules whose core is done
            for pos in atoms:  # the atom with the fewest values binds, the others check
                new = now.where(F.col("_by") == pos).join(pairs[pos].withColumnRenamed("_key", f"_k{pos}"), [*self.keys, f"_k{pos}"])
                for other in atoms:
                    if other != pos:
                        found = pairs[other].withColumnRenamed("_key", f"_k{other}").withColumn("_in", F.lit(True))
                        new = new.join(found, [*self.keys, f"_k{other}", "_z"], "left").where(F.col(f"_k{other}").isNull() | F.col("_in")).drop("_in")
                done = done.unionByName(new.select(*self.keys, F.concat("_vals", F.array("_z")).alias("_vals"), "_n"))
            have = cut(done)
        return have


def used_by(stages: list) -> dict:
    """From rules' stages: the most folds of a prefix, the folds (stage, place, e, w) and, by stage, the core's atoms by place.

    ``bare`` tells whether all rules have a first core with all variables of their first atom, ``closed`` which atoms'
    variables a first core binds and checks in every rule that has the atom.
    """
    steps: dict = {}
    folds, core = set(), {}
    for rule in stages:
        for i, st in enumerate(rule):
            steps[i] = max(steps.get(i, 0), len(st["steps"]))
            folds |= {(i, t, s["e"], s["w"]) for t, s in enumerate(st["steps"])}
            for s, c in enumerate(st["core"]):
                places = core.setdefault(i, [])
                places += [set()] * (s + 1 - len(places))
                places[s] = places[s] | {a["pos"] for a in c["atoms"]}
    closed = [{a["pos"] for c in rule[0]["core"] for a in c["atoms"]} if rule else set() for rule in stages]
    own = {p for p in range(1, 1 + max(map(len, stages), default=0)) if all(p in c for rule, c in zip(stages, closed) if len(rule) >= p)}
    bare = bool(stages) and all(rule and rule[0]["core"] and rule[0]["bare"] for rule in stages)
    return {"steps": steps, "folds": folds, "bare": bare, "closed": own, "core": {i: [sorted(p) for p in places] for i, places in core.items()}}


def closes(lhs: list) -> bool:
    """Whether a body is its first atom and a cycle that has all its variables and all other atoms."""
    k, _, stages = plan(lhs)
    used = used_by([stages])
    return used["bare"] and used["closed"] == set(range(1, k))


def _atom_rows(facts: DataFrame, atom) -> DataFrame:
    """qid and a column for each variable of the atom, for the facts that agree with it."""
    rows, first = facts.where((F.col("predicate") == atom["predicate"]) & (F.size("args") == len(atom["args"]))), {}
    for i, t in enumerate(atom["args"]):
        value = F.get("args", F.lit(i))
        if t in first:
            rows = rows.where(value == first[t])
        elif t.startswith("x"):
            first[t] = value
        else:
            rows = rows.where(value == t)
    return rows.select("qid", *[c.alias(t) for t, c in first.items()])


def _by_least(rows: DataFrame, pairs: list, z: str) -> DataFrame:
    """Rows with each value of z that all pairs (rows, their bound columns) have: those with the fewest bind it, the others check."""
    own = rows.columns
    for i, (p, on) in enumerate(pairs):
        rows = rows.join(p.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_n{i}")), on)
    rows, out = cut(rows.select(*own, F.array_min(F.array(*[F.struct(F.col(f"_n{i}").alias("n"), F.lit(i).alias("i")) for i in range(len(pairs))]))["i"].alias("_by"))), None
    for i, (p, on) in enumerate(pairs):
        new = rows.where(F.col("_by") == i).join(p, on)
        for j, (other, by) in enumerate(pairs):
            new = new if j == i else new.join(other, [*by, z], "left_semi")
        out = new.select(*own, z) if out is None else out.unionByName(new.select(*own, z))
    return out


def closed(facts: DataFrame, lhs: list) -> DataFrame:
    """qid and a column for each variable: all solutions, each once, of a body that ``closes`` in facts (qid, predicate, args).

    Each variable's values are met as sets, one for the values bound of each atom; rows that meet a set of more than ``FEW`` values
    are joined row by row. Null values are never met.
    """
    rows = _atom_rows(facts, lhs[0]).distinct()
    for c in plan(lhs)[2][0]["core"]:
        own, z, pairs, common = rows.columns, c["z"], [], None
        for i, a in enumerate(reversed(c["atoms"])):
            on = ["qid", *a["bound"]]
            p = _atom_rows(facts, lhs[a["pos"]]).select(*on, z).where(F.col(z).isNotNull())
            n = F.dense_rank().over(Window.partitionBy(*on).orderBy(z))
            sets = p.withColumn("_n", n).where(F.col("_n") <= FEW + 1).groupBy(*on).agg(F.collect_set(z).alias(f"_s{i}"))
            rows = rows.join(sets, on)
            pairs.append((p.distinct(), on))
            common = F.col(f"_s{i}") if common is None else F.array_intersect(common, f"_s{i}")
        many = F.greatest(*[F.size(f"_s{i}") for i in range(len(pairs))], F.lit(0)) > FEW
        met = cut(rows.select(*own, F.when(~many, common).alias("_z")).where("_z is null or size(_z) > 0"))
        rows, open_ = met.where("_z is not null").select(*own, F.explode("_z").alias(z)), met.where("_z is null").select(*own)
        if not open_.isEmpty():
            rows = rows.unionByName(_by_least(open_, pairs, z))
    return rows
