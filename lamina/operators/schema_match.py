"""Matching ground rules against rule templates up to a renaming of predicates, by canonical keys.

A template matches a rule if some one-to-one renaming of predicates and some values of its variables make it the rule.
Several variables may have one value, so a template stands for all rules whose equal terms are at least those it asks
for. Its patterns are its variables' groupings into equal ones; each is a structure, and so is the rule, and a
structure has one key whatever its names and the order of its atoms. Matching is then an equi-join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.atoms import RULE_TYPE
from ..session import spread
from .unify import bounded

#: Templates with more variables than these have too many groupings to list (21147 for 9).
MOST_VARIABLES = 9


def _refined(colours: dict, edges: dict) -> dict:
    """Colours told apart by those of neighbours, until no more are; a node keeps its colour's place among the others'."""
    while True:
        seen = {v: (c, tuple(sorted((label, colours[u]) for label, u in edges[v]))) for v, c in colours.items()}
        order = {s: i for i, s in enumerate(sorted(set(seen.values())))}
        new = {v: order[s] for v, s in seen.items()}
        if len(order) == len(set(colours.values())):
            return new
        colours = new


def _parts(nodes: set, edges: dict) -> Iterator[set]:
    todo = set(nodes)
    while todo:
        part, open_ = set(), [todo.pop()]
        while open_:
            v = open_.pop()
            part.add(v)
            for _, u in edges[v]:
                if u in todo:
                    todo.remove(u)
                    open_.append(u)
        yield part


def _form(nodes: set, colours: dict, edges: dict) -> tuple:
    """What is the same for two coloured graphs just if one is the other renamed.

    Nodes alone in their colour are named by it; what hangs together without them is described by itself, so equal
    parts beside one another cost no more than one. Within a part whose colours repeat, each node of the first
    repeated colour is singled out in turn, and the least description counts.
    """
    colours = _refined(colours, edges)
    cells = defaultdict(list)
    for v in nodes:
        cells[colours[v]].append(v)
    single = {v for vs in cells.values() if len(vs) == 1 for v in vs}
    fixed = tuple(sorted((colours[v], tuple(sorted((label, colours[u]) for label, u in edges[v]))) for v in single))
    rest = []
    for part in _parts(nodes - single, {v: [(x, u) for x, u in edges[v] if u not in single] for v in nodes}):
        own = tuple(sorted(colours[v] for v in part))
        repeated = min((c for c in set(own) if own.count(c) > 1), default=None)
        if repeated is None:
            rest.append((own, tuple(sorted((colours[v], tuple(sorted((x, colours[u]) for x, u in edges[v]))) for v in part))))
            continue
        top = max(colours.values()) + 1
        rest.append((own, min(_form(part, colours | {v: top}, edges) for v in part if colours[v] == repeated)))
    return fixed, tuple(sorted(rest, key=repr))


def canonical(lhs: list, rhs: list, named: frozenset = frozenset(), group: dict | None = None) -> str:
    """A rule's structure: equal for rules that differ by one-to-one renamings of predicates and of terms that are not ``named``.

    ``group`` maps terms to what they count as.
    """
    group = group or {}
    edges, colours = defaultdict(list), {}
    for side, atoms in enumerate((lhs, rhs)):
        for i, a in enumerate(atoms):
            atom, name = ("atom", side, i), ("predicate", a["predicate"])
            colours[atom], colours[name] = (0, side, len(a["args"]), ""), (1, 0, 0, "")
            links = [(0, name)]
            for j, t in enumerate(a["args"]):
                t = group.get(t, t)
                term = ("term", t)
                colours[term] = (2, 0, 0, t if t in named else "")
                links.append((j + 1, term))
            for label, u in links:
                edges[atom].append((label, u))
                edges[u].append((label, atom))
    start = {c: i for i, c in enumerate(sorted(set(colours.values())))}
    kinds = sorted((c, sum(x == c for x in colours.values())) for c in start)
    return repr((kinds, _form(set(colours), {v: start[c] for v, c in colours.items()}, edges)))


def terms(lhs: list, rhs: list) -> list[str]:
    return list(dict.fromkeys(t for a in [*lhs, *rhs] for t in a["args"]))


def groupings(variables: list[str], constants: list[str]) -> Iterator[dict]:
    """All ways in which variables are equal to one another or to constants; each names a variable's group by its first member."""
    if not variables:
        yield {}
        return
    *rest, last = variables
    for g in groupings(rest, constants):
        for to in [*dict.fromkeys(g.values()), *(c for c in constants if c not in g.values()), last]:
            yield g | {last: to}


def pattern_keys(lhs: list, rhs: list) -> list[tuple[str, list[str]]]:
    """Keys of a template's patterns, each with the constants that it names."""
    own = terms(lhs, rhs)
    variables, constants = [t for t in own if t.startswith("x")], [t for t in own if not t.startswith("x")]
    if len(variables) > MOST_VARIABLES:
        raise ValueError(f"a template has more than {MOST_VARIABLES} variables")
    named = frozenset(constants)
    return sorted({(canonical(lhs, rhs, named, g), tuple(sorted(named))) for g in groupings(variables, constants)})


def keyed_templates(bank: DataFrame) -> DataFrame:
    """The bank's rows with ``_named`` and ``_key``, a row for each pattern; worked out rule by rule."""
    each = F.udf(lambda lhs, rhs: [(k, list(n)) for k, n in pattern_keys(lhs, rhs)], "array<struct<_key:string,_named:array<string>>>", useArrow=True)
    return bank.withColumn("_p", F.explode(each("lhs", "rhs"))).select(*bank.columns, "_p.*")


def rule_key(lhs: Column, rhs: Column, named: Column) -> Column:
    """The key of a ground rule's structure beside the constants that ``named`` lists."""
    return F.udf(lambda l, r, n: canonical(l, r, frozenset(n)), "string", useArrow=True)(lhs, rhs, named)  # noqa: E741


def signature(lhs, rhs):
    """Equal for a template and a rule that can match: sizes of both sides and their sorted arities."""
    arity = lambda s: F.array_join(F.array_sort(F.transform(s, lambda a: F.size(a["args"]))), ",")
    return F.concat_ws("|", arity(lhs), arity(rhs))


def alike_by(rules: DataFrame, templates: DataFrame, by: list[str], few=lambda d: d) -> DataFrame:
    """Distinct key of rules (key, g, _sig, ``by``) with the structure of a template (_key, _named, _sig, ``by``) of their own.

    A rule has a key for each set of constants that its templates name, most often the empty one alone, and only for
    sets that it holds whole.
    """
    sets = few(templates.select(*by, "_named", "_sig").distinct())
    held = F.array_distinct(F.flatten(F.transform(F.concat("g.lhs", "g.rhs"), lambda a: a["args"])))
    asked = rules.join(sets, [*by, "_sig"]).where(F.size(F.array_except("_named", held)) == 0)
    asked = asked.withColumn("_key", rule_key(F.col("g.lhs"), F.col("g.rhs"), F.col("_named")))
    return asked.join(few(templates.select(*by, "_key", "_named").distinct()), [*by, "_key", "_named"], "left_semi").select("key").distinct()


def schema_matches(rules: DataFrame, bank: DataFrame) -> DataFrame:
    """key, matched: whether any template of the bank has the rule's structure.

    Templates and rules get their keys row by row and meet by key. Rules may be many and repeat; null sides match
    nothing, and nothing matches an empty bank.
    """
    sig = signature(F.col("lhs"), F.col("rhs")).alias("_sig")
    templates = keyed_templates(bank.select("lhs", "rhs")).select("_key", "_named", sig).distinct()
    own = spread(rules).where("lhs is not null and rhs is not null").select("key", F.struct("lhs", "rhs").cast(RULE_TYPE).alias("g"), sig)
    found = alike_by(own, templates, [], bounded).withColumn("matched", F.lit(True))
    return rules.select("key").join(found, "key", "left").select("key", F.coalesce("matched", F.lit(False)).alias("matched"))
