"""Atoms, clauses and sequents as columns: parsing, rendering, substitution, layers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
ATOM_TYPE = "struct<predicate:string,args:array<string>>"
RULE_TYPE = f"struct<lhs:array<{ATOM_TYPE}>,rhs:array<{ATOM_TYPE}>>"
_ATOM = rf"^\s*({NAME})\s*(?:\(\s*((?:{NAME}\s*,\s*)*(?:{NAME})?)\s*\))?\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def is_variable(term: Column) -> Column:
    return term.startswith("x")


def parse_atom(text: Column) -> Column:
    """``name`` or ``name(a,b)`` to an atom, null if malformed; a trailing comma in the list is allowed."""
    # not F.trim itself: transform would hand it the place as the characters to trim
    args = lambda t: F.filter(F.transform(F.split(F.regexp_extract(t, _ATOM, 2), ","), lambda a: F.trim(a)), lambda a: a != "")
    return let(text, lambda t: F.when(t.rlike(_ATOM), F.struct(F.regexp_extract(t, _ATOM, 1).alias("predicate"), args(t).alias("args"))))


def _atoms(text: Column, by: str) -> Column:
    parts = F.transform(F.split(text, by), lambda t: parse_atom(t))
    return let(parts, lambda p: F.when(F.forall(p, lambda a: a.isNotNull()), F.array_sort(p)))


def parse_conjunction(text: Column) -> Column:
    """Atoms joined by ∧, in canonical order (predicate, then arguments); null if one is malformed."""
    return _atoms(text, "∧")


def _pair(left: Column, right: Column, a: str, b: str, ok: Column) -> Column:
    both = F.struct(F.when(ok, left).alias(a), F.when(ok, right).alias(b))
    return let(both, lambda p: F.when(p[a].isNotNull() & p[b].isNotNull(), p))


def parse_clause(text: Column) -> Column:
    """``a ∧ b → c ∧ d``, with exactly one arrow, to a struct of sorted sides."""
    return let(F.split(text, "→"), lambda s: _pair(parse_conjunction(s[0]), parse_conjunction(F.element_at(s, -1)), "lhs", "rhs", F.size(s) == 2))


def parse_sequent(text: Column) -> Column:
    """``a,b⊢c`` to a struct of sorted antecedents and a consequent; commas within arguments don't split."""
    return let(F.split(text, "⊢"), lambda s: _pair(_atoms(s[0], r",(?![^(]*\))"), parse_atom(F.element_at(s, -1)), "ants", "cons", F.size(s) == 2))


def atom_text(atom: Column) -> Column:
    return F.concat(atom["predicate"], F.when(F.size(atom["args"]) > 0, F.concat(F.lit("("), F.array_join(atom["args"], ","), F.lit(")"))).otherwise(""))


def conjunction_text(atoms: Column) -> Column:
    return F.array_join(F.transform(atoms, atom_text), " ∧ ")


def clause_text(lhs: Column, rhs: Column) -> Column:
    return F.concat(conjunction_text(lhs), F.lit(" → "), conjunction_text(rhs))


def substitute(atoms: Column, binding: Column) -> Column:
    """Variables that are bound are replaced, others stay; atoms are sorted again."""
    return F.array_sort(F.transform(atoms, lambda a: F.struct(a["predicate"].alias("predicate"), F.transform(a["args"], lambda t: F.coalesce(F.try_element_at(binding, t), t)).alias("args"))))


def variables(atoms: Column) -> Column:
    return F.array_distinct(F.filter(F.flatten(F.transform(atoms, lambda a: a["args"])), is_variable))


def predicates(atoms: Column) -> Column:
    return F.array_distinct(F.transform(atoms, lambda a: a["predicate"]))


def merged(a: Column, b: Column) -> Column:
    """Both maps; where they share a key, the second's value."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def predicate_layer(name: Column) -> Column:
    """``r<layer>_<n>`` has its layer, ``r_<letters and figures>`` layer 0, anything else null."""
    layered = F.regexp_extract(name, r"^r(\d+)_\d+$", 1)
    return F.when(layered != "", layered.cast("int")).when(name.rlike("^r_[a-z0-9]+$"), F.lit(0))


def source_layer(ants: Column) -> Column:
    return F.array_min(F.transform(ants, lambda a: predicate_layer(a["predicate"])))


def parse_rule(text: str) -> tuple[list, list]:
    """The same grammar on the driver, for literal banks; a malformed text is an error."""
    sides = text.split("→")
    if len(sides) != 2:
        raise ValueError(f"one arrow is needed: {text!r}")
    out = []
    for side in sides:
        atoms = []
        for part in side.split("∧"):
            m = re.match(_ATOM, part)
            if not m:
                raise ValueError(f"not an atom: {part!r}")
            atoms.append((m[1], [a.strip() for a in (m[2] or "").split(",") if a.strip()]))
        out.append(sorted(atoms))
    return out[0], out[1]
