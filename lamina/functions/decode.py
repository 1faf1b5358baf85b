"""Rows of token ids back to statements, with the reason where a row is malformed.

Ids become symbols, symbols one string, and the grammar of ``atoms`` reads that string: within brackets symbols are
arguments and get commas between them, elsewhere they are letters of a predicate. All of it is one expression a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .atoms import ATOM_TYPE, atom_text, clause_text, conjunction_text, let, parse_atom, parse_clause, parse_conjunction, predicate_layer, source_layer
from .tokens import EOT, PAD, SEP, SPECIAL, START, segments

_MARK = "\x1f"  # between symbols
_RESERVED = [t for t, i in SPECIAL.items() if i in (PAD, SEP, START, EOT)]


def symbols(row: Column, names: Column) -> Column:
    """The symbol of each id, null for ids outside the vocabulary."""
    return F.transform(row, lambda t: F.try_element_at(names, t))


def spelled(syms: Column) -> Column:
    """Symbols as statement text: commas between the arguments of an atom, nothing between the letters of a predicate."""
    s = F.array_join(syms, _MARK)
    s = F.regexp_replace(s, f"{_MARK}(?=[^(]*\\))", ",")  # within brackets
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\(,+", "("), r",+\)", ")"), ",{2,}", ",")
    return F.regexp_replace(s, _MARK, "")


def _bad_symbol(syms: Column) -> Column:
    return F.when(F.exists(syms, lambda s: s.isNull()), "unknown id").when(F.exists(syms, lambda s: s.isin(*_RESERVED)), "special token inside")


def _parsed(text: Column) -> Column:
    """struct<ants, cons, sides> of a sequent's text; no antecedents and a comma behind the last are allowed."""
    none = F.array().cast(f"array<{ATOM_TYPE}>")
    parts = lambda t: let(F.transform(F.split(t, r",(?![^(]*\))"), lambda x: parse_atom(x)), lambda p: F.when(F.forall(p, lambda a: a.isNotNull()), F.array_sort(p)))
    left = lambda s: let(F.regexp_replace(s[0], ",$", ""), lambda t: F.when(t == "", none).otherwise(parts(t)))
    return let(F.split(text, "⊢"), lambda s: F.struct(left(s).alias("ants"), parse_atom(F.element_at(s, -1)).alias("cons"), F.size(s).alias("sides")))


def decode_prompt(row: Column, names: Column) -> Column:
    """struct<ants, cons, error>: the sequent behind the last <SEP> and before the one <START>; padding is left out.

    Antecedents are sorted and may be none. ``error`` is null where the row is well formed, else ants and cons are.
    """

    def finish(d: Column) -> Column:
        error = F.coalesce(d["error"], F.when(d["p"]["sides"] != 2, "exactly one ⊢ is needed").when(d["p"]["ants"].isNull() | d["p"]["cons"].isNull(), "malformed atom"))
        return let(error, lambda e: F.struct(F.when(e.isNull(), d["p"]["ants"]).alias("ants"), F.when(e.isNull(), d["p"]["cons"]).alias("cons"), e.alias("error")))

    def read(own: Column) -> Column:
        starts = F.size(F.filter(own, lambda t: t == START))
        body = F.slice(own, F.lit(1), F.greatest(F.array_position(own, F.lit(START)).cast("int") - 1, F.lit(0)))
        last = F.element_at(segments(body), -1)
        early = F.when(own.isNull() | (starts != 1), "exactly one <START> is needed")
        return let(symbols(last, names), lambda s: let(F.struct(F.coalesce(early, F.when(F.size(s) == 0, "empty prompt").otherwise(_bad_symbol(s))).alias("error"), _parsed(spelled(s)).alias("p")), finish))

    return let(F.filter(row, lambda t: t != PAD), read)


def prompt_info(row: Column, names: Column) -> Column:
    """struct<ants, cons, src_layer, goal_layer, error>: layers of the lowest antecedent and of the goal; no antecedent is an error."""

    def layers(p: Column) -> Column:
        own = F.struct(source_layer(p["ants"]).alias("src"), predicate_layer(p["cons"]["predicate"]).alias("goal"))
        error = lambda q: F.coalesce(p["error"], F.when(F.size(p["ants"]) == 0, "no antecedents").when(q["src"].isNull() | q["goal"].isNull(), "predicate without a layer"))
        return let(own, lambda q: F.struct(p["ants"].alias("ants"), p["cons"].alias("cons"), q["src"].alias("src_layer"), q["goal"].alias("goal_layer"), error(q).alias("error")))

    return let(decode_prompt(row, names), layers)


def sequent_text(ants: Column, cons: Column) -> Column:
    return F.concat(F.array_join(F.transform(ants, atom_text), ","), F.lit("⊢"), atom_text(cons))


def statement(syms: Column) -> Column:
    """The canonical text of one statement, a clause or else a conjunction; null if it is neither."""
    clause = lambda t: let(parse_clause(t), lambda c: F.when(c.isNotNull(), clause_text(c["lhs"], c["rhs"])))
    atoms = lambda t: let(parse_conjunction(t), lambda a: F.when(a.isNotNull(), conjunction_text(a)))
    return let(spelled(syms), lambda t: F.when(F.contains(t, F.lit("→")), clause(t)).otherwise(atoms(t)))


def decode_completion(row: Column, names: Column) -> Column:
    """struct<texts, error>: the statements between <SEP> tokens of a row that ends in <EOT>, each in canonical form."""

    def finish(d: Column) -> Column:
        error = F.coalesce(d["error"], F.when(F.exists(d["texts"], lambda t: t.isNull()), "malformed statement"))
        return let(error, lambda e: F.struct(F.when(e.isNull(), d["texts"]).alias("texts"), e.alias("error")))

    def read(r: Column) -> Column:
        body = F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))
        parts = segments(F.transform(body, lambda t: F.when(t == PAD, F.lit(EOT)).otherwise(t)))  # <PAD> inside is no padding, but an error
        early = F.when(r.isNull() | (F.size(r) < 2), "too short").when(F.element_at(r, -1) != EOT, "<EOT> must end it")
        error = lambda s: F.coalesce(early, F.when(F.exists(s, lambda p: F.size(p) == 0), "empty statement").otherwise(_bad_symbol(F.flatten(s))))
        return let(F.transform(parts, lambda p: symbols(p, names)), lambda s: let(F.struct(error(s).alias("error"), F.transform(s, lambda x: statement(x)).alias("texts")), finish))

    return let(row, read)


def clause_of(d: Column) -> Column:
    """struct<lhs, rhs, error> of a decoded completion (struct<texts, error>) with one statement, a clause."""
    error = lambda c: F.coalesce(d["error"], F.when(F.size(d["texts"]) != 1, "more than one statement").when(c.isNull(), "no clause"))
    return let(parse_clause(d["texts"][0]), lambda c: let(error(c), lambda e: F.struct(F.when(e.isNull(), c["lhs"]).alias("lhs"), F.when(e.isNull(), c["rhs"]).alias("rhs"), e.alias("error"))))


def decode_clause(row: Column, names: Column) -> Column:
    """struct<lhs, rhs, error> of a completion with one statement, a clause."""
    return let(decode_completion(row, names), clause_of)


def shown_of(d: Column, single: bool = False) -> Column:
    """A decoded completion's statements joined by `` <SEP> ``; null where it is malformed or, if ``single``, has several."""
    return F.when(d["error"].isNull() & ((F.size(d["texts"]) == 1) if single else F.lit(True)), F.array_join(d["texts"], " <SEP> "))


def display_text(row: Column, names: Column, single: bool = False) -> Column:
    """Statements joined by `` <SEP> ``; null where the row is malformed or, if ``single``, has several."""
    return let(decode_completion(row, names), lambda d: shown_of(d, single))
