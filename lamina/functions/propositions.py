"""Propositional sequents and clauses to token ids and back: each proposition ``p<layer>_<n>`` is one token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .atoms import let
from .decode import symbols
from .tokens import EOT, PAD, SEP, START, segments, to_ids

_ONE = r"p\d+_\d+"
_SIDE = rf"{_ONE}(∧{_ONE})*"
_SIDES = rf"^{_SIDE}→{_SIDE}$"
_SEQUENT = r"^(q(,q)*,?)?⊢q$"  # once every proposition is a q


def tokens_of(text: Column) -> Column:
    """Propositions whole, else single characters; white space is left out."""
    return F.regexp_extract_all(text, F.lit(rf"{_ONE}|\S"), F.lit(0))


def prompt_ids(sequent: Column, ids: Column) -> Column:
    """``a,b⊢c`` and <START>; propositions and characters outside the vocabulary are an error."""
    return to_ids(F.concat(tokens_of(sequent), F.array(F.lit("<START>"))), ids)


def completion_ids(clause: Column, ids: Column) -> Column:
    """``a ∧ b → c`` and <EOT>."""
    return to_ids(F.concat(tokens_of(clause), F.array(F.lit("<EOT>"))), ids)


def _shape(text: Column) -> Column:
    """The text with a q for every proposition, compound ones ``(a∧b)`` and ``(a→b)`` too, however deep they nest."""
    plain = F.regexp_replace(text, _ONE, "q")
    depth = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit("("), F.lit(""))))
    return F.aggregate(depth, plain, lambda s, _: F.regexp_replace(s, r"\(q[∧→]q\)", "q"))


def decode_prompt(row: Column, names: Column) -> Column:
    """struct<ants, cons, error>: texts of the propositions behind the last <SEP> and before the one <START>.

    Padding is left out, antecedents keep their order and may be none. ``error`` is null where the row is well
    formed, else ants and cons are.
    """

    def finish(d: Column) -> Column:
        error = F.coalesce(d["error"], F.when(~F.contains(d["text"], F.lit("⊢")), "⊢ is missing").when(~_shape(d["text"]).rlike(_SEQUENT), "malformed sequent"))
        sides = F.split(d["text"], "⊢")
        ants = F.filter(F.split(sides[0], ","), lambda a: a != "")
        return let(error, lambda e: F.struct(F.when(e.isNull(), ants).alias("ants"), F.when(e.isNull(), F.element_at(sides, -1)).alias("cons"), e.alias("error")))

    def read(own: Column) -> Column:
        starts = F.size(F.filter(own, lambda t: t == START))
        body = F.slice(own, F.lit(1), F.greatest(F.array_position(own, F.lit(START)).cast("int") - 1, F.lit(0)))
        early = F.when(own.isNull() | (starts != 1), "exactly one <START> is needed")
        error = lambda s: F.coalesce(early, F.when(F.size(s) == 0, "empty prompt").when(F.exists(s, lambda x: x.isNull()), "unknown id"))
        return let(symbols(F.element_at(segments(body), -1), names), lambda s: let(F.struct(error(s).alias("error"), F.array_join(s, "").alias("text")), finish))

    return let(F.filter(row, lambda t: t != PAD), read)


def decode_completion(row: Column, names: Column) -> Column:
    """struct<lhs, rhs, text, error> of a row that holds one clause and ends in <EOT>; text is ``a ∧ b → c``.

    Neither brackets nor commas are allowed. ``error`` is null where the row is well formed, else the others are.
    """

    def finish(d: Column) -> Column:
        error = F.coalesce(d["error"], F.when(~d["text"].rlike(_SIDES), "malformed clause"))
        side = lambda i: F.split(F.split(d["text"], "→")[i], "∧")
        text = F.concat(F.array_join(side(0), " ∧ "), F.lit(" → "), F.array_join(side(1), " ∧ "))
        return let(error, lambda e: F.struct(*(F.when(e.isNull(), c).alias(n) for n, c in (("lhs", side(0)), ("rhs", side(1)), ("text", text))), e.alias("error")))

    def read(r: Column) -> Column:
        early = F.when(r.isNull() | (F.size(r) < 2), "too short").when(F.element_at(r, -1) != EOT, "<EOT> must end it")
        body = symbols(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), names)
        error = lambda s: F.coalesce(early, F.when(F.exists(s, lambda x: x.isNull()), "unknown id"))
        return let(body, lambda s: let(F.struct(error(s).alias("error"), F.array_join(s, "").alias("text")), finish))

    return let(row, read)


def readable(row: Column, names: Column, padding: bool = False, special: bool = True) -> Column:
    """A row of ids as one string, without <PAD> but for ``padding``, and with the other special tokens if ``special``."""
    kept = F.filter(row, lambda t: (F.lit(padding) | (t != PAD)) & (F.lit(special) | ~t.isin(SEP, START, EOT)))
    name = lambda t: F.coalesce(F.try_element_at(names, t), F.raise_error(F.concat(F.lit("unknown id "), t.cast("string"))).cast("string"))
    return F.array_join(F.transform(kept, name), "")
