"""Token ids of atoms, sequents and clauses as array columns, and shapes of id sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .atoms import let

# Fixed ids of the token language.
SPECIAL = {"<PAD>": 0, "⊢": 1, "∧": 2, "→": 3, "(": 4, ")": 5, ",": 6, "<SEP>": 7, "<START>": 8, "<EOT>": 9}
PAD, SEP, START, EOT = 0, 7, 8, 9
_SPELLED = r"^(r\d+_\d+|r_[a-z0-9]+)$"  # predicates that go character by character


def vocabulary(names: DataFrame) -> DataFrame:
    """token, id from names (name, is_predicate): special tokens, sorted other names, sorted characters of predicates."""
    spelled = names.where(F.col("is_predicate") & F.col("name").rlike(_SPELLED))
    whole = names.where(~(F.col("is_predicate") & F.col("name").rlike(_SPELLED))).select(F.lit(0).alias("part"), F.col("name").alias("token"))
    chars = spelled.select(F.lit(1).alias("part"), F.explode(F.split("name", "")).alias("token")).where("token <> ''")
    all_ = whole.unionAll(chars).groupBy("token").agg(F.min("part").alias("part")).where(~F.col("token").isin(*SPECIAL))
    ordered = all_.agg(F.array_sort(F.collect_list(F.struct("part", "token"))).alias("t"))  # a vocabulary, not a corpus
    new = ordered.select(F.posexplode("t").alias("i", "t")).select(F.col("t.token").alias("token"), (F.col("i") + len(SPECIAL)).alias("id"))
    fixed = F.explode(F.from_json(F.lit(_special_json()), "map<string,int>"))
    return new.unionByName(ordered.select(fixed).select(F.col("key").alias("token"), F.col("value").alias("id")))


def _special_json() -> str:
    import json

    return json.dumps(SPECIAL)


def id_map(vocab: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])


def atom_tokens(atom: Column) -> Column:
    """Characters of a layered predicate, else the whole name; arguments in brackets without commas."""
    name = F.when(atom["predicate"].rlike(_SPELLED), F.filter(F.split(atom["predicate"], ""), lambda c: c != "")).otherwise(F.array(atom["predicate"]))
    return F.concat(name, F.when(F.size(atom["args"]) > 0, F.concat(F.array(F.lit("(")), atom["args"], F.array(F.lit(")")))).otherwise(F.array().cast("array<string>")))


def _joined(parts: Column, by: str) -> Column:
    return F.flatten(F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(by))).otherwise(F.array().cast("array<string>")), x)))


def prompt_tokens(ants: Column, cons: Column) -> Column:
    return F.concat(_joined(F.transform(ants, atom_tokens), ","), F.array(F.lit("⊢")), atom_tokens(cons), F.array(F.lit("<START>")))


def clause_tokens(lhs: Column, rhs: Column) -> Column:
    return F.concat(_joined(F.transform(lhs, atom_tokens), "∧"), F.array(F.lit("→")), _joined(F.transform(rhs, atom_tokens), "∧"))


def completion_tokens(clauses: Column) -> Column:
    """Clauses' tokens (array of arrays) with <SEP> between and <EOT> at the end."""
    return F.concat(_joined(clauses, "<SEP>"), F.array(F.lit("<EOT>")))


def to_ids(tokens: Column, ids: Column) -> Column:
    """Unknown tokens are an error."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.raise_error(F.concat(F.lit("unknown token "), t)).cast("int")))


def to_text(row: Column, names: Column, special: bool = False, by: str = "") -> Column:
    keep = row if special else F.filter(row, lambda t: ~t.isin(PAD, SEP, START, EOT))
    return F.array_join(F.transform(keep, lambda t: F.element_at(names, t)), by)


def prepend(demos: Column, prompt: Column) -> Column:
    """Each demonstration without its <EOT>, then <SEP>, and the prompt last."""
    return F.concat(F.flatten(F.transform(demos, lambda d: F.concat(F.filter(d, lambda t: t != EOT), F.array(F.lit(SEP))))), prompt)


def up_to_eot(row: Column) -> Column:
    at = F.array_position(row, F.lit(EOT)).cast("int")
    return F.when(at > 0, F.slice(row, F.lit(1), at)).otherwise(row)


def segments(row: Column) -> Column:
    """Parts between <SEP> tokens, <PAD> left out."""
    start = F.array(F.array().cast("array<int>"))
    return F.aggregate(F.filter(row, lambda t: t != PAD), start, lambda acc, t: F.when(t == SEP, F.concat(acc, F.array(F.array().cast("array<int>")))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(t))))))


def pad_or_trim(row: Column, n: Column | int, value: int = PAD) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(row, F.array_repeat(F.lit(value), n)), F.lit(1), n)


def next_power(n: Column) -> Column:
    """The least power of two that is n or more, in integers."""
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n.cast("bigint") - 1))))


def remapped_labels(y: Column, ignore: int = -100) -> Column:
    return F.transform(y, lambda v: F.when(v == 0, F.lit(ignore)).otherwise(v))


def proposition_vocabulary(names: DataFrame) -> DataFrame:
    """token, id from names (name): special tokens, then each proposition ``p<layer>_<n>`` whole, by layer and number.

    Other names are an error; names that are repeated count once.
    """
    part = lambda i: F.regexp_extract("name", r"^p(\d+)_(\d+)$", i)
    asked = names.select("name").distinct().withColumn("layer", F.when(part(1) == "", F.raise_error(F.concat(F.lit("no proposition "), F.col("name"))).cast("int")).otherwise(part(1).cast("int"))).withColumn("n", part(2).cast("int"))
    ordered = asked.agg(F.array_sort(F.collect_list(F.struct("layer", "n", "name"))).alias("t"))  # a vocabulary, not a corpus
    new = ordered.select(F.posexplode("t").alias("i", "t")).select(F.col("t.name").alias("token"), (F.col("i") + len(SPECIAL)).alias("id"))
    return new.unionByName(ordered.select(F.explode(F.from_json(F.lit(_special_json()), "map<string,int>"))).select(F.col("key").alias("token"), F.col("value").alias("id")))


def retokenized(row: Column, names: Column, ids: Column, n: int, pad: int = PAD, ignore: int = -100) -> Column:
    """Ids to text, its words to ids of another vocabulary, cut or padded to ``n``; labels are these ids, unshifted, ``ignore`` at padding."""
    words = F.filter(F.split(to_text(row, names, by=" "), " "), lambda w: w != "")
    xs = pad_or_trim(to_ids(words, ids), n, pad)
    return F.struct(xs.alias("xs"), F.transform(xs, lambda v: F.when(v == pad, F.lit(ignore)).otherwise(v)).alias("ys"))


def length_bounds(rules: DataFrame, arities: DataFrame, start_facts: int, n_demos: int = 0, fresh: tuple[int, int] | None = None, steps: int = 1) -> DataFrame:
    """One row of the longest lengths that a bank allows: max_atom, max_prompt, max_completion, n_seq.

    ``rules`` (lhs, rhs) and ``arities`` (predicate, arity) of one or more banks. A prompt holds as many facts
    as a query may start with or a rule derive, a goal, separators and <START>, and ``n_demos`` clauses with
    a separator each. ``fresh`` gives the most atoms on either side of rules that are not in a bank. With
    ``steps`` above 1 a completion holds so many clauses.
    """
    atom = F.struct("predicate", F.array_repeat(F.lit("a"), F.col("arity")).alias("args"))
    a = arities.agg(F.greatest(F.lit(1), F.max(F.size(atom_tokens(atom)))).alias("max_atom"))
    clause = rules.agg(F.max(F.size(clause_tokens(F.col("lhs"), F.col("rhs")))).alias("_clause"), F.max(F.size("rhs")).alias("_rhs"))
    d = a.join(F.broadcast(clause))  # one row each
    if fresh:
        d = d.withColumn("_demo", F.greatest("_clause", F.col("max_atom") * sum(fresh) + 5)).withColumn("_one", F.greatest(F.col("_clause") + 1, F.col("max_atom") * sum(fresh) + 5))
    else:
        d = d.withColumn("_demo", F.col("_clause")).withColumn("_one", F.col("_clause") + 1)
    facts = F.greatest(F.lit(start_facts), F.col("_rhs"))
    prompt = facts * F.col("max_atom") + F.greatest(facts - 1, F.lit(0)) + F.col("max_atom") + 2 + n_demos * (F.col("_demo") + 1)
    d = d.withColumn("max_prompt", prompt).withColumn("max_completion", (F.col("_one") - 1) * steps + steps)
    return d.select("max_atom", "max_prompt", "max_completion", (F.col("max_prompt") + F.col("max_completion") - 1).alias("n_seq"))


# --- vocabularies as JSON

VERSION = 1


def vocabulary_json(vocab: dict[str, int]) -> str:
    import json

    return json.dumps({"version": VERSION, "tokens": [t for t, _ in sorted(checked(vocab).items(), key=lambda p: p[1])]}, ensure_ascii=False)


def vocabulary_from_json(text: str) -> dict[str, int]:
    """Another version, repeated tokens or special tokens out of place are errors."""
    import json

    d = json.loads(text)
    if d.get("version") != VERSION:
        raise ValueError(f"vocabulary version {d.get('version')!r}")
    return checked({t: i for i, t in enumerate(d["tokens"])}, len(d["tokens"]))


def checked(vocab: dict[str, int], n: int | None = None) -> dict[str, int]:
    if sorted(vocab.values()) != list(range(len(vocab))) or (n is not None and n != len(vocab)):
        raise ValueError("ids must be 0 to the number of tokens less one, each once")
    if any(vocab.get(t) != i for t, i in SPECIAL.items()):
        raise ValueError("special tokens have fixed ids")
    return vocab


def collected(vocab: DataFrame) -> dict[str, int]:
    """A vocabulary table (token, id) on the driver, checked; a vocabulary is configuration."""
    return checked({r["token"]: r["id"] for r in vocab.collect()})


def name_map(vocab: dict[str, int]) -> Column:
    """id to token."""
    return F.create_map(*[F.lit(x) for t, i in vocab.items() for x in (i, t)])


def bank_names(arities: DataFrame, constants: list[str], variables: int) -> DataFrame:
    """name, is_predicate of a bank's predicates (predicate), constants and variables x1 to xn, for ``vocabulary``."""
    other = [*constants, *(f"x{i + 1}" for i in range(variables))]
    names = arities.select(F.col("predicate").alias("name"), F.lit(True).alias("is_predicate")).distinct()
    return names.unionByName(arities.sparkSession.createDataFrame([(x, False) for x in other], "name string, is_predicate boolean"))


def sentinels(length: int = 4) -> list[str]:
    """Predicates that hold all 36 characters of fresh names, for a vocabulary of banks that are still to come."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    return ["r_" + letters[i : i + length].ljust(length, letters[0]) for i in range(0, len(letters), length)]


# --- rows for evaluation


def predicate_index(name: Column, layer: int) -> Column:
    """n of ``r<layer>_<n>``; null for another layer or form."""
    n = F.regexp_extract(name, rf"^r{int(layer)}_(\d+)$", 1)
    return F.when(n != "", n.cast("int"))


def prompt_only(row: Column, n: int, strict: bool = False) -> Column:
    """The row cut or padded to ``n`` ids, <PAD> behind its one <START>; with ``strict`` a longer prompt is an error."""

    def read(cut: Column) -> Column:
        bad = F.size(F.filter(cut, lambda t: t == START)) != 1
        if strict:
            bad = bad | (F.array_position(row, F.lit(START)) > n)
        at = F.array_position(cut, F.lit(START))
        return let(at, lambda a: F.when(bad, F.raise_error(F.lit("exactly one <START> is needed within the length")).cast("array<int>")).otherwise(F.transform(cut, lambda t, i: F.when(i < a, t).otherwise(F.lit(PAD)))))

    return let(pad_or_trim(row, n), read)


def first_eot(row: Column) -> Column:
    """Place of the first <EOT>, from 0; a row without one is an error."""
    at = F.array_position(row, F.lit(EOT)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit("<EOT> is missing")).cast("int"))


def completion_of_labels(ys: Column) -> Column:
    """The ids of a label row that are not masked; none is an error."""
    own = F.filter(ys, lambda y: y != 0)
    return F.when(F.size(own) > 0, own).otherwise(F.raise_error(F.lit("a completion is empty")).cast("array<int>"))


def completion_target(ys: Column, n: int) -> Column:
    """struct<target, length>: a label row's completion, padded to ``n`` ids with <EOT>; a longer one is an error."""
    own = completion_of_labels(ys)
    fits = F.when(F.size(own) <= n, own).otherwise(F.raise_error(F.lit("a completion is longer than the target")).cast("array<int>"))
    return F.struct(pad_or_trim(fits, n, EOT).alias("target"), F.size(own).alias("length"))


def padded_target(row: Column, n: int) -> Column:
    """A completion cut or padded to ``n`` ids with <EOT>; its first <EOT> must lie within."""
    return F.when(first_eot(row) < n, pad_or_trim(row, n, EOT)).otherwise(F.raise_error(F.lit("<EOT> lies beyond the length")).cast("array<int>"))


def answer_pairs(rows: DataFrame, autoregressive: bool = True) -> DataFrame:
    """Adds predicted and gold completions to rows (xs, ys, preds).

    Autoregressive rows are masked: where ys is not 0, preds and ys are the completions; rows without any go.
    Otherwise both are whole rows up to their first <EOT>, and every row stays.
    """
    if not autoregressive:
        return rows.withColumn("predicted", up_to_eot(F.col("preds"))).withColumn("gold", up_to_eot(F.col("ys")))
    both = F.filter(F.arrays_zip("preds", "ys"), lambda p: p["ys"] != 0)
    out = rows.withColumn("_p", both).where(F.size("_p") > 0)
    return out.withColumn("predicted", F.col("_p.preds")).withColumn("gold", F.col("_p.ys")).drop("_p")
