"""Reading and writing rule banks as JSON tables with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.atoms import ATOM_TYPE
from ..plans.banks import VERSION, Bank, BankSpec, build

RULE = "pool string, src_layer int, statement string, lhs array<array<string>>, rhs array<array<string>>"


def save(spark: SparkSession, bank: Bank, path: str) -> None:
    """One JSON object in a folder that Spark's readers reach wherever it is."""
    import json

    one = json.dumps(json.loads(bank.to_json()), ensure_ascii=False)
    spark.createDataFrame([(one,)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> Bank:
    return Bank.from_json(spark.read.text(path, wholetext=True).first()["value"])


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """rules as a DataFrame without the driver's objects; another version is an error."""
    from ..functions.atoms import parse_clause

    raw = spark.read.schema("version int, rules array<struct<pool:string,src_layer:int,statement:string>>").json(path)
    raw = raw.where(F.when(F.col("version") == VERSION, True).otherwise(F.raise_error(F.lit("unknown bank version")).cast("boolean")))
    r = raw.select(F.posexplode("rules").alias("i", "r")).select((F.col("i") + 1).alias("rule_id"), "r.*")
    c = parse_clause(F.col("statement"))
    return r.select("rule_id", "pool", "src_layer", "statement", c["lhs"].cast(f"array<{ATOM_TYPE}>").alias("lhs"), c["rhs"].cast(f"array<{ATOM_TYPE}>").alias("rhs"))


PAIR_VERSION = 2


def save_pair(spark: SparkSession, train: Bank, held: Bank, path: str) -> None:
    """Two banks that share all but their first layers, with the numbers of either one's first predicates."""
    import json

    numbers = lambda b: [int(p.split("_")[1]) for p in b.layers[0]]
    one = {"version": PAIR_VERSION, "train": json.loads(train.to_json()), "eval": json.loads(held.to_json()), "train_numbers": numbers(train), "eval_numbers": numbers(held)}
    spark.createDataFrame([(json.dumps(one, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)


def load_pair(spark: SparkSession, path: str) -> tuple[Bank, Bank, dict[str, list[int]]]:
    """The banks and their numbers. Version 1 had no numbers: they are read off the predicates' names. Checked as on building."""
    import json

    from ..plans.banks import check_pair

    d = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if d.get("version") not in (1, PAIR_VERSION):
        raise ValueError(f"pair version {d.get('version')!r}")
    banks = {k: Bank.from_json(json.dumps(d[k])) for k in ("train", "eval")}
    numbers = {}
    for k, b in banks.items():
        named = [_number(p) for p in b.layers[0]]
        numbers[k] = d.get(f"{k}_numbers", named)
        if sorted(numbers[k]) != sorted(named):
            raise ValueError("numbers and names of first predicates differ")
    check_pair(banks["train"], banks["eval"])
    return banks["train"], banks["eval"], numbers


def _number(predicate: str) -> int:
    import re

    m = re.fullmatch(r"r0_(\d+)", predicate)
    if not m:
        raise ValueError(f"{predicate!r} is no predicate of the first layer")
    return int(m[1])


def save_propositions(spark: SparkSession, bank, path: str) -> None:
    spark.createDataFrame([(bank.to_json(),)], "value string").coalesce(1).write.text(path)


def load_propositions(spark: SparkSession, path: str):
    from ..plans.propositions import PropositionBank

    return PropositionBank.from_json(spark.read.text(path, wholetext=True).first()["value"])


def bank_for(spark: SparkSession, spec: BankSpec, seed: int, path: str | None = None) -> Bank:
    """The bank at a path if one is given, else one built from the spec and the seed."""
    return load(spark, path) if path else build(spec, seed)


def collate(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """All Parquet tables that can be read under the paths as one, by column names, and why others can't.

    A table with one broken file is left out whole and named with the error; no rows go in silence. Footers of all files
    are read to see that.
    """
    out, skipped = None, {}
    for p in paths:
        try:
            df = spark.read.option("mergeSchema", "true").parquet(p)
        except Exception as e:  # whatever is wrong with a path is its reason
            skipped[p] = str(e).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, skipped
