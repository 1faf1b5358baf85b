"""Relational division: rules whose whole left side is among the facts of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .unify import small

SHARES = 64  # of the blocks of queries, where a bank is too large for broadcast
QUERIES, RULES = 256, 504  # ids of a block; 504 is the longest run that Parquet packs, so a block's ids repeat byte by byte and compress
HELD = 64  # blocks of rules that are cut from one list


def _met(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, rule_id of rules (rule_id, need: distinct, none null) whose needs are all among a query's facts (qid, fact: distinct).

    A rule meets queries by the rarest proposition that it needs, so it costs as many rows as that has queries,
    and only these are asked for the others: each is a fact to be met, and a rule holds where all are.
    """
    often = facts.groupBy("fact").agg(F.count(F.lit(1)).alias("n"))
    needs = rules.select("rule_id", "need", F.explode("need").alias("fact"))
    rarest = needs.join(often, "fact").groupBy("rule_id").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "fact")).alias("r"), F.first("need").alias("need"))
    rarest = rarest.where(F.col("known") == F.size("need")).select("rule_id", F.col("r.fact").alias("fact"), F.array_except("need", F.array("r.fact")).alias("rest"))
    met = facts.join(rarest, "fact").select("qid", "rule_id", "rest")
    open_ = met.where(F.size("rest") > 0).select("qid", "rule_id", F.size("rest").alias("_size"), F.explode("rest").alias("fact"))
    full = open_.join(facts, ["qid", "fact"]).groupBy("qid", "rule_id", "_size").agg(F.count(F.lit(1)).alias("n")).where("n = _size")
    return met.where(F.size("rest") == 0).select("qid", "rule_id").unionByName(full.select("qid", "rule_id"))


def _blocks(rows: DataFrame, name: str, key: str, size: int) -> DataFrame:
    """``key``, ids: lists of about ``size`` of a key's ids (``name``), of which the key has _n; null ids are kept."""
    of = F.pmod(F.xxhash64(name), F.ceil(F.col("_n") / size)).alias("_b")
    return rows.groupBy(key, of).agg(F.collect_list(F.struct(name)).alias("l")).select(key, F.transform("l", lambda x: x[name]).alias(f"{name}s"))


def _apart(df: DataFrame) -> DataFrame:
    """The same rows and partitions, but generated code ends here: within it, all that is made of one row is held at once."""
    return df.coalesce(1_000_000)


def applicable(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, rule_id for each rule (rule_id, need: array) all of whose propositions are facts (qid, fact) of the query.

    Queries with the same facts, of those that any rule needs, are asked once, as are rules with the same needs: sets of
    facts meet sets of needs, and then each query gets the rules of its set. A rule that needs nothing holds for every
    query. Repeated facts and needs count once; null ones are never met, and a rule with a null need never holds.
    Rules are told apart by rule_id. Only blocks of queries and blocks of rules are joined; their pairs are made after the last
    shuffle, and a block's rules one query after the other, so that they cost little as files too.
    """
    asked = rules.where(F.col("need").isNotNull() & ~F.exists("need", lambda x: x.isNull()))
    asked = cut(asked.select("rule_id", F.array_sort(F.array_distinct("need")).alias("need")))
    needed = asked.select(F.explode("need").alias("fact")).distinct().withColumn("_in", F.lit(True))
    have = facts.select("qid", "fact").distinct().join(needed, "fact", "left")
    own = cut(have.groupBy("qid").agg(F.array_sort(F.collect_set(F.when(F.col("_in"), F.col("fact")))).alias("_f")))
    sets = cut(own.groupBy("_f").agg(F.count(F.lit(1)).alias("_n")).withColumn("_q", F.monotonically_increasing_id()))
    needs = cut(asked.groupBy("need").agg(F.count(F.lit(1)).alias("_n")).withColumn("_r", F.monotonically_increasing_id()))
    met = _met(sets.select(F.col("_q").alias("qid"), F.explode("_f").alias("fact")), needs.select(F.col("_r").alias("rule_id"), "need"))
    free = F.broadcast(needs.where(F.size("need") == 0).select("_r"))  # one row at most
    met = cut(met.select(F.col("qid").alias("_q"), F.col("rule_id").alias("_r")).unionByName(sets.select("_q").crossJoin(free)))
    queries = spread(_blocks(own.join(sets, "_f"), "qid", "_q", QUERIES)).join(met, "_q").select("qids", "_r")
    of = _blocks(asked.join(needs, "need"), "rule_id", "_r", RULES * HELD).withColumn("rule_ids", F.array_sort("rule_ids"))
    starts = F.sequence(F.lit(1), F.size("rule_ids"), F.lit(RULES))
    of = of.withColumn("rule_ids", F.explode(F.transform(starts, lambda i: F.slice("rule_ids", i, RULES))))
    if small(asked):
        pairs = queries.join(F.broadcast(of), "_r")
    else:
        queries = queries.withColumn("_s", F.pmod(F.xxhash64("qids"), F.lit(SHARES)).cast("int"))
        pairs = queries.join(of.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["_r", "_s"])
    return _apart(_apart(pairs).select(F.explode("qids").alias("qid"), "rule_ids")).select("qid", F.explode("rule_ids").alias("rule_id"))
