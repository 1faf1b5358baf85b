"""Exact duplicates by distributed MSD radix partitioning over the bytes of the normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, meet

#: The first digit has this many bytes; each further one reaches GROWTH times as far into the text.
FIRST, GROWTH = 24, 32


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256.

    Groups are split by successive bytes: the first digit is where the text ends and its first bytes, each
    later one the bytes that follow, up to ``growth`` times as far, until a group has one row or its texts
    have ended. A group is named by its head, the row of its smallest key, and a row takes part in a round
    with its group's name and its next digit alone, so no byte is looked at twice. Texts meet only as
    bytes; text_sha256 is output and joins nothing. Texts are written once and never moved.

    Groups are counted with partial sums, so one with a third of all rows is one row from each task, and
    rows of such groups meet their counts by broadcast (``meet``). Only rows of groups with several rows go
    on, so rounds grow with the logarithm of the longest repeated text.

    Null text counts as empty. Null keys come last when the smallest is sought; keep_id is null if all are.
    Of repeated rows (same key and text) one stays. Other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        b = normalised(F.col(text)).cast("binary")
        base = docs.select(F.col(key).alias("id"), b.alias("b"), F.monotonically_increasing_id().alias("rid"))
        base = scratch.table(base.withColumn("len", F.octet_length("b").cast("long")).withColumn("sha", F.sha2("b", 256)))
        rows, on, start, reach, done = base.select("rid", "id", "len", F.substring("b", 1, first).alias("digit")), ["len", "digit"], 0, first, []
        head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("head")
        total = base.count()
        while True:
            groups = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), head).where("n > 1")
            live = meet(rows, scratch.table(groups), on, "n", total)
            live = scratch.table(live.select("rid", "id", "len", "n", F.col("head.id").alias("keep"), F.col("head.rid").alias("group")))
            done.append(live.where(F.col("len") <= reach))
            open_ = live.where(F.col("len") > reach)
            if open_.isEmpty():
                break
            start, reach, on = reach, reach * growth, ["group", "digit"]
            digits = base.where(F.col("len") > start).select("rid", F.substring("b", start + 1, reach - start).alias("digit"))
            rows = scratch.table(open_.select("rid", "id", "len", "group").join(digits, "rid"))
        groups = done[0]
        for d in done[1:]:
            groups = groups.unionByName(d)
        out = base.select("rid", "id", "sha").join(groups.select("rid", "n", "keep", "group"), "rid", "left")
        alone = F.col("n").isNull()
        return scratch.result(
            out.select(
                F.col("id").alias(key),
                F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                (alone | (F.col("rid") == F.col("group"))).alias("kept"),
                F.col("sha").alias("text_sha256"),
            )
        )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns. Keys are taken as unique; see ``exact_dedup``."""
    kept = exact_dedup(docs, text, key).where("kept").select(F.col(key).alias("_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_key"]), "left_semi")
