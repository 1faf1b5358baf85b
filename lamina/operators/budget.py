"""Batches of rows of like length under a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chance import uniform
from .scan import running


def length_class(n: Column) -> Column:
    """The least of 1 to 8 and of 5 to 8 times a power of two that is n or more: less than a quarter above n. Nothing counts as 1."""
    less = F.greatest(n.cast("long"), F.lit(1)) - 1
    shift = F.greatest(F.length(F.bin(less)) - 3, F.lit(0))
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.floor(less / scale).cast("long") + 1) * scale


def token_batches(rows: DataFrame, key: str, length: str, budget: int, seed: str, ragged: bool = False, too_long: str = "error") -> DataFrame:
    """Adds pad_to, batch_id and row_idx: batches of rows of one length class, in an order within it that ``seed`` fixes.

    A batch padded to ``pad_to``, its class or the budget if that is less, has at most ``budget`` tokens; a
    ``ragged`` one has at most so many without padding, and as many rows as that gives; its numbers may have gaps. Longer rows than the budget
    are an error, or with ``too_long="alone"`` each a batch. Only a class's last batch may be much smaller.
    Places and running lengths are worked out in blocks, so a class may hold all rows; classes are some
    two hundred at most. ``key`` tells rows apart; repeated ones lie side by side in any order. Null lengths count as 0.
    """
    if too_long not in ("error", "alone"):
        raise ValueError("too_long is error or alone")
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(1))
    over = n > budget
    held = F.when(over, F.raise_error(F.lit("a row is longer than the budget")).cast("long")).otherwise(length_class(n)) if too_long == "error" else length_class(n)
    d = rows.withColumn("_n", n).withColumn("pad_to", F.when(F.col("_n") <= budget, F.least(held, F.lit(budget).cast("long"))).otherwise(held))
    d = d.withColumn("_u", uniform(F.concat_ws("|", F.lit(seed), F.col(key))))
    # alone: as many tokens as the budget, so that no two are together
    cost = F.when(F.col("_n") > budget, F.lit(budget)).when(F.lit(ragged), F.col("_n")).otherwise(F.lit(1))
    fits = F.when(F.col("_n") > budget, F.lit(budget)).when(F.lit(ragged), F.lit(budget) - F.col("pad_to") + 1).otherwise(F.floor(F.lit(budget) / F.col("pad_to")))
    d = d.withColumn("_fits", fits.cast("long")).withColumn("_class", F.struct(F.col("_n") > budget, "pad_to"))
    d = running(d, ["_class"], ["_u", key], {"_at": cost})
    d = d.withColumn("_b", F.floor(F.col("_at") / F.col("_fits")))
    sizes = d.groupBy("_class").agg((F.max("_b") + 1).alias("_many"))
    base = sizes.select("_class", F.coalesce(F.sum("_many").over(Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a class
    d = d.join(F.broadcast(base), "_class").withColumn("batch_id", F.col("_base") + F.col("_b"))
    at = F.row_number().over(Window.partitionBy("batch_id").orderBy("_u", key)) - 1  # a batch has at most ``budget`` rows
    return d.withColumn("row_idx", at.cast("int")).select(*rows.columns, "pad_to", "batch_id", "row_idx")


def padding(batches: DataFrame, length: str) -> DataFrame:
    """batches, rows, tokens, padded, share: what a corpus's batches hold and how much of it is padding."""
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    a = batches.agg(F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("rows"), F.sum(n).alias("tokens"), F.sum("pad_to").alias("padded"))
    return a.withColumn("share", 1 - F.col("tokens") / F.col("padded"))
