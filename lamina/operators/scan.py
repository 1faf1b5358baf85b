"""Scans along an order within keys, of which one may hold most rows: each block of a range partitioning is scanned by itself,
and what blocks hand on is combined from one summary a block and key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows as a written table, with ``_k`` (the keys; null ones are equal) and ``_p``, numbers of blocks that rise along keys and order.

    Blocks are of about equal size and cut a large key at values of ``order``. Finding their limits reads the rows once more.
    """
    k = F.struct(*keys) if keys else F.struct(F.lit(0))
    return cut(rows.withColumn("_k", k).repartitionByRange("_k", *order).withColumn("_p", F.spark_partition_id()))


def _in_block(order: list) -> Window:
    return Window.partitionBy("_p", "_k").orderBy(*order)


def _across() -> Window:
    return Window.partitionBy("_k").orderBy("_p")  # a row for each block that a key is in


_EARLIER = (Window.unboundedPreceding, -1)


def running(rows: DataFrame, keys: list[str], order: list[str], costs: Mapping[str, Column], last: str | None = None) -> DataFrame:
    """Adds, under each name of ``costs``, the sum of that cost over the key's earlier rows; and as ``last`` whether no row comes later.

    ``order`` must tell a key's rows apart, or those that tie are summed in any order. Null costs count nothing.
    """
    t = blocks(rows, keys, order)
    per = t.groupBy("_p", "_k").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in costs.items()))
    base = [F.coalesce(F.sum(f"_sum_{n}").over(_across().rowsBetween(*_EARLIER)), F.lit(0)).alias(f"_base_{n}") for n in costs]
    base = per.select("_p", "_k", *base, F.lead("_p").over(_across()).isNull().alias("_end"))
    out = t.join(base, ["_p", "_k"])
    w = _in_block(order)
    for n, c in costs.items():
        out = out.withColumn(n, F.col(f"_base_{n}") + F.coalesce(F.sum(c).over(w.rowsBetween(*_EARLIER)), F.lit(0)))
    if last:
        out = out.withColumn(last, F.col("_end") & (F.row_number().over(_in_block([F.desc(c) for c in order])) == 1))
    return out.drop("_p", "_k", "_end", *(f"_base_{n}" for n in costs))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the key's last ``value`` that is not null, at the row or before it; null where there is none."""
    t = blocks(rows, keys, order)
    held = t.where(F.col(value).isNotNull()).groupBy("_p", "_k").agg(F.max_by(value, F.struct(*order)).alias("_v"))
    per = t.select("_p", "_k").distinct().join(held, ["_p", "_k"], "left")
    base = per.select("_p", "_k", F.last("_v", ignorenulls=True).over(_across().rowsBetween(*_EARLIER)).alias("_from"))
    own = F.last(value, ignorenulls=True).over(_in_block(order).rowsBetween(Window.unboundedPreceding, 0))
    return t.join(base, ["_p", "_k"]).withColumn(name, F.coalesce(own, "_from")).drop("_p", "_k", "_from")


def latest(rows: DataFrame, states: DataFrame, keys: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """Each row with ``take`` of the last of its key's states that has begun: an as-of join, ``start`` <= ``at``.

    States of one key and start: the greatest ``take`` counts. Rows without a state, and those with a null key or
    ``at``, have nulls; states with a null key or start are none. Both sides are put in one order and the
    state is carried along it, so neither a key's rows nor its states meet in one task. Columns of ``rows`` stay as
    they are; none may be named as one of ``take``.
    """
    know = [F.col(k).isNotNull() for k in keys]
    both = lambda cs: F.lit(True) if not cs else cs[0] if len(cs) == 1 else cs[0] & both(cs[1:])
    empty = lambda d: F.lit(None).cast(d)
    row = F.struct(*rows.columns)
    state = F.struct(*take)
    kind, row_kind = states.select(state.alias("s")).schema["s"].dataType, rows.select(row.alias("r")).schema["r"].dataType
    ok = both([*know, F.col(at).isNotNull()])
    mine = rows.where(ok).select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col(at).alias("_at"), F.lit(1).alias("_side"), empty(kind).alias("_state"), row.alias("_row"))
    theirs = states.where(both([*know, F.col(start).isNotNull()])).select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col(start).alias("_at"), F.lit(0).alias("_side"), state.alias("_state"), empty(row_kind).alias("_row"))
    done = carried(theirs.unionByName(mine), [f"_key{i}" for i in range(len(keys))], ["_at", "_side", "_state"], "_state", "_now")
    out = done.where("_side = 1").select("_row.*", *(F.col(f"_now.{c}").alias(c) for c in take))
    rest = rows.where(~F.coalesce(ok, F.lit(False))).select(*rows.columns, *(empty(states.schema[c].dataType).alias(c) for c in take))
    return out.unionByName(rest)
