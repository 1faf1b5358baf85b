"""Nested metrics of any shape to long rows, by levels of VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _is(kind: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | kind.startswith(n)
    return out


def metric_rows(rows: DataFrame, keys: list[str], metrics: str, prefix: str | None = None, by_index: bool = False) -> DataFrame:
    """``keys``, metric, value, text: one row for each number, truth value or text within ``metrics``, a VARIANT column.

    A metric is named by its path, joined by ``/``, behind ``prefix`` if there is one. Numbers and truth values (1 and 0)
    have a value, texts a text. Nulls and empty objects have no row, nor have arrays unless ``by_index``, which takes
    their elements under their places from 0. Each round opens one level of what is still nested, whatever rows it
    is in, so there are as many rounds as the deepest value has levels. Names that hold a ``/`` are not told
    apart from levels. Columns beside ``keys`` are not read; keys may have any names.
    """
    spark = rows.sparkSession
    open_ = rows.select(F.struct(*keys).alias("_id"), F.lit(prefix).cast("string").alias("_name"), F.col(metrics).alias("_v")).where("_v is not null")
    leaves = None
    while True:
        here = cut(open_.withColumn("_kind", F.schema_of_variant("_v")))
        nested = _is(F.col("_kind"), "OBJECT", "ARRAY") if by_index else _is(F.col("_kind"), "OBJECT")
        plain = ~_is(F.col("_kind"), "OBJECT", "ARRAY", "VOID")
        own = here.where(plain)
        leaves = own if leaves is None else leaves.unionByName(own)
        inner = here.where(nested).select("_id", "_name", "_v", "_kind")
        if inner.isEmpty():
            break
        # an object's entries, or an array's elements with a null key
        each = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.coalesce("key", F.col("pos").cast("string"))
        name = F.when(F.col("_name").isNull(), step).otherwise(F.concat("_name", F.lit("/"), step))
        open_ = each.select("_id", name.alias("_name"), F.col("value").alias("_v")).where("_v is not null")
    boolean, number = F.col("_kind") == "BOOLEAN", _is(F.col("_kind"), "BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")
    value = F.when(boolean, F.try_variant_get("_v", "$", "boolean").cast("double")).when(number, F.try_variant_get("_v", "$", "double"))
    text = F.when(~boolean & ~number, F.try_variant_get("_v", "$", "string"))
    return leaves.select("_id.*", F.col("_name").alias("metric"), value.alias("value"), text.alias("text"))
