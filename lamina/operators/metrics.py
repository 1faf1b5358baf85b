"""Scores of predictions: rule matches, losses, calibration, exit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def rate(n: Column, of: Column) -> Column:
    """n / of, 0 where there is nothing."""
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def log_sum_exp(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.log(F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))


def nll(logits: Column, label: Column) -> Column:
    """Negative log-likelihood of a label counted from 0."""
    z = F.transform(logits, lambda v: v.cast("double"))
    return log_sum_exp(z) - F.element_at(z, label + 1)


def argmax(z: Column) -> Column:
    """Place of the greatest value, from 0, the first at a tie."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def masked_loss(tokens: DataFrame) -> DataFrame:
    """Mean loss over tokens (logits, label) whose label is not 0; null if there is none."""
    on = F.col("label") != 0
    return tokens.agg((F.sum(F.when(on, nll(F.col("logits"), F.col("label")))) / F.sum(F.when(on, 1))).alias("masked_ce"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error of (conf, correct): bins closed on the right, the first on both sides."""
    b = F.greatest(F.ceil(F.col("conf") * bins), F.lit(1))
    per = rows.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("conf").alias("conf"))
    return per.agg((F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n")) / F.sum("n")).alias("ece"))


def exit_distribution(halts: DataFrame, key: str, step: str, p: str = "halt_prob") -> DataFrame:
    """Adds exit_prob: halting at a step after no earlier one, the last step taking what remains.

    Survival is the exponential of a running sum of logarithms, scanned in blocks, so an episode may be of any length; steps
    are distinct within a key. After a step that halts for certain nothing remains.
    """
    sure = F.col(p) >= 1
    costs = {"_log": F.when(~sure, F.log(1 - F.col(p))), "_sure": sure.cast("long")}
    d = running(halts, [key], [step], costs, last="_last")
    stay = F.when(F.col("_sure") > 0, 0.0).otherwise(F.exp("_log"))
    return d.withColumn("exit_prob", F.when(F.col("_last"), stay).otherwise(F.col(p) * stay)).drop("_log", "_sure", "_last")


def match_metrics(matches: DataFrame) -> DataFrame:
    """Counts and rates of (decode_error, unknown, wrong, correct); the invalid rate of nothing is 1."""
    c = {k: F.count_if(F.col(k)) for k in ("decode_error", "unknown", "wrong", "correct")}
    n = F.count(F.lit(1))
    valid = F.count_if(~F.col("decode_error") & ~F.col("unknown"))
    out = [n.alias("n"), *(v.alias(f"n_{k}") for k, v in c.items()), valid.alias("n_valid"), *(rate(v, n).alias(f"{k}_rate") for k, v in c.items()), (1 - rate(valid, n)).alias("invalid_rate"), rate(c["correct"], valid).alias("correct_given_valid")]
    return matches.agg(*out)


def rule_membership(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of rows (set_id, pred) whose vector equals one of the rules (set_id, rule, used) in use in its set; null without rows."""
    own = rules.where("used").select("set_id", F.col("rule").alias("pred")).distinct().withColumn("_in", F.lit(1))
    return rows.join(own, ["set_id", "pred"], "left").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("membership"))


def flatten_metrics(df: DataFrame, prefix: str) -> DataFrame:
    """One row of metrics to (metric, value); values that are no numbers become text beside a null value."""
    names = [f.name for f in df.schema]
    pairs = F.array(*[F.struct(F.lit(f"{prefix}/{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    m = df.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")
    bad = F.isnan("value") | F.col("value").isin(float("inf"), float("-inf"))
    return m.select("metric", F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.col("value").cast("string")).alias("text"))
