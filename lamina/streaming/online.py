"""Endless problem streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.banks import Bank
from ..operators.batches import with_phase


def problem_stream(spark: SparkSession, bank: Bank, distances: int | list[int], seed: int, rows_per_second: int = 100, mode: str | None = None, p_fresh: float = 0.5) -> DataFrame:
    """Steps of one new problem for each row of a rate source; a problem is fixed by its row's number.

    Of several distances each problem has one by its own seed. With a ``mode`` a hybrid bank's fresh rules come in,
    as in ``generate.problems``.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.chance import distance_seed
    from ..plans.banks import render
    from ..plans.generate import sample_problem

    payload, wanted = bank.to_json(), [distances] if isinstance(distances, int) else list(distances)
    schema = "problem_id long, goal string, step_idx int, statement string, source string"

    def run(batches):
        own = Bank.from_json(payload)
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                d = wanted[int(np.random.default_rng([seed, i]).integers(len(wanted)))]
                _, goal, steps = sample_problem(own, d, np.random.default_rng([distance_seed(seed, d), i]), mode=mode, p_fresh=p_fresh if mode else 0.0)
                rows += [(i, goal[0], k, render(s[3]), s[4]) for k, s in enumerate(steps)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()))], ["problem_id", "goal", "step_idx", "statement", "source"])

    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("value").mapInArrow(run, schema)


def curriculum_stream(events: DataFrame, phases: list[tuple[int, int]], watermark: str = "10 minutes") -> DataFrame:
    """Counts of events by phase in windows of an hour, late rows beyond the watermark left out."""
    e = with_phase(events.withColumn("step", F.col("event_id")), phases)
    return e.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour"), "d_max").agg(F.count(F.lit(1)).alias("n"))


def each_batch(stream: DataFrame, *hooks, mode: str = "append", checkpoint: str | None = None):
    """A running query that calls every hook with (batch, number) for each micro-batch, in turn: metrics, prints, summaries."""

    def run(batch: DataFrame, number: int) -> None:
        for hook in hooks:
            hook(batch, number)

    writer = stream.writeStream.outputMode(mode).foreachBatch(run)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def metrics_table(path: str, step: str = "step"):
    """A hook that appends long rows (step, metric, value, text) of a batch's metrics to a Parquet table."""
    from ..operators.metrics import flatten_metrics

    def hook(batch: DataFrame, number: int) -> None:
        flatten_metrics(batch, "stream").withColumn(step, F.lit(number)).write.mode("append").parquet(path)

    return hook
