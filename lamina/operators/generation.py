"""Token choice, decoding loops over a pluggable model, losses and accuracies of rows of logits."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chance import gumbel
from ..functions.tokens import EOT, PAD, START
from .metrics import argmax, log_sum_exp, nll


class Model(Protocol):
    """The one pluggable function: ids (rows, length; <PAD> on the right) to logits (rows, length, vocabulary).

    It is pickled to the executors and called with batches of rows.
    """

    def __call__(self, ids: np.ndarray) -> np.ndarray: ...


def choose(logits: Column, temperature: float, key: Column | None = None) -> Column:
    """An id: the first of the greatest logits at a temperature of 0 or less, else a draw by softmax(logits / temperature).

    The draw adds Gumbel noise fixed by ``key`` and the id, which gives the same distribution.
    """
    if temperature <= 0:
        return argmax(logits)
    noisy = F.transform(logits, lambda z, i: z.cast("double") / F.lit(float(temperature)) + gumbel(F.concat_ws("|", key, i.cast("string"))))
    return argmax(noisy)


def _drawn(logits: np.ndarray, temperature: float, rng) -> np.ndarray:
    if temperature <= 0:
        return logits.argmax(-1)
    return (logits / temperature + rng.gumbel(size=logits.shape)).argmax(-1)


def _grid(rows: list[list[int]], n: int) -> np.ndarray:
    out = np.full((len(rows), n), PAD, dtype=np.int32)
    for i, r in enumerate(rows):
        out[i, : min(len(r), n)] = r[:n]
    return out


def predict(prompts: DataFrame, model: Model, n_seq: int, most: int, way: str = "autoregressive", temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds completion (ids) to prompts (key: long, prompt: ids with one <START>, at its end).

    ``autoregressive``: one id after the other behind the prompt, up to <EOT> or ``most`` ids or a row of ``n_seq``.
    ``completion``: the model sees the prompt padded to ``n_seq`` and its logits' first ``most`` places are the completion, up
    to <EOT>. Draws depend on seed and key. A prompt longer than ``n_seq`` or without its <START> is an error. Rows
    are decoded in Arrow batches, all open rows of a batch at once; nothing is shuffled.
    """
    if way not in ("autoregressive", "completion"):
        raise ValueError("way is autoregressive or completion")

    def up_to(row: np.ndarray) -> list[int]:
        end = np.flatnonzero(row == EOT)
        return row[: end[0] + 1].tolist() if len(end) else row.tolist()

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(r is None or r.count(START) != 1 or len(r) > n_seq for r in rows):
                raise ValueError("a prompt needs one <START> and must fit the model")
            if way == "completion":
                z = model(_grid(rows, n_seq))[:, :most] if rows else np.empty((0, 0, 1))
                rngs = [np.random.default_rng([seed, k or 0]) for k in keys]
                out = [up_to(_drawn(z[i], temperature, rngs[i])) for i in range(len(rows))]
            else:
                full, out, open_ = [list(r) for r in rows], [[] for _ in rows], list(range(len(rows)))
                rngs = [np.random.default_rng([seed, k or 0]) for k in keys]
                while open_ := [i for i in open_ if len(full[i]) < n_seq + 1 and len(out[i]) < most and (not out[i] or out[i][-1] != EOT)]:
                    z = model(_grid([full[i] for i in open_], n_seq))
                    for j, i in enumerate(open_):
                        t = int(_drawn(z[j, len(full[i]) - 1], temperature, rngs[i]))
                        full[i].append(t)
                        out[i].append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), pa.array(out, pa.list_(pa.int32()))], ["key", "prompt", "completion"])

    return prompts.select(F.col("key").cast("long"), F.col("prompt").cast("array<int>")).mapInArrow(run, "key long, prompt array<int>, completion array<int>")


class Stepwise(Protocol):
    """A model that keeps what it has read. A state is a tuple of arrays whose first axis is that of the rows."""

    def begin(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Logits (rows, ids) behind each row's first ``lengths`` ids, and the state there."""

    def step(self, state: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Logits and state once each row has one id more."""


def predict_stepwise(prompts: DataFrame, model: Stepwise, n_seq: int, most: int, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """As ``predict`` does id after id, with the same draws, but a prompt is read once and then each new id once.

    Rows that have ended leave the batch with their state. Null prompts, those without exactly one <START> and those
    longer than ``n_seq`` are an error.
    """

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(r is None or r.count(START) != 1 or len(r) > n_seq for r in rows):
                raise ValueError("a prompt needs one <START> and must fit the model")
            out, open_ = [[] for _ in rows], np.arange(len(rows))
            rngs = [np.random.default_rng([seed, k or 0]) for k in keys]
            lengths = np.array([len(r) for r in rows], dtype=np.int64)
            if rows and most > 0:
                z, state = model.begin(_grid(rows, int(lengths.max())), lengths)
            while len(open_) and most > 0:
                ids = np.array([int(_drawn(z[j], temperature, rngs[i])) for j, i in enumerate(open_)], dtype=np.int32)
                for i, t in zip(open_, ids.tolist()):
                    out[i].append(t)
                done = np.array([len(out[i]) for i in open_])
                on = (ids != EOT) & (done < most) & (lengths[open_] + done < n_seq + 1)
                open_, ids, state = open_[on], ids[on], tuple(x[on] for x in state)
                if len(open_):
                    z, state = model.step(state, ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), pa.array(out, pa.list_(pa.int32()))], ["key", "prompt", "completion"])

    return prompts.select(F.col("key").cast("long"), F.col("prompt").cast("array<int>")).mapInArrow(run, "key long, prompt array<int>, completion array<int>")


def fill(rows: DataFrame, model: Model, at: int = 1, beta: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows (key, xs) whose places behind ``at`` are drawn one after the other by softmax(beta * logits) of the place before."""

    def run(batches):
        for batch in batches:
            keys, rows_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = [None] * len(rows_)
            for n in sorted({len(r) for r in rows_}):
                own = [i for i, r in enumerate(rows_) if len(r) == n]
                xs = _grid([rows_[i] for i in own], n)
                rngs = [np.random.default_rng([seed, keys[i] or 0]) for i in own]
                for k in range(at, n - 1):
                    z = beta * model(xs)[:, k]
                    xs[:, k + 1] = [_drawn(z[j], 1.0, rngs[j]) for j in range(len(own))]
                for j, i in enumerate(own):
                    done[i] = xs[j].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(pa.int32()))], ["key", "xs"])

    return rows.select(F.col("key").cast("long"), F.col("xs").cast("array<int>")).mapInArrow(run, "key long, xs array<int>")


def adapter(model: Model, to_prompt: Callable[[DataFrame], DataFrame], to_text: Callable[[DataFrame], DataFrame], **how) -> Callable[[DataFrame], DataFrame]:
    """A ``rollout`` adapter of a model: ``to_prompt`` adds key and prompt (ids) to open rows, ``to_text`` turns (key, completion)
    into (key, answer)."""

    def run(rows: DataFrame) -> DataFrame:
        asked = to_prompt(rows)
        said = to_text(predict(asked.select("key", "prompt"), model, **how).select("key", "completion"))
        return asked.join(said, "key", "left")

    return run


# --- losses by name: Columns of one row's logits and label


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "bce": lambda z, y: _softplus(z.cast("double")) - z.cast("double") * y.cast("double"),
    "ce": lambda z, y: nll(z, y),
    "ce_mask": lambda z, y: F.when(y != 0, nll(z, y)),
    "mse": lambda z, y: F.pow(z.cast("double") - y.cast("double"), F.lit(2)),
}


def loss(name: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A loss by its name, or the given function of (logits, label) itself. Masked rows have a null loss, which means skip."""
    if callable(name):
        return name
    if name not in LOSSES:
        raise ValueError(f"losses are {sorted(LOSSES)}, not {name!r}")
    return LOSSES[name]


def binary_choice(z: Column) -> Column:
    """A single logit's prediction: above 0."""
    return z > 0


def token_accuracy(rows: DataFrame) -> DataFrame:
    """accuracy over all tokens of rows (preds, ys) whose label is not 0; null without any."""
    own = F.filter(F.arrays_zip("preds", "ys"), lambda p: p["ys"] != 0)
    hits = F.size(F.filter(own, lambda p: p["preds"] == p["ys"]))
    return rows.agg(F.try_divide(F.sum(hits).cast("double"), F.sum(F.size(own)).cast("double")).alias("accuracy"))


def last_labelled(ys: Column) -> Column:
    """Place of the last label that is not 0, from 0; 0 if there is none."""
    return F.greatest(F.coalesce(F.array_max(F.transform(ys, lambda y, i: F.when(y != 0, i))), F.lit(0)), F.lit(0))


def final_token_accuracy(rows: DataFrame) -> DataFrame:
    """Share of rows (preds, ys) whose last labelled token is right; a row without labels is judged at its first place."""
    at = last_labelled(F.col("ys")) + 1
    return rows.agg(F.avg((F.element_at("preds", at) == F.element_at("ys", at)).cast("double")).alias("accuracy"))


def weighted_evaluation(tokens: DataFrame, ignore: int = -100) -> DataFrame:
    """loss, accuracy, n over all tokens (logits, label) that are not ignored: each token weighs the same, whatever its batch."""
    own = tokens.where(F.col("label") != ignore)
    return own.agg(F.avg(nll(F.col("logits"), F.col("label"))).alias("loss"), F.avg((argmax(F.col("logits")) == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def mean_of_batches(batches: DataFrame, *metrics: str) -> DataFrame:
    """Unweighted means over batches of metrics that are one row a batch."""
    return batches.agg(*(F.avg(m).alias(m) for m in metrics))


# --- halting


def halting_loss(steps: DataFrame, key: str, step: str, beta: float) -> DataFrame:
    """``key``, expected_loss, entropy, objective of rows (exit_prob, loss): the mean loss by exit, less beta times the exits' entropy."""
    q = F.col("exit_prob")
    out = steps.groupBy(key).agg(F.sum(q * F.col("loss")).alias("expected_loss"), (-F.sum(q * F.log(F.greatest(q, F.lit(1e-12))))).alias("entropy"))
    return out.withColumn("objective", F.col("expected_loss") - F.lit(beta) * F.col("entropy"))


def gate_loss(steps: DataFrame, key: str, step: str, slope: float = 50.0, margin: float = 0.005) -> DataFrame:
    """``key``, gate_loss over rows (halt_prob, loss): cross-entropy of going on, 1 - halt_prob, against a sigmoid of what the
    step won over the one before, slope * (max(0, gain) - margin). First steps have no target; keys without others go."""
    gain = F.lag("loss").over(Window.partitionBy(key).orderBy(step)) - F.col("loss")
    go = 1 / (1 + F.exp(-F.lit(slope) * (F.greatest(F.col("_gain"), F.lit(0.0)) - F.lit(margin))))
    p = F.least(F.greatest(F.col("halt_prob"), F.lit(1e-7)), F.lit(1 - 1e-7))
    each = -(go * F.log(1 - p) + (1 - go) * F.log(p))
    return steps.withColumn("_gain", gain).where("_gain is not null").groupBy(key).agg(F.avg(each).alias("gate_loss"))


# --- loops


def split_batch(size: int, most: int) -> tuple[int, int]:
    """Size and number of equal parts of a batch none of which is much above ``most``."""
    parts = math.ceil(size / most)
    return round(size / parts), parts


def evaluation_steps(steps: DataFrame, every: int, last: int, step: str = "step") -> DataFrame:
    """The steps at which metrics are taken: each ``every``-th, and the last."""
    return steps.where((F.col(step) % every == 0) | (F.col(step) == last))


def accumulated(micro: DataFrame, step: str, *metrics: str) -> DataFrame:
    """Means of the micro-batches of each step."""
    return micro.groupBy(step).agg(*(F.avg(m).alias(m) for m in metrics))


def sweep_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Rows (by, step, metric, value) to the last step's value of each metric."""
    return runs.groupBy(*by, "metric").agg(F.max_by("value", "step").alias("value"))


def log_probabilities(logits: Column) -> Column:
    z = F.transform(logits, lambda v: v.cast("double"))
    return F.transform(z, lambda v: v - log_sum_exp(z))


