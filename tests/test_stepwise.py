"""Decoding with a state: the same rows as when every id's whole row is scored anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.tokens import EOT, START
from lamina.operators import generation

N_SEQ, IDS, WIDTH = 24, 14, 6


def recurrent():
    """Within a function, so that it goes to the workers by value."""
    n_ids, width = IDS, WIDTH

    class Recurrent:
        """A small recurrent network: its state is one vector a row."""

        def __init__(self):
            r = np.random.default_rng(4)
            self.inner, self.read, self.out = r.normal(0, 0.7, (width, width)), r.normal(0, 1.5, (n_ids, width)), r.normal(0, 1.2, (width, n_ids))

        def __call__(self, xs):
            """Logits at every place of whole rows."""
            h, z = np.zeros((len(xs), width)), np.zeros((*xs.shape, n_ids))
            for k in range(xs.shape[1]):
                h = np.tanh(h @ self.inner + self.read[xs[:, k]])
                z[:, k] = h @ self.out
            return z

        def begin(self, rows, lengths):
            h = np.zeros((len(rows), width))
            for k in range(rows.shape[1]):
                h = np.where((k < lengths)[:, None], np.tanh(h @ self.inner + self.read[rows[:, k]]), h)
            return h @ self.out, (h,)

        def step(self, state, ids):
            h = np.tanh(state[0] @ self.inner + self.read[ids])
            return h @ self.out, (h,)

    return Recurrent()


@pytest.mark.parametrize(("temperature", "most"), [(0.0, 9), (1.0, 9), (1.0, 40), (0.7, 1), (1.0, 0)])
def test_same_as_whole_rows(spark, temperature, most):
    r = np.random.default_rng(8)
    data = [(k, [*r.integers(10, IDS, int(r.integers(0, N_SEQ))).tolist(), START]) for k in range(90)]
    d = spark.createDataFrame(data, "key long, prompt array<int>").repartition(3, "key")
    model = recurrent()
    whole = generation.predict(d, model, N_SEQ, most, temperature=temperature, seed=3)
    steps = generation.predict_stepwise(d, model, N_SEQ, most, temperature=temperature, seed=3)
    got = {x["key"]: x["completion"] for x in steps.collect()}
    assert got == {x["key"]: x["completion"] for x in whole.collect()} and len(got) == 90
    if most > 1 and temperature:
        assert {len(x) for x in got.values()} - {most} and any(x[-1] == EOT for x in got.values())
    again = generation.predict_stepwise(d.repartition(7), model, N_SEQ, most, temperature=temperature, seed=3)
    assert got == {x["key"]: x["completion"] for x in again.collect()}


def test_bad_prompts(spark):
    d = spark.createDataFrame([(1, [10, 11])], "key long, prompt array<int>")
    with pytest.raises(Exception, match="one <START>"):
        generation.predict_stepwise(d, recurrent(), N_SEQ, 3).collect()
    assert generation.predict_stepwise(d.where(F.lit(False)), recurrent(), N_SEQ, 3).count() == 0
