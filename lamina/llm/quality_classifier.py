"""Quality classifier: a generalised additive model with pairwise interactions, scored by table lookups."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import AdditiveModel
from .common import slices, training_ids, training_rows

FEATURES = [
    "log_words", "mean_word", "distinct_words", "doubled_words", "distinct_pairs", "symbols", "exclamations", "capitals", "digits",
    "marks", "lone_separators", "repeated_lines", "log_line", "closed_lines", "other_bytes", "non_ascii", "first_share",
]
_upper, _lower, _digits = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_symbols, _marks = b"#*$%&|<>^~{}@_=+\\", b".,;:?"
_plain = _upper + _lower + _digits + b" \n'-!" + _marks + _symbols


def _holds(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def features(raw: bytes) -> list[float]:
    """Dense features of a whole text; all 0 for an empty one."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size, kinds = len(raw), len(set(words))
    up, low = _holds(raw, _upper), _holds(raw, _lower)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    doubled = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    high = size - len(raw.decode("utf-8", "ignore").encode("ascii", "ignore"))
    return [
        np.log1p(n), (size - n) / n, kinds / n, doubled / n, pairs / max(1, n - 1), _holds(raw, _symbols) / n, raw.count(b"!") / n, up / max(1, up + low),
        _holds(raw, _digits) / size, _holds(raw, _marks) / n, (words.count(b"|") + words.count(b">") + words.count(b"-")) / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), len(raw.translate(None, _plain)) / size - high / size, high / size, words.count(words[0]) / n,
    ]


def _feature_rows(extra: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                x = [features(t or b"") for t in part.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *(part.column(c) for c in extra)], ["x", *extra])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", folds: int = 4, held: int = 2, bound: int = 8000) -> AdditiveModel:
    """Fits on at most ``bound`` labelled rows outside the held-out fold; the driver gets their features alone.

    Of rows that repeat a doc_id one counts, the same in every run.
    """
    rows = training_rows(docs, training_ids(labels, label, folds, held, bound), text).select("text", F.col("doc_id").cast("long"), F.col("y").cast("int"))
    got = rows.mapInArrow(_feature_rows(["doc_id", "y"]), "x array<double>, doc_id long, y int").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, got.column("doc_id").to_numpy()))
    return AdditiveModel.fit(x[order], y[order])


def classify(docs: DataFrame, model: AdditiveModel, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1, higher: good likelier) and predicted (score >= ``threshold``) to ``keep`` columns.

    One pass, no shuffle. Null and empty texts have the score of all-zero features. Rows are kept as they
    come, repeated ones and null ids included. Columns named score or predicted can't be kept: an error.
    """
    keep = keep or ["doc_id"]
    if {"score", "predicted"} & set(keep):
        raise ValueError("columns named score or predicted can't be kept")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch, 0):
                x = np.array([features(t or b"") for t in part.column(0).cast(pa.binary()).to_pylist()], dtype=float)
                s = np.clip(m.score(x), 0, 1)
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
