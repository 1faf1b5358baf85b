"""Toxicity: boosted trees over dense features of a text, calibrated by an isotonic fit."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, isotonic
from .common import long_key, slices, training_ids, training_rows

# Words of the second person, and letters that other characters stand for.
SECOND_PERSON = ["dein", "deine", "dich", "dir", "du", "eres", "es-tu", "euch", "ihr", "te", "ti", "toi", "ton", "tu", "u", "ur", "usted", "vos", "votre", "vous", "ya", "you", "your", "you're", "yourself"]
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": "", "+": "t"}

FEATURES = [
    "strong", "log_strong", "strong_kinds", "weak", "hidden", "log_hidden", "near_second_person", "second_person", "capitals",
    "shouted_words", "exclamations", "questions", "symbols", "mixed_words", "log_words",
]
STEM = 5  # a word's first letters, with * behind, stand in the lexicons beside whole words

_word = re.compile(r"[^\W\d_]+")
_mixed = re.compile(r"[^\W\d_]+[0-9@$!*#+]+[^\W\d_]+[^\s]*")
_spaced = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_long = re.compile(r"([^\W\d_])\1{2,}")
_standing = str.maketrans(STANDS_FOR)
_you = frozenset(SECOND_PERSON)
_shouted = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ]{2,}(?![^\W\d_])")
_upper, _lower = bytes(range(65, 91)), bytes(range(97, 123))


def features(text: str, strong: frozenset, weak: frozenset) -> list[float]:
    """Lexicon densities, hidden spellings (figures and signs for letters, spaced or drawn-out words), second
    person within six words of a strong word, capitals, words of two or more capitals alone, and marks; all 0 for
    an empty text."""
    low = text.lower()
    words = _word.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in strong or w[:STEM] + "*" in strong]
    mixed = _mixed.findall(low)
    hidden = sum(_word.match(w.translate(_standing)) is not None and _word.match(w.translate(_standing))[0] in strong for w in mixed)
    hidden += sum("".join(filter(str.isalpha, w)) in strong for w in _spaced.findall(low)) if " " in low else 0
    hidden += sum(_long.sub(r"\1", w) in strong for w in words if len(w) > 4 and _long.search(w)) if _long.search(low) else 0
    near = sum(1 for i in hits if not _you.isdisjoint(words[max(0, i - 6) : i + 7]))
    raw = text.encode()
    up, small = len(raw) - len(raw.translate(None, _upper)), len(raw) - len(raw.translate(None, _lower))
    shouted = len(_shouted.findall(text)) if up > 1 else 0
    return [
        len(hits) / n, np.log1p(len(hits)), len({words[i] for i in hits}), sum(map(weak.__contains__, words)) / n, hidden / n, np.log1p(hidden), near / n,
        sum(map(_you.__contains__, words)) / n, up / max(1, up + small), shouted / n, text.count("!") / n, text.count("?") / n, (len(raw) - len(raw.translate(None, b"#*$%&@^~"))) / n, len(mixed) / n, np.log1p(n),
    ]


@dataclass
class ToxicityModel:
    strong: frozenset
    weak: frozenset
    trees: BoostedTrees
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t or "", self.strong, self.weak) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


def lexicons(rows: DataFrame, parts: int, strong_odds: float = 4.0, weak_odds: float = 2.5, least: int = 3) -> list[tuple[frozenset, frozenset]]:
    """Strong and weak words of the bounded training rows (text, y, part): without each part in turn, then of all.

    Words are kept by their log odds of standing in toxic documents, counted once a document. Strong words
    must also stand in one toxic document of two hundred. Words in ``least`` toxic documents or more
    all count, however rare; Spark drops those whose odds fall short, so the driver gets lexicons alone.
    """
    n = {(r["y"], r["part"]): r["n"] for r in rows.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = F.split(F.lower("text"), r"[^\p{L}]+")
    stems = F.transform(F.filter(own, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    words = rows.select("y", "part", F.explode(F.array_distinct(F.concat(own, stems))).alias("w")).where("w <> ''")
    sums = [F.sum(F.when((F.col("y") == y) & (F.col("part") == k), 1).otherwise(0)).alias(f"n{y}_{k}") for y in (0, 1) for k in range(parts)]
    passes = F.lit(False)
    for left in [*range(parts), None]:
        own = [k for k in range(parts) if k != left]
        good, bad = (sum(n.get((y, k), 0) for k in own) for y in (0, 1))
        t, c = (sum((F.col(f"n{y}_{k}") for k in own), F.lit(0)) for y in (1, 0))
        odds = F.log((t + 0.5) / (bad + 1)) - F.log((c + 0.5) / (good + 1))
        passes = passes | ((t >= least) & (odds >= weak_odds - 1e-9))  # the last digit is decided below
    top = words.groupBy("w").agg(*sums).where(passes).collect()
    out = []
    for left in [*range(parts), None]:
        own = [k for k in range(parts) if k != left]
        good, bad = (sum(n.get((y, k), 0) for k in own) for y in (0, 1))
        strong, weak = set(), set()
        for r in top:
            t, c = (sum(r[f"n{y}_{k}"] for k in own) for y in (1, 0))
            odds = np.log((t + 0.5) / (bad + 1)) - np.log((c + 0.5) / (good + 1))
            if t >= least and odds >= weak_odds:
                (strong if odds >= strong_odds and t * 200 >= bad else weak).add(r["w"])
        out.append((frozenset(strong), frozenset(weak)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", folds: int = 5, held: int = 0, bound: int = 8000, parts: int = 5) -> ToxicityModel:
    """Fits on at most ``bound`` labelled rows outside the held-out fold.

    Features of each of ``parts`` parts come from lexicons of the others, so that words which by chance stand
    in few toxic documents are seen to say little; margins for the isotonic fit come from trees grown
    without the part. The model itself has the lexicons and trees of all. Of rows that repeat a doc_id one counts, the
    same in every run.
    """
    rows = training_rows(docs, training_ids(labels, label, folds, held, bound), text).select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", F.col("y").cast("int").alias("y"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(parts)))
    words = lexicons(rows, parts)

    def run(batches):
        for batch in batches:
            for p in slices(batch, 0):
                x = [features(t, *words[k]) for t, k in zip(p.column(0).to_pylist(), p.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), p.column(1), p.column(2), p.column(3)], ["x", "doc_id", "y", "part"])

    got = rows.mapInArrow(run, "x array<double>, doc_id long, y int, part long").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got.column("doc_id").to_numpy()))
    x, y, part = x[order], got.column("y").to_numpy()[order].astype(float), got.column("part").to_numpy()[order]
    margin = np.zeros(len(y))
    for k in range(parts):
        margin[part == k] = BoostedTrees.fit(x[part != k], y[part != k]).margin(x[part == k])
    knots, values = isotonic(margin, y) if len(y) else (np.zeros(1), np.zeros(1))
    return ToxicityModel(*words[-1], BoostedTrees.fit(x, y), knots, values)


def classify(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: toxic likelier), predicted.

    One pass, no shuffle. Null and empty texts have the score of all-zero features. Rows are kept as they
    come, repeated ones and null ids included; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch):
                s = m.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(long_key(docs, key), F.col(text)).mapInArrow(run, "doc_id long, score double, predicted int")
