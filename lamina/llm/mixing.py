"""Mixing sources to target weights by fitting budgets over histograms of document lengths."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, ranked

#: Words of a budget that are left to the dynamic programme at first, and the most that it ever fits.
RESIDUE, WINDOW = 4096, 60_000


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Shares of the total by weight, in code-point order with null last; excess over ``most`` times a source's size is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = Fraction(sum(sizes.values())), {}, list(order)
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: float(each * weight[s]) for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        free = [s for s in free if s not in set(full)]
    return out


def in_proportion(lengths: np.ndarray, counts: np.ndarray, budget: int, rng) -> np.ndarray:
    """Of each length about the same share of its documents, as whole numbers: every 1/share-th document in the order
    of lengths, from a random start. Sums of lengths miss the budget by less than the longest document."""
    edge = np.concatenate([[0], np.cumsum(counts)]) * (budget / int((lengths * counts).sum()))
    take = np.diff(np.floor(edge + rng.random()).astype(np.int64))
    return np.minimum(take, counts)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW, residue: int = RESIDUE, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that the lengths add up to ``budget`` as nearly as may be.

    All of the budget but ``residue`` words is dealt in proportion over the lengths. A sum that is too large gives
    back one document, one that is far too small takes the longest that fit. What is then left, at most
    ``window`` words, is fitted by bounded-knapsack dynamic programming over the remaining counts: the
    reachable sum nearest below, lengths tried in a seeded order so that no kind is preferred. A budget of at
    most ``residue`` words is fitted by the programme alone, so its sum is the best there is. Where no remaining
    document fits into what is left, nothing more is taken.
    """
    take, rng = np.zeros(len(lengths), dtype=np.int64), np.random.default_rng(seed)
    counts = np.where(lengths > 0, counts, 0)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts
    if budget > residue:
        take = in_proportion(lengths, counts, budget - residue, rng)
    left = budget - int((take * lengths).sum())
    while left < 0:  # the shortest document that makes up for it, or the longest taken
        own = np.flatnonzero(take)
        enough = own[lengths[own] >= -left]
        i = enough[lengths[enough].argmin()] if len(enough) else own[lengths[own].argmax()]
        take[i] -= 1
        left += int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        if (n := min(int(counts[i] - take[i]), (left - window + int(lengths[i]) - 1) // max(1, int(lengths[i])), left // max(1, int(lengths[i])))) > 0:
            take[i] += n
            left -= n * int(lengths[i])
    if left > window:  # every remaining document is longer than what is left
        return take
    # reach[s]: index of the length whose copies first made the sum s; used[s]: how many of them
    reach = np.full(left + 1, -1, dtype=np.int64)
    used = np.zeros(left + 1, dtype=np.int64)
    reach[0] = len(lengths)
    for i in rng.permutation(np.flatnonzero((lengths <= left) & (counts > take))):
        if reach[left] >= 0:
            break
        size, n = int(lengths[i]), int(counts[i] - take[i])
        done, step = 0, 1
        while done < n and reach[left] < 0 and (k := min(step, n - done)) * size <= left:  # copies in doubling parcels
            to = np.flatnonzero(reach[: left + 1 - k * size] >= 0) + k * size
            to = to[reach[to] < 0]
            reach[to], used[to] = i, k
            done, step = done + k, step * 2
    s = int(np.flatnonzero(reach >= 0)[-1])
    while s > 0:
        i, k = int(reach[s]), int(used[s])
        take[i] += k
        s -= k * int(lengths[i])
    return take


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(5, 2, 1), most: int = 3, seed: int = 11, carry: tuple = ()) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, and the columns ``carry``.

    The driver gets one row per source, so sources must be fewer than some million. Each source's histogram of exact lengths (not its documents) is one
    task's work: whole copies of the source as far as the target holds them, then ``fit_budget``. The chosen
    number of documents of each source and length are those of lowest rank in a seeded order, and no group
    is ranked in one task.

    Null text has size 0; documents of size 0 are never taken. A null source is a source. Repeated rows are
    documents of their own. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
        tag = F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source)))
        rows = scratch.table(docs.select(F.col(key).alias("doc_id"), tag.alias("tag"), size.alias("size"), *carry))
        hist = scratch.table(rows.groupBy("tag", "size").count())
        sums = {r["tag"]: int(r["n"]) for r in hist.groupBy("tag").agg(F.sum(F.col("size") * F.col("count")).alias("n")).collect()}
        name = {t: None if t == "0" else t[1:] for t in sums}
        goal = targets({name[t]: n for t, n in sums.items()}, weights, most)
        per_source = spark.createDataFrame([(t, n, goal[name[t]]) for t, n in sums.items()], "tag string, source_size long, target double")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            want, have = round(float(pdf["target"].iloc[0])), int(pdf["source_size"].iloc[0])
            whole = min(want // have, most) if have else 0
            pdf = pdf.sort_values("size")
            take = fit_budget(pdf["size"].to_numpy(), pdf["count"].to_numpy(), want - whole * have if whole < most else 0, seed=seed)
            return pdf.assign(whole=whole, quota=take)

        fitted = hist.join(per_source, "tag").groupBy("tag").applyInPandas(fit, "tag string, size long, count long, source_size long, target double, whole long, quota long")
        out = ranked(rows, ["tag", "size"], scratch.table(fitted), rows.count(), seed, ["doc_id"])
        copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("rank") < F.col("quota")).cast("long")).otherwise(F.lit(0).cast("long"))
        out = out.withColumn("copies", copies)
        return scratch.result(out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *carry))
