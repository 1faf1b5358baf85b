"""Masked pseudo-likelihood: a bidirectional window network predicts every word's id from both sides, counts the word within its id."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, long_key, slices

SIDE, WIDTH, KINDS, EACH, OTHER = 2, 24, 32, 32, 128
N_IDS = KINDS * EACH  # frequent words have an id each; OTHER ids are shared by all other words, by hash
EDGE = N_IDS  # stands beyond a document's ends
OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
BATCH = 2048  # words whose tables of logits stay in a core's cache
PARTS, FAN = 32, 128  # parts of a table of pairs, and how many tasks' parts are added up at a time
STEPS, RATE, PRIOR = 120, 0.08, 30.0
START = 0.6  # the weight of each neighbour before it is fitted


@dataclass
class WindowNetwork:
    """Each of the ``2 * SIDE`` neighbours has WIDTH hidden units tanh(near[place, id]), and the units of all neighbours,
    weighed by ``weight``, feed a two-level softmax: log P(kind) + log P(place | kind) of the masked word's id."""

    near: np.ndarray  # 2 * SIDE, N_IDS + 1, WIDTH
    kind: np.ndarray  # WIDTH, KINDS
    place: np.ndarray  # WIDTH, N_IDS
    bias_kind: np.ndarray  # KINDS
    bias_place: np.ndarray  # N_IDS
    weight: np.ndarray  # 2 * SIDE

    @classmethod
    def new(cls, counts: np.ndarray, seed: int = 17) -> WindowNetwork:
        """Small random weights; biases are the log frequencies of the whole corpus."""
        r = np.random.default_rng(seed)
        p = (counts + 1.0).reshape(KINDS, EACH)
        bias = np.log(p.sum(1) / p.sum()), np.log(p / p.sum(1, keepdims=True)).ravel()
        shapes = (2 * SIDE, N_IDS + 1, WIDTH), (WIDTH, KINDS), (WIDTH, N_IDS)
        return cls(*(r.normal(0, s, shape).astype(np.float32) for s, shape in zip((0.5, 0.1, 0.1), shapes)), *(b.astype(np.float32) for b in bias), np.full(2 * SIDE, START))

    def loss(self, pairs: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of words given one neighbour at a time, over tables of pairs (neighbour's
        place, its id, the word's id), and its gradients by ``near``, ``kind`` and ``place``."""
        total, out, n = 0.0, [np.zeros_like(x) for x in (self.near, self.kind, self.place)], pairs.sum()
        for d, c in enumerate(pairs):
            h = np.tanh(self.near[d])
            by_kind = c.reshape(-1, KINDS, EACH).sum(2)
            p, q = h @ self.kind + self.bias_kind, (h @ self.place + self.bias_place).reshape(-1, KINDS, EACH)
            for z, axis in ((p, 1), (q, 2)):
                z -= z.max(axis, keepdims=True)
                z -= np.log(np.exp(z).sum(axis, keepdims=True))
            total -= float((by_kind * p).sum() + (c.reshape(q.shape) * q).sum())
            dp = np.exp(p) * by_kind.sum(1, keepdims=True) - by_kind
            dq = (np.exp(q) * by_kind[:, :, None]).reshape(c.shape) - c
            out[0][d] = (dp @ self.kind.T + dq @ self.place.T) * (1 - h * h) / n
            out[1] += h.T @ dp / n
            out[2] += h.T @ dq / n
        return total / float(n), out

    def fitted(self, pairs: np.ndarray, steps: int = STEPS, rate: float = RATE) -> WindowNetwork:
        """After ``steps`` steps down the full gradient, each parameter at a pace of its own (Adam)."""
        net = replace(self, near=self.near.copy(), kind=self.kind.copy(), place=self.place.copy())
        own = [net.near, net.kind, net.place]
        m, v = ([np.zeros_like(x) for x in own] for _ in range(2))
        for t in range(1, steps + 1):
            pace = rate * 0.5 * (1 + np.cos(np.pi * t / (steps + 1)))
            for x, g, a, b in zip(own, net.loss(pairs)[1], m, v):
                a += 0.1 * (g - a)
                b += 0.02 * (g * g - b)
                x -= pace * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.98**t)) + 1e-9)
        return net

    def tables(self) -> Tables:
        h = np.tanh(self.near)
        w = self.weight.astype(np.float32)[:, None, None]
        return Tables(w * (h @ self.kind), (w * (h @ self.place)).reshape(2 * SIDE, -1, EACH), self.bias_kind, self.bias_place.reshape(KINDS, EACH))


@dataclass
class Tables:
    """What each neighbour adds to the logits, looked up by its place and id (and the target's kind)."""

    kind: np.ndarray  # 2 * SIDE, N_IDS + 1, KINDS
    place: np.ndarray  # 2 * SIDE, (N_IDS + 1) * KINDS, EACH
    bias_kind: np.ndarray
    bias_place: np.ndarray

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target, which is masked: its neighbours alone are seen."""
        out, at = np.empty(len(target)), np.arange(BATCH)
        for a in range(0, len(target), BATCH):
            c, t = context[:, a : a + BATCH], target[a : a + BATCH].astype(np.int64)
            kinds, places = t // EACH, t % EACH
            p, q = self.kind[0].take(c[0], axis=0), self.place[0].take(c[0] * KINDS + kinds, axis=0)
            for d in range(1, 2 * SIDE):
                p += self.kind[d].take(c[d], axis=0)
                q += self.place[d].take(c[d] * KINDS + kinds, axis=0)
            p += self.bias_kind
            q += self.bias_place.take(kinds, axis=0)
            n = at[: len(t)]
            out[a : a + BATCH] = p[n, kinds] + q[n, places] - np.log(np.exp(p).sum(1) * np.exp(q).sum(1))
        return out

    def slope(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the summed log P(kind) by a factor of each neighbour's logits."""
        g, curve = np.zeros(2 * SIDE), np.zeros((2 * SIDE, 2 * SIDE))
        for a in range(0, len(target), BATCH // 2):
            c, kinds = context[:, a : a + BATCH // 2], target[a : a + BATCH // 2].astype(np.int64) // EACH
            f = np.stack([self.kind[d].take(c[d], axis=0) for d in range(2 * SIDE)])
            p = np.exp(f.sum(0) + self.bias_kind)
            p /= p.sum(1, keepdims=True)
            fp = f * p
            mean = fp.sum(2).astype(float)
            g += (f[:, np.arange(len(kinds)), kinds] - mean).sum(1)
            curve += fp.reshape(2 * SIDE, -1).astype(float) @ f.reshape(2 * SIDE, -1).astype(float).T - mean @ mean.T  # sums in doubles: the same in any order of batches
        return g, curve


class Vocabulary:
    """Ids of words: the most frequent have their own, all others share OTHER by hash."""

    def __init__(self, words: list[bytes]):
        self.own = {w: i for i, w in enumerate(words[: N_IDS - OTHER])}
        self.known = dict(self.own)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 300_000:
            known = self.known = dict(self.own)
        for w in set(words).difference(known):
            known[w] = N_IDS - OTHER + xxhash.xxh3_64_intdigest(w) % OTHER
        return np.fromiter(map(known.__getitem__, words), dtype=np.int16, count=len(words))


def lined(vocabulary: Vocabulary, texts: list[bytes | None]):
    """Ids of all words of some texts in a line with SIDE edges before, between and after texts; words' places in it;
    the words; each text's number of them."""
    docs = [(t or b"").lower().split() for t in texts]
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    words = list(chain.from_iterable(docs))
    at = np.arange(len(words)) + SIDE * np.repeat(np.arange(1, len(docs) + 1), lengths)
    line = np.full(len(words) + SIDE * (len(docs) + 1), EDGE, dtype=np.int16)
    line[at] = vocabulary(words)
    return line, at, words, lengths


def windows(line: np.ndarray, at: np.ndarray):
    """Contexts (by neighbour, then word) and targets."""
    return np.stack([line[at + d].astype(np.int64) for d in OFFSETS]), line[at]


def _count(batches):
    """Counts of words, kept small: what has gathered is handed on when there are many words."""
    n: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    for batch in batches:
        for part in slices(batch, 0):
            for t in part.column(0).cast(pa.binary()).to_pylist():
                n.update((t or b"").lower().split())
            if len(n) > 200_000:
                yield out()
                n.clear()
    yield out()


CELLS = (N_IDS + 1) ** 2
PAIRS = "distance long, part long, salt long, cell binary, n binary"


def _packed(distance: int, part: int, salt: int, n: np.ndarray) -> pa.RecordBatch:
    """The counts other than 0 of one part of a table."""
    cell = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (distance, part, salt)), *(pa.array([x.tobytes()], pa.binary()) for x in (cell.astype("<u4"), n[cell].astype("<i8")))], ["distance", "part", "salt", "cell", "n"])


def _pairs(words: list[bytes]):
    """How often one id stands so many places before another, in tables of all pairs, for the distances 1 to SIDE."""

    def run(batches):
        vocabulary, n = Vocabulary(words), np.zeros((SIDE, CELLS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                line = lined(vocabulary, part.column(0).cast(pa.binary()).to_pylist())[0].astype(np.int64)
                for k in range(1, SIDE + 1):
                    n[k - 1] += np.bincount(line[:-k] * (N_IDS + 1) + line[k:], minlength=CELLS)
        n[:, -1] = 0  # two edges
        salt = TaskContext.get().partitionId() // FAN
        for k in range(SIDE):
            for i, x in enumerate(np.array_split(n[k], PARTS)):
                if x.any():
                    yield _packed(k, i, salt, x)

    return run


def _add(t: pa.Table) -> pa.Table:
    n = np.zeros(CELLS // PARTS + 1, dtype=np.int64)
    for cell, m in zip(t.column("cell").to_pylist(), t.column("n").to_pylist()):
        n[np.frombuffer(cell, "<u4")] += np.frombuffer(m, "<i8")
    return pa.Table.from_batches([_packed(t["distance"][0].as_py(), t["part"][0].as_py(), t["salt"][0].as_py() // FAN, n)])


@dataclass
class LanguageModel:
    vocabulary: list
    network: WindowNetwork
    own: np.ndarray  # log of the mass of all words that share an id, but for the masked one; 0 for own ids
    floor: float  # the mass of a word that occurs nowhere else
    counts: DataFrame  # w, n: a written table of all words that occur more than once


def train(docs: DataFrame, text: str = "text") -> LanguageModel:
    """Learns from every word of every document.

    1. All words are counted. The frequent ones get ids of their own.
    2. Tables of how often each id stands one and two places before each other are added up over all tasks, in
       steps of ``FAN`` tasks, so the driver gets ``SIDE`` tables whatever the input's size. They say all that one
       neighbour says of a word. The network's weights are trained on them in numpy by full gradients;
       ``PRIOR`` words of the corpus's frequencies are added to each row, so that rare neighbours say little.
    3. One more pass over all words sums gradient and curvature of the likelihood given all neighbours by the
       neighbours' weights, for one Newton step.

    Sums of counts don't depend on partitions, and weights are rounded, so neither does the model.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text))
    with Scratch(spark) as scratch:
        counted = scratch.table(texts.mapInArrow(_count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")))
        top = [(bytes(r["w"]), r["n"]) for r in counted.orderBy(F.desc("n"), "w").limit(N_IDS - OTHER).collect()]

        def share(batches):
            import xxhash

            own = {w for w, _ in top}
            for batch in batches:
                w, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                ids = np.array([-1 if x in own else xxhash.xxh3_64_intdigest(x) % OTHER for x in w], dtype=np.int64)
                m = ids >= 0
                sums = [np.bincount(ids[m], x[m], OTHER) for x in (n, np.ones(len(n)), n == 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(OTHER)), *map(pa.array, sums)], ["id", "n", "kinds", "once"])

        rest = counted.mapInArrow(share, "id long, n double, kinds double, once double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n", "kinds", "once"))).collect()
        again = scratch.result(counted.where("n > 1"))
        words = [w for w, _ in top]
        added = texts.mapInArrow(_pairs(words), PAIRS)
        for _ in range(3):  # FAN ** 3 tasks
            added = added.groupBy("distance", "part", "salt").applyInArrow(_add, PAIRS)
        got = added.toArrow()
    counts, own = np.zeros(N_IDS), np.zeros(N_IDS)
    counts[: len(top)] = [n for _, n in top]
    n, kinds, once = (sum(r[c] for r in rest) for c in ("n", "kinds", "once"))
    floor = min(1.0, once * n / (kinds * (n - once))) if n > once > 0 else 1.0  # the likeliest mass of a word when each is left out in turn
    for r in rest:
        counts[N_IDS - OTHER + r["id"]] = r["n"]
        own[N_IDS - OTHER + r["id"]] = np.log(max(r["n"] - 1, 0) + floor * (r["kinds"] + 1))
    network = WindowNetwork.new(counts)
    if not got.num_rows:
        return LanguageModel(words, network, own, floor, again)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in np.array_split(np.empty(CELLS, bool), PARTS)])])
    table = np.zeros((SIDE, CELLS))
    for k, part, cell, n in zip(*(got.column(c).to_pylist() for c in ("distance", "part", "cell", "n"))):
        table[k, edges[part] + np.frombuffer(cell, "<u4")] += np.frombuffer(n, "<i8")
    table = table.reshape(SIDE, N_IDS + 1, N_IDS + 1)
    pairs = np.stack([table[-d - 1] if d < 0 else table[d - 1].T for d in OFFSETS])[:, :, :N_IDS]
    pairs += PRIOR * (counts / max(1, counts.sum()))
    network = network.fitted(pairs.astype(np.float32))
    held = spark.sparkContext.broadcast((words, network.tables()))

    def slopes(batches):
        own, tables = held.value
        vocabulary, sums = Vocabulary(own), np.zeros((2 * SIDE, 2 * SIDE + 1))
        for batch in batches:
            for part in slices(batch, 0):
                line, at, _, _ = lined(vocabulary, part.column(0).cast(pa.binary()).to_pylist())
                g, curve = tables.slope(*windows(line, at))
                sums += np.concatenate([g[:, None], curve], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.ravel()], columns)

    columns = [f"s{i}" for i in range(2 * SIDE * (2 * SIDE + 1))]
    sums = texts.mapInArrow(slopes, ", ".join(f"{c} double" for c in columns)).agg(*(F.sum(c) for c in columns)).first()
    sums = np.array([x or 0.0 for x in sums]).reshape(2 * SIDE, -1)
    step = np.linalg.solve(sums[:, 1:] + np.eye(2 * SIDE), sums[:, 0])
    return LanguageModel(words, replace(network, weight=np.round(START * np.clip(1 + step, 0, 3), 6)), own, floor, again)


def score(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_unseen, log_prob, mean_log_prob (natural logs).

    log_prob sums, over all words, the log-probability of the word given two words on either side and the rest
    of the corpus. Of a word that shares its id that is P(id) times its part of the id's words, both counted
    without the masked word itself: a word met nowhere else has the mass ``floor`` that makes the corpus
    likeliest, and n_unseen counts such words. Counts of words grow with the corpus: words meet them in a
    join by word, which no word fills, as the frequent ones have their own ids. Null and wordless texts: 0
    tokens, log_prob 0 and a null mean. Repeated rows and null ids are kept as they come; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.network.tables(), model.own))  # of fixed size

    def run(batches):
        own, tables, masses = held.value
        vocabulary, n = Vocabulary(own), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                line, at, words, lengths = lined(vocabulary, part.column(1).cast(pa.binary()).to_pylist())
                context, target = windows(line, at)
                p = tables.log_prob(context, target) - masses[target]
                total = np.diff(np.concatenate([[0], np.cumsum(p)])[np.concatenate([[0], np.cumsum(lengths)])])
                rid = np.arange(n, n + len(lengths))
                n += len(lengths)
                # a row for each text, whose w (with a space, so no word) has no count, then one for each word with a shared id
                w = pa.array([b" %d" % r for r in rid.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rid), part.column(0), pa.array(lengths), pa.array(total), w], names)
                other = np.flatnonzero(target >= N_IDS - OTHER)
                w = pa.array(words, pa.binary()).take(pa.array(other))
                rid = pa.array(np.repeat(rid, lengths)[other])
                yield pa.RecordBatch.from_arrays([rid, *[pa.nulls(len(other), t) for t in (pa.int64(), pa.int64(), pa.float64())], w], names)

    names = ["rid", "doc_id", "n_tokens", "log_prob", "w"]
    parts = docs.select(long_key(docs, key), F.col(text)).mapInArrow(run, "rid long, doc_id long, n_tokens long, log_prob double, w binary")
    parts = parts.join(model.counts.hint("shuffle_hash"), "w", "left")
    word = F.col("n_tokens").isNull()
    mass = F.sum(F.when(word, F.log(F.coalesce(F.col("n") - 1, F.lit(0)) + F.lit(model.floor))))
    out = parts.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("log_prob").alias("p"), mass.alias("own"), F.count_if(word & F.col("n").isNull()).alias("n_unseen"))
    out = out.withColumn("log_prob", F.col("p") + F.coalesce("own", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "n_unseen", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
