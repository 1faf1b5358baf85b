"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import long_key, one_row, remainder, slices

ORDER = 4
CACHE = 300_000
_run = re.compile(r"[^\W\d_]+")
_START, _END = 2, 3  # code points that stand for a word's edges
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str]):
    """For words put between edges: code of each place but a word's first, its word, and how far back its word starts."""
    flat = np.frombuffer("".join(f"{chr(_START)}{w}{chr(_END)}" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat, word, place


def _hashes(flat: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n characters that end at each place, for n from 1 to ``order`` (wrong where a word starts later)."""
    mixed = (flat + np.uint64(1)) * _PRIME
    mixed ^= mixed >> np.uint64(29)
    out = [mixed.copy()]
    for n in range(2, order + 1):
        h = out[-1].copy()
        h[n - 1 :] = (h[n - 1 :] + mixed[: len(mixed) - n + 1] * np.uint64(2 * n + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        out.append(h)
    return out


@dataclass
class CharacterModels:
    """Interpolated Kneser-Ney models of all languages over one union of n-grams.

    ``grams[n]`` is the sorted array of hashes of n-grams, ``prob[n]`` the probability of each one's last
    character after the rest by language, ``back[n]`` the weight that each one, as a history, leaves to
    the shorter history.
    """

    langs: list[str]
    order: int = ORDER
    grams: list = field(default_factory=list)
    prob: list = field(default_factory=list)
    back: list = field(default_factory=list)
    floor: np.ndarray | None = None
    sharpness: float = 20.0
    reject_score: float = 0.5
    reject_entropy: float = 99.0

    @classmethod
    def fit(cls, counts: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER) -> CharacterModels:
        """From each language's words and how often each occurs."""
        langs = sorted(counts)
        self = cls(langs, order)
        seen = [[] for _ in langs]  # per language and n: hashes, counts, and the histories' and suffixes' hashes
        letters = set()
        for k, lang in enumerate(langs):
            words, times = counts[lang]
            letters.update(*words)
            flat, word, place = _grams(words)
            h = _hashes(flat, order)
            for n in range(1, order + 1):
                ok = place >= n - 1
                u, first, inverse = np.unique(h[n - 1][ok], return_index=True, return_inverse=True)
                at = np.flatnonzero(ok)[first]
                raw = np.bincount(inverse, weights=np.asarray(times, dtype=float)[word[ok]])
                seen[k].append([u, raw, h[n - 2][at - 1] if n > 1 else None, h[n - 2][at] if n > 1 else None, place[at] == n - 1, flat[at] == _START])
            for n in range(order - 1, 0, -1):  # below the top: in how many ways an n-gram is preceded, unless it starts a word
                u, raw, _, _, starts, _ = seen[k][n - 1]
                ways = np.bincount(np.searchsorted(u, seen[k][n][3]), minlength=len(u))
                seen[k][n - 1][1] = np.where(starts, raw, ways)
        self.floor = np.full(len(langs), 1.0 / (len(letters) + 2))
        for n in range(1, order + 1):
            union = np.unique(np.concatenate([s[n - 1][0] for s in seen]))
            suffix = np.zeros(len(union), dtype=np.uint64)
            history = np.zeros(len(union), dtype=np.uint64)
            for s in seen:
                i = np.searchsorted(union, s[n - 1][0])
                if n > 1:
                    history[i], suffix[i] = s[n - 1][2], s[n - 1][3]
            prob = np.empty((len(union), len(langs)))
            if n > 1:
                lower = self.prob[n - 2][np.searchsorted(self.grams[n - 2], suffix)]
                back = np.ones((len(self.grams[n - 2]), len(langs)))
            for k, s in enumerate(seen):
                u, c, hist, _, _, is_start = s[n - 1]
                c = np.where(is_start, 0.0, c)
                once, two = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, once / max(1.0, once + 2.0 * two)))
                at = np.searchsorted(union, u)
                if n == 1:
                    total, kinds = c.sum(), (c > 0).sum()
                    p = np.full(len(union), discount * kinds / total * self.floor[k])
                    p[at] += np.maximum(c - discount, 0) / total
                    prob[:, k] = p
                    self.floor[k] *= discount * kinds / total
                else:
                    own = np.searchsorted(self.grams[n - 2], hist)
                    total = np.bincount(own, weights=c, minlength=len(back))
                    kinds = np.bincount(own, weights=c > 0, minlength=len(back))
                    left = np.divide(discount * kinds, total, out=np.ones(len(back)), where=total > 0)
                    back[:, k] = left
                    p = left[np.searchsorted(self.grams[n - 2], history)] * lower[:, k]
                    p[at] += np.maximum(c - discount, 0) / total[own]
                    prob[:, k] = p
            self.grams.append(union)
            self.prob.append(prob.astype(np.float32))
            if n > 1:
                self.back.append(back.astype(np.float32))
        return self

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Bits each language's model needs for each word, its end included: one row per word."""
        flat, word, place = _grams(words)
        h = _hashes(flat, self.order)
        out = np.zeros((len(words), len(self.langs)))
        p = found = None
        for n in range(1, self.order + 1):
            at = np.searchsorted(self.grams[n - 1], h[n - 1])
            at[at == len(self.grams[n - 1])] = 0
            hit = self.grams[n - 1][at] == h[n - 1]
            if n == 1:
                p = np.where(hit[:, None], self.prob[0][at], self.floor.astype(np.float32))
            else:
                ok = place >= n - 1
                hit &= ok
                shift = np.flatnonzero(ok)
                known = shift[found[shift - 1]]
                weight = np.ones_like(p)
                weight[known] = self.back[n - 2][before[known - 1]]
                p = np.where(hit[:, None], self.prob[n - 1][at], weight * p)
            before, found = at, hit
        live = place > 0
        bits = -np.log2(np.maximum(p[live], 1e-12))
        np.add.at(out, word[live], bits) if len(words) < 50 else None
        if len(words) >= 50:
            edge = np.flatnonzero(np.diff(word[live], prepend=-1))
            out = np.add.reduceat(bits, edge, axis=0)
        return out

    def scorer(self):
        """A function of texts: bits per character by language (NaN rows: no letter) and the characters."""
        known: dict[str, int] = {}
        costs = np.empty((CACHE, len(self.langs)), dtype=np.float32)

        def score(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal costs
            runs = [_run.findall(t.lower()) if t else [] for t in texts]
            if len(known) > CACHE // 2:
                known.clear()
            new = [w for w in set().union(*runs) if w not in known]
            if len(known) + len(new) > len(costs):
                costs = np.concatenate([costs, np.empty((len(new), len(self.langs)), dtype=np.float32)])
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                i = len(known)
                costs[i : i + len(part)] = self.word_costs(part)
                known.update(zip(part, range(i, i + len(part))))
            per, chars = np.full((len(texts), len(self.langs)), np.nan), np.zeros(len(texts))
            for i, own in enumerate(runs):
                if any(any(map(str.isalpha, w)) for w in own):
                    chars[i] = sum(map(len, own)) + len(own)
                    per[i] = costs[list(map(known.__getitem__, own))].sum(0, dtype=float) / chars[i]
            return per, chars

        return score

    def posterior(self, per: np.ndarray) -> np.ndarray:
        z = -self.sharpness * (per - per.min(1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def calibrate(self, per: np.ndarray, truth: np.ndarray) -> None:
        """Sharpness by likelihood over held-back rows, and limits beyond which a prediction is rejected."""
        if not len(per):
            return
        best = max((np.log(np.maximum(self._with(s).posterior(per)[np.arange(len(per)), truth], 1e-9)).sum(), -s) for s in (1, 2, 4, 8, 16, 32))
        self.sharpness = -best[1]
        p, right = self.posterior(per), per.argmin(1) == truth
        order = np.argsort(-p.max(1), kind="stable")
        precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= 0.98)
        self.reject_score = float(min(0.9, p.max(1)[order][good[-1]])) if len(good) else 0.9
        self.reject_entropy = float(np.quantile(per.min(1), 0.99) * 1.25)

    def _with(self, sharpness: float) -> CharacterModels:
        from dataclasses import replace

        return replace(self, sharpness=sharpness)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 500, folds: int = 4, held: int = 2, order: int = ORDER, seed: int = 3) -> CharacterModels:
    """Fits on at most ``per_language`` whole documents of each language outside the held-out fold.

    Four fifths of them give word counts for the models, the rest sharpness and the rejection limits.
    Of rows that repeat a doc_id one counts, the same in every run. Executors count words; the driver gets the distinct
    words of the bounded sample.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder("doc_id", folds) != held)).select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"))
    h = F.xxhash64("doc_id", F.lit(seed))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("count"))
    thin = F.least(F.lit(1.0), F.lit(1.5 * per_language) / F.col("count"))
    chosen = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(F.pmod(h, F.lit(1_000_000)) < thin * 1_000_000)
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))).where(F.col("r") <= per_language)
    chosen = chosen.select("doc_id").distinct()  # at most per_language rows a language
    sample = one_row(rows.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", ["lang", "text"]).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) > 0)
    words = sample.where("fit").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").groupBy("lang", "w").count().toArrow()
    table = {}
    for name in words.column("lang").unique().to_pylist():
        own = words.filter(pa.compute.equal(words.column("lang"), name)).sort_by("w")
        table[name] = (own.column("w").to_pylist(), own.column("count").to_numpy())
    if not table:
        return CharacterModels([])
    model = CharacterModels.fit(table, order)

    def score(batches):
        f = model.scorer()
        for batch in batches:
            for part in slices(batch):
                per, _ = f(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(per.tolist(), pa.list_(pa.float64()))], ["lang", "per"])

    held_back = sample.where("not fit").select("lang", "text").mapInArrow(score, "lang string, per array<double>").toArrow()
    per = np.array(held_back.column("per").to_pylist(), dtype=float).reshape(-1, len(model.langs))
    truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in held_back.column("lang").to_pylist()], dtype=int)
    ok = ~np.isnan(per).any(1) & (truth >= 0)
    order_ = np.lexsort(per[ok].T)  # the same whatever order the rows came in
    model.calibrate(per[ok][order_], truth[ok][order_])
    return model


def identify(docs: DataFrame, model: CharacterModels, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, entropy (bits per character), rejected.

    The language is that of lowest cross-entropy per character over all words of the text, the first by
    name at a tie. ``und`` with score 0 where text is null or has no letter, or no language was learned.
    ``rejected`` marks predictions below the calibrated score or above the calibrated entropy. Repeated rows
    and null ids are kept as they come; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches):
        m = held.value
        f = m.scorer() if m.langs else None
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                n = len(texts)
                lang, score, entropy, out = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, dtype=bool)
                if f:
                    per, _ = f(texts)
                    ok = np.flatnonzero(~np.isnan(per[:, 0]))
                    best = per[ok].argmin(1)
                    score[ok] = m.posterior(per[ok]).max(1) if len(ok) else 0
                    entropy[ok] = per[ok].min(1) if len(ok) else 0
                    out[ok] = (score[ok] < m.reject_score) | (entropy[ok] > m.reject_entropy)
                    for i, b in zip(ok.tolist(), best.tolist()):
                        lang[i] = m.langs[b]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(out)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(long_key(docs, key), F.col(text)).mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")
