"""The registered queries over sf0.001, and the models' scores, against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import boosting, language_id, mixing, registry, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def run(spark, name):
    df = registry.QUERIES[name](spark, SF)
    return df, {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize(("name", "n", "held", "limit"), [("op7_quality_classifier", 4, 2, 0.7), ("op10_toxicity", 5, 0, 0.5)])
def test_classifiers(spark, documents, name, n, held, limit):
    df, got = run(spark, name)
    assert [f"{c} {t}" for c, t in df.dtypes] == ["doc_id bigint", "held_out boolean", "score double", "predicted int"]
    assert sorted(got) == [r["doc_id"] for r in documents]
    for i, r in got.items():
        assert r["held_out"] == (fold(i, n) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)


def test_language(spark, documents):
    df, got = run(spark, "op1_language_id")
    assert [f"{c} {t}" for c, t in df.dtypes][:4] == ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"]
    known = {r["lang"] for r in documents} - {None}
    for r in documents:
        g = got[r["doc_id"]]
        assert g["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= g["score"] <= 1
        assert g["lang_pred"] in known if any(map(str.isalpha, r["text"] or "")) else g["lang_pred"] == "und"


def test_near(spark, documents):
    _, got = run(spark, "op3_near_dedup")
    sets = {}
    for r in documents:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}


def test_mixing(spark, documents):
    _, got = run(spark, "op4_mixing")
    sums = defaultdict(int)
    for r in documents:
        sums[r["source"]] += len((r["text"] or "").encode().split())
    goal = mixing.targets(dict(sums))
    taken = defaultdict(int)
    for r in documents:
        g = got[r["doc_id"]]
        n = len((r["text"] or "").encode().split())
        assert g["size"] == n and g["source_size"] == sums[r["source"]] and g["target"] == goal[r["source"]] and 0 <= g["taken"] <= 3 * n
        taken[r["source"]] += g["taken"]
    for s, t in goal.items():
        copies = [(n, got[r["doc_id"]]["taken"] // n) for r in documents if r["source"] == s and (n := len((r["text"] or "").encode().split()))]
        rest = [n for n, k in copies if k == min(k for _, k in copies) and k < 3]
        assert -0.5 <= t - taken[s] and (t - taken[s] <= 0.5 or min(rest, default=1e9) > t - taken[s] - 0.5)  # nothing that fits is left out


def test_targets_by_definition():
    """Shares by weight, those above three times a source's size cut and shared again, until none is."""
    r = np.random.default_rng(3)
    for _ in range(50):
        sizes = {f"s{i}": int(x) for i, x in enumerate(r.integers(1, 1000, int(r.integers(1, 9))) ** 2)}
        got = mixing.targets(sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values()) and all(got[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
        free = [s for s in sizes if got[s] < 3 * sizes[s] - 1e-6]
        each = {round(got[s] / weight[s], 6) for s in free}
        assert len(each) <= 1 and all(3 * sizes[s] <= weight[s] * max(each, default=0) + 1e-6 for s in sizes if each and s not in free)


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.tokenizer_path())
    rows = registry.QUERIES["op5_packing"](spark, SF).collect()
    want = Counter()
    for r in documents:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for a in range(0, len(ids), 2048):
            want[r["doc_id"], a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    ends = defaultdict(list)
    for r in rows:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    assert 2048 * len(ends) < 1.02 * sum(r["length"] for r in rows) + 2048


def test_scoring(spark, documents):
    df, got = run(spark, "op8_lm_scoring")
    n = Counter(w for r in documents for w in (r["text"] or "").encode().lower().split())
    frequent = {w for w, _ in sorted(n.items(), key=lambda p: (-p[1], p[0]))[:896]}
    for r in documents:
        own = (r["text"] or "").encode().lower().split()
        assert got[r["doc_id"]]["n_tokens"] == len(own) and got[r["doc_id"]]["n_unseen"] == sum(n[w] == 1 and w not in frequent for w in own)


def kneser_ney(counts, order, letters):
    """Probability of a character after a history, straight from the definition, with words between edges."""
    start, end = chr(language_id._START), chr(language_id._END)
    raw = [Counter() for _ in range(order + 1)]
    for w, times in zip(*counts):
        s = start + w + end
        for n in range(1, order + 1):
            for i in range(len(s) - n + 1):
                raw[n][s[i : i + n]] += int(times)
    c = [None] * (order + 1)
    c[order] = raw[order]
    for n in range(1, order):
        ways = Counter(g[1:] for g in raw[n + 1])
        c[n] = {g: raw[n][g] if g[0] == start else ways[g] for g in raw[n]}
    c[1] = {g: 0 if g == start else x for g, x in c[1].items()}

    def discount(n):
        one, two = sum(x == 1 for x in c[n].values()), sum(x == 2 for x in c[n].values())
        return min(0.95, max(0.1, one / max(1.0, one + 2.0 * two)))

    def p(ch, history):
        n = len(history) + 1
        d = discount(n)
        own = {g: x for g, x in c[n].items() if g[:-1] == history and x > 0}
        total = sum(own.values())
        lower = p(ch, history[1:]) if history else 1.0 / (len(letters) + 2)
        if not total:
            return lower
        return max(own.get(history + ch, 0) - d, 0) / total + d * len(own) / total * lower

    return p


def test_kneser_ney_by_definition():
    r = np.random.default_rng(6)
    data = {}
    for lang, letters in (("x", "abcd"), ("y", "bcde")):
        words = sorted({"".join(r.choice(list(letters), int(r.integers(1, 6)))) for _ in range(40)})
        data[lang] = (words, r.integers(1, 9, len(words)))
    order, every = 4, set("".join(w for words, _ in data.values() for w in words))
    model = language_id.CharacterModels.fit(data, order)
    start, end = chr(language_id._START), chr(language_id._END)
    tried = ["abc", "bcd", "e", "zq", "aab", "dede", "bz", *data["x"][0][:5]]
    got = model.word_costs(tried)
    for k, lang in enumerate(model.langs):
        p = kneser_ney(data[lang], order, every)
        for i, w in enumerate(tried):
            s = start + w + end
            bits = -sum(np.log2(p(s[j], s[max(0, j - order + 1) : j])) for j in range(1, len(s)))
            assert abs(bits - got[i, k]) < 1e-3 * max(1, bits), (lang, w)


def test_tables_and_trees_by_hand():
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(300, 4)), 2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    m = boosting.AdditiveModel.fit(x, y)
    place = lambda edges, v: sum(v >= e for e in edges)
    for row, s in list(zip(x, m.score(x)))[:40]:
        z = m.base + sum(t[place(m.edges[f], row[f])] for f, t in enumerate(m.tables)) + sum(t[place(m.coarse[f], row[f]), place(m.coarse[q], row[q])] for f, q, t in m.pairs)
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-9
    assert {(0, 1)} <= {(f, q) for f, q, _ in m.pairs} and ((m.score(x) > 0.5) == y).mean() > 0.85
    t = boosting.BoostedTrees.fit(x, y)
    for row, s in list(zip(x, t.margin(x)))[:40]:
        z = t.base
        for levels, leaf in t.trees:
            node = 0
            for feature, cut in levels:
                node = 2 * node + (place(t.edges[feature[node]], row[feature[node]]) > cut[node])
            z += leaf[node]
        assert abs(z - s) < 1e-9


def test_isotonic_by_definition():
    r = np.random.default_rng(8)
    z = np.round(r.normal(size=60), 1)
    y = (r.random(60) < boosting.sigmoid(z)).astype(float)
    knots, values = boosting.isotonic(z, y)
    u = np.unique(z)
    for i, at in enumerate(u):
        want = max(min(y[(z >= u[a]) & (z <= u[b])].mean() for b in range(i, len(u))) for a in range(i + 1))
        assert abs(np.interp(at, knots, values) - want) < 1e-9


def test_toxicity_scores_by_hand(spark):
    """A model's score is the isotonic value of its trees' margin over the features of the whole text."""
    trees = boosting.BoostedTrees([np.array([0.1]) for _ in toxicity.FEATURES], 0.0, [([(np.array([0]), np.array([0]))], np.array([-1.0, 2.0]))])
    model = toxicity.ToxicityModel(frozenset({"idiot"}), frozenset(), trees, np.array([-1.0, 2.0]), np.array([0.1, 0.9]))
    long = "fine words " * 40_000 + "idiot"
    data = [(1, "you idiot"), (2, "fine"), (3, None), (4, ""), (None, "idiot idiot"), (1, "you idiot"), (5, long)]
    got = toxicity.classify(spark.createDataFrame(data, "doc_id long, text string"), model)
    want = {(1, 0.9): 2, (2, 0.1): 1, (3, 0.1): 1, (4, 0.1): 1, (None, 0.9): 1, (5, 0.1): 1}
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in got.collect()) == Counter(want)
    assert got.where(F.col("predicted") != (F.col("score") >= 0.5).cast("int")).count() == 0
