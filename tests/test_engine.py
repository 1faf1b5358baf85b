"""Goldens and invariants of the engine's operators."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import queries
from lamina.functions import atoms as A
from lamina.functions import tokens as T
from lamina.operators import batches as B
from lamina.operators import chain, demos, metrics, rollout, schema_match, unify
from lamina.plans import banks, generate
from lamina.sources import banks as bank_files

SPEC = banks.BankSpec(n_layers=6, predicates_per_layer=4, rules_per_transition=6, arity=(1, 2), variables=3, constants=("a", "b", "c"), k_in=(1, 2), k_out=(1, 2))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_clause_round_trip(spark):
    text = "r0_1(a,b) ∧ r0_2(b,c) → r1_1(a,c) ∧ r1_2(c,c)"
    c = A.parse_clause(F.lit(text))
    assert one(spark, A.clause_text(c["lhs"], c["rhs"])) == text
    s = one(spark, A.parse_sequent(F.lit("r0_1(a,b),r0_2(b,c)⊢r1_1(a,c)")))
    assert len(s["ants"]) == 2 and s["cons"]["predicate"] == "r1_1"
    assert one(spark, A.parse_atom(F.lit("p(c0, d1,e2)")))["args"] == ["c0", "d1", "e2"]  # names may end in their place
    for bad in ("a(b", "a → b → c", "a ∧ → b", "", "1a → b"):
        assert one(spark, A.parse_clause(F.lit(bad))) is None


def test_ranks_of_the_four_kinds(spark):
    bank = unify.bank(spark, ["A → M", "A → N", "C → M", "C → N", "M → G", "N → X"], [0, 0, 0, 0, 1, 1])
    facts = unify.facts_of(spark.createDataFrame([(1, [("A", []), ("B", [])])], f"qid long, atoms array<{A.ATOM_TYPE}>"))
    got = {r["rule_id"]: r["rank"] for r in chain.rank_rules(facts, bank, "G", 1, 3).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    reach = {r["rule_id"]: r["reaches"] for r in chain.goal_reachable(bank, "G", 3).collect()}
    assert reach == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_footrule_and_medoids(spark):
    v = spark.createDataFrame([(0, [4, 3, 1, 2, 5, 5]), (1, [5, 3, 1, 5, 2, 4])], "vec_id long, v array<int>")
    d = {(r["i"], r["j"]): r["d"] for r in demos.distances(v, v).collect()}
    assert d == {(0, 0): 0, (0, 1): 8, (1, 0): 8, (1, 1): 0}
    w = spark.createDataFrame([(0, [0]), (1, [1]), (2, [10]), (3, [11])], "vec_id long, v array<int>")
    _, m = demos.k_medoids(w, [0, 1])
    assert len(m) == 2 and m[0] in (0, 1) and m[1] in (2, 3)


def test_medoids_count_every_member(spark):
    """A cluster of 2500, whose first 2000 ids would draw the medoid to 0, and an empty cluster, against brute force."""
    x = np.array([[0 if i < 1240 else 10, i % 7] for i in range(2500)] + [[900, 0], [900, 0], [900, 2]])
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, v array<int>")
    d = np.abs(x[:, None] - x[None]).sum(2)
    medoids = [3, 2500, 2501]  # the last two are equal, so the last cluster is empty
    _, got = demos.k_medoids(v, medoids, rounds=1)
    best = d[medoids].argmin(0)
    want = []
    for k, m in enumerate(medoids):
        own = np.flatnonzero(best == k)
        want.append(int(own[d[np.ix_(own, own)].sum(1).argmin()]) if len(own) else m)
    assert len(np.flatnonzero(best == 0)) == 2500 and x[want[0], 0] == 10
    assert got == sorted(want)


def test_orders_and_vectors(spark):
    r = spark.createDataFrame([(1, i + 1, k) for i, k in enumerate([3, 1, 4, 2])], "qid long, rule_id long, rank int")
    ranks = [x["rank"] for x in demos.order_demos(r, float("inf"), "s").orderBy("place").collect()]
    assert ranks == [4, 3, 2, 1]
    shuffled = {tuple(x["rank"] for x in demos.order_demos(r, 0, str(s)).orderBy("place").collect()) for s in range(4)}
    assert len(shuffled) > 1
    d = spark.createDataFrame([(1, 4, 1), (1, 3, 2), (1, 1, 3)], "qid long, rule_id int, place int")
    assert demos.ranking_vectors(d, 4, 4).first()["v"] == [3, 4, 2, 1]


def test_high_alpha_prefers_rank_one(spark):
    r = spark.createDataFrame([(q, i, k) for q in range(100) for i, k in ((1, 1), (2, 4))], "qid long, rule_id long, rank int")
    n = demos.sample_distinct(demos.rank_weights(r, 10.0), 1, "x").where("rank = 1").count()
    assert n > 90


def test_curricula():
    phases = B.exponential_phases(1, 4, 100, 2.0)
    depth = lambda p, s: [d for at, d in p if at <= s][-1]
    assert [depth(phases, s) for s in (0, 100, 300, 700)] == [1, 2, 3, 4]
    manual = [(0, 2), (500, 4), (2000, 8)]
    assert [depth(manual, s) for s in (499, 500, 1999, 2000)] == [2, 4, 4, 8]


def test_phase_must_start_at_zero(spark):
    with pytest.raises(ValueError):
        B.with_phase(spark.range(3).withColumnRenamed("id", "step"), [(1, 2)])


def test_masked_loss_of_nothing_is_null(spark):
    t = spark.createDataFrame([([0.1, 0.2], 0)], "logits array<double>, label int")
    assert metrics.masked_loss(t).first()["masked_ce"] is None


@pytest.mark.parametrize(("p", "n", "where"), [(0.3, 5, None), (0.9, 3, 0), (0.01, 3, 2)])
def test_exit_distribution(spark, p, n, where):
    h = spark.createDataFrame([(1, t, p) for t in range(n)], "row_id long, t int, halt_prob double")
    q = [r["exit_prob"] for r in metrics.exit_distribution(h, "row_id", "t").orderBy("t").collect()]
    assert abs(sum(q) - 1) < 1e-9
    if where is not None:
        assert q[where] > 0.8


def test_structure_but_not_names(spark):
    bank = unify.bank(spark, ["r0_1(x1,x2) → r1_1(x1)"])
    rules = unify.bank(spark, ["r0_8(a,b) → r1_9(a)", "r0_8(a,b) → r1_9(b)", "r0_8(a) → r1_9(a)"]).withColumnRenamed("rule_id", "key")
    assert {r["key"]: r["matched"] for r in schema_match.schema_matches(rules, bank).collect()} == {1: True, 2: False, 3: False}


def test_bank_invariants_and_round_trip(spark, tmp_path):
    for seed in range(5):
        bank = banks.build(SPEC, seed)
        for _, k, (lhs, rhs) in bank.rules:
            assert {t for _, a in rhs for t in a} <= {t for _, a in lhs for t in a}
            assert {p for p, _ in lhs} <= set(bank.layers[k]) and {p for p, _ in rhs} <= set(bank.layers[k + 1])
            assert len({p for p, _ in lhs}) == len(lhs)
    path = f"file://{tmp_path}/bank"
    bank_files.save(spark, bank, path)
    assert bank_files.load(spark, path).to_json() == bank.to_json()
    assert bank_files.load_rules(spark, path).count() == len(bank.rules)
    with pytest.raises(ValueError):
        banks.Bank.from_json('{"version": 99}')
    with pytest.raises(ValueError):
        banks.BankSpec(constants=("x1",))


def test_pairs_and_pools():
    a, b = banks.build_depth3_pair(banks.BankSpec(n_layers=3, predicates_per_layer=4, rules_per_transition=8, variables=4, constants=("a", "b"), k_in=(1, 2), k_out=(1, 2)), 1)
    assert not set(a.layers[0]) & set(b.layers[0]) and a.of(1) == b.of(1)
    hybrid, split = banks.build_hybrid(banks.build(SPEC, 2), 3)
    assert all(not set(t) & set(e) for t, e in zip(split["train"], split["eval"]))
    assert {p for p, _, _ in hybrid.rules} == {"base", "train", "eval_rule", "eval_pred"}


def test_problems_are_derivations(spark, tmp_path):
    bank = banks.build(SPEC, 13)
    steps = generate.problems(spark, bank, [1, 3], 20, seed=13, parts=3)
    rows = sorted(steps.collect())
    assert len(rows) == 20 * 1 + 20 * 3
    assert rows == sorted(generate.problems(spark, bank, [1, 3], 20, seed=13, parts=5).collect())
    with pytest.raises(ValueError):
        generate.problems(spark, bank, [6], 1, seed=1)
    path = f"file://{tmp_path}/set"
    generate.write_dataset(steps, path, 10, {"seed": 13})
    assert generate.read_dataset(spark, path, [3]).count() == 60
    with pytest.raises(ValueError):
        generate.read_dataset(spark, path, [2])


def test_tokens_round_trip(spark):
    vocab = dict(T.SPECIAL) | {"a": 10, "b": 11, "r": 12, "0": 13, "1": 14, "_": 15}
    names = T.id_map({v: k for k, v in []} or {"x": 1})
    c = A.parse_clause(F.lit("r0_1(a,b) → r1_1(a,b)"))
    ids = T.to_ids(T.completion_tokens(F.array(T.clause_tokens(c["lhs"], c["rhs"]))), T.id_map(vocab))
    names = F.create_map(*[F.lit(x) for k, v in vocab.items() for x in (v, k)])
    assert one(spark, T.to_text(ids, names)) == "r0_1(ab)→r1_1(ab)"
    got = one(spark, ids)
    assert got[-1] == T.EOT and got.count(T.SEP) == 0


def test_batches_cover_rows_once(spark):
    rows = B.shuffled_batches(spark.range(100), "id", 8, 1).collect()
    assert len({r["id"] for r in rows}) == len(rows) == 96
    assert sorted((r["batch_id"], r["row_idx"]) for r in rows) == [(b, i) for b in range(12) for i in range(8)]
    other = {r["id"]: r["batch_id"] for r in B.shuffled_batches(spark.range(100), "id", 8, 1, epoch=1).collect()}
    assert other != {r["id"]: r["batch_id"] for r in rows}


def test_stream_drains(spark):
    from lamina.streaming.online import problem_stream

    q = problem_stream(spark, banks.build(SPEC, 13), 2, 5, 20).writeStream.format("memory").queryName("steps").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.sql("SELECT count(*) AS n FROM steps").first()["n"]:
                break
        rows = spark.sql("SELECT problem_id, count(*) AS n FROM steps GROUP BY 1").collect()
        assert rows and all(r["n"] == 2 for r in rows)
    finally:
        q.stop()


def test_segments(spark):
    assert one(spark, T.segments(F.array(*map(F.lit, [1, 2, 7, 3, 0])))) == [[1, 2], [3]]
    assert one(spark, T.next_power(F.lit(1025))) == 2048 and one(spark, T.next_power(F.lit(1024))) == 1024
    assert np.isclose(one(spark, metrics.nll(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1))), np.log(2))


def test_length_bounds_by_hand(spark):
    bank = unify.bank(spark, ["r0_1(x1,x2) ∧ r0_2(x2) → r1_1(x1)"])
    arities = spark.createDataFrame([("r0_1", 2), ("r0_2", 1), ("r1_1", 1)], "predicate string, arity int")
    # the longest atom is r 0 _ 1 ( a a ), 8 tokens; the clause has 8 + 1 + 7 + 1 + 7 = 24
    plain = T.length_bounds(bank, arities, 3).first()
    assert tuple(plain) == (8, 3 * 8 + 2 + 1 + 8 + 1, 25, 36 + 25 - 1)
    full = T.length_bounds(bank, arities, 3, n_demos=2, fresh=(2, 2), steps=3).first()
    assert tuple(full) == (8, 36 + 2 * (37 + 1), 36 * 3 + 2 + 1, 112 + 111 - 1)


def test_medoid_nearest_to_the_query(spark):
    shape = "qid int, rule_id int, place int"
    pool = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 3, 1), (3, 4, 2), (4, 3, 1), (4, 4, 2)], shape)
    own = spark.createDataFrame([(7, 3, 1), (7, 4, 2), (8, 2, 2), (8, 1, 1)], shape)
    ranks = spark.createDataFrame([(7, 3, 2), (8, 1, 1), (8, 2, 3)], "qid int, rule_id int, rank int")
    got = {(r["qid"], r["place"]): (r["rule_id"], r["rank"], r["medoid"]) for r in demos.cluster_select(pool, own, ranks, 4, 3, [2, 4]).collect()}
    assert got == {(7, 1): (3, 2, 3), (7, 2): (4, 4, 3), (8, 1): (1, 1, 1), (8, 2): (2, 3, 1)}


def test_registered_cluster_select(spark):
    """The query over the parts of sf0.001, against brute force."""

    sf = "/root/testdata/sf0.001"
    parts = [(int(r["p_brand"][6:]), r["p_partkey"], 1 + r["p_size"] % 4) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    rank = {(q, i): k for q, i, k in parts}
    ids = sorted({q for q, _, _ in parts})
    top = {q: [i for _, i in sorted((k, i) for p, i, k in parts if p == q)[:3]][::-1] for q in ids}  # the best last
    n = max(i for _, i, _ in parts)
    x = np.full((len(ids), n + 1), 4)
    for row, q in enumerate(ids):
        for place, i in enumerate(top[q], 1):
            x[row, i] = place
    d = np.abs(x[:, None, 1:] - x[None, :, 1:]).sum(2)
    medoids = settled(d, sorted(by_hash("5", ids, 2)))
    want = []
    for row, q in enumerate(ids):
        m = ids[medoids[int(d[medoids, row].argmin())]]
        want += [(q, place, i, rank.get((q, i), 4), m) for place, i in enumerate(top[m], 1)]
    got = queries.QUERIES["cluster_select"](spark, sf).collect()
    assert len(ids) > 2 and sorted((r["qid"], r["place"], r["rule_id"], r["rank"], r["medoid"]) for r in got) == sorted(want)


def by_hash(seed, keys, n):
    """Places of the ``n`` keys of least seeded hash."""
    return sorted(range(len(keys)), key=lambda i: (hashlib.md5(f"{seed}|{keys[i]}".encode()).hexdigest()[:8], keys[i]))[:n]


def settled(d, medoids):
    while True:
        best = np.array(medoids)[d[medoids].argmin(0)]
        own = {m: np.flatnonzero(best == m) for m in medoids}
        new = sorted(int(o[d[np.ix_(o, o)].sum(1).argmin()]) if len(o) else m for m, o in own.items())
        if new == medoids:
            return medoids
        medoids = new


def test_k_medoids_query(spark):
    """From seeded starts to the end, where medoids have moved."""
    got = {r["vec_id"]: (r["medoid"], r["d"]) for r in queries.QUERIES["k_medoids"](spark, "/root/testdata/sf0.001").collect()}
    v = {r["p_partkey"]: [r["p_size"], int(r["p_retailprice"] // 10)] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    ids = sorted(v)
    x = np.array([v[i] for i in ids])
    d = np.abs(x[:, None] - x[None]).sum(2).astype(float)
    start = sorted(by_hash("3", ids, 4))
    medoids = settled(d, start)
    assert medoids != start
    assert got == {i: (ids[medoids[int(d[medoids, k].argmin())]], d[medoids, k].min()) for k, i in enumerate(ids)}


def test_blocks_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([(i, [i % 7, i * i % 11]) for i in range(60)], "vec_id int, v array<int>")
    want = {tuple(r) for r in demos.distances(v, v.where("vec_id < 20")).collect()}
    monkeypatch.setattr(demos, "QUERIES", 6)
    monkeypatch.setattr(demos, "VECTORS", 9)
    assert {tuple(r) for r in demos.distances(v, v.where("vec_id < 20")).collect()} == want and len(want) == 1200


def test_every_row_with_every_rule(spark, monkeypatch):
    rows, rules = spark.range(7).toDF("qid"), spark.range(25).toDF("rule_id")
    want = {tuple(r) for r in unify.paired(rows, rules).collect()}
    monkeypatch.setattr(unify, "MOST_RULES", 3)
    assert {tuple(r) for r in unify.paired(rows, rules).collect()} == want and len(want) == 175


def test_rollout_ends(spark):
    bank = unify.bank(spark, ["r0_1(x1) → r1_1(x1)", "r1_1(x1) → r2_1(x1)"], [0, 1])
    rows = [(1, 0, [("r0_1", ["c0"])], ("r2_1", ["c0"])), (2, 1, [("r1_1", ["a"])], ("r2_1", ["a"])), (3, 0, [("r0_1", ["b"])], ("r2_1", ["b"]))]
    examples = spark.createDataFrame(rows, f"qid int, start_layer int, facts array<{A.ATOM_TYPE}>, goal {A.ATOM_TYPE}")
    fact = A.conjunction_text(F.col("facts"))
    said = F.concat(fact, F.lit(" → "), F.regexp_replace(fact, "r[01]_", F.concat(F.lit("r"), F.col("src_layer") + 1, F.lit("_"))))
    model = lambda d: d.withColumn("answer", F.when(F.col("qid") != 3, said))
    got = {r["qid"]: (r["success"], r["reason"], r["n_steps"], r["final_layer"], r["final_facts"]) for r in rollout.rollout(examples, bank, model, 3, 1).collect()}
    assert got == {1: (True, None, 2, 2, "r2_1(c0)"), 2: (True, None, 1, 2, "r2_1(a)"), 3: (False, "decode_error", 1, 0, "r0_1(b)")}
    short = {r["qid"]: r["reason"] for r in rollout.rollout(examples, bank, model, 1, 1).collect()}
    assert short == {1: "goal_not_reached", 2: None, 3: "decode_error"}
    none = rollout.rollout(examples.limit(0), bank, model, 2, 1)
    assert none.count() == 0 and rollout.rollout_metrics(none).first()["success_rate"] == 0
