"""Decoding, evaluation, demonstrations, generation, propositional banks and tasks, by hand or against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import atoms as A
from lamina.functions import decode as D
from lamina.functions import tokens as T
from lamina.operators import augment, batches, cluster, evaluate, generation, unify
from lamina.plans import banks, generate, propositions, tasks
from lamina.sources import banks as files

SPEC = banks.BankSpec(n_layers=5, predicates_per_layer=4, rules_per_transition=8, arity=(1, 2), variables=3, constants=("a", "b", "c"), k_in=(1, 2), k_out=(1, 2))


@pytest.fixture(scope="module")
def bank():
    return banks.build(SPEC, 13)


@pytest.fixture(scope="module")
def vocab(spark, bank):
    return tasks.vocabulary_of(spark, bank, sentinel_length=4)


def test_vocabulary_round_trip(vocab):
    assert T.vocabulary_from_json(T.vocabulary_json(vocab)) == vocab
    assert set("abcdefghijklmnopqrstuvwxyz0123456789_") <= set(vocab)  # sentinels bring all characters of fresh names
    with pytest.raises(ValueError):
        T.checked(vocab | {"more": len(vocab) + 1})
    with pytest.raises(ValueError):
        T.vocabulary_from_json(json.dumps({"version": 9, "tokens": []}))


def test_records_decode_to_what_they_were(spark, bank, vocab):
    ids, names = T.id_map(vocab), T.name_map(vocab)
    r = tasks.token_records(generate.with_completions(generate.problems(spark, bank, [1, 3], 15, 4), "full"), ids)
    p, d = D.prompt_info(F.col("prompt"), names), D.decode_completion(F.col("completion"), names)
    r = r.select("*", p.alias("p"), d.alias("d"))
    same = (D.sequent_text(F.col("p.ants"), F.col("p.cons")) == F.concat("ants", F.lit("⊢"), "goal")) & (F.col("d.texts") == F.col("completions")) & (F.col("p.src_layer") == F.col("src_layer"))
    assert r.where(same).count() == r.count() == 15 * (1 + 3)
    rows = r.select(F.col("problem_id").alias("key"), "prompt", "completion", "step_idx").where("step_idx = 0")
    own = bank.frames(spark)["rules"]
    paths = evaluate.completion_paths(rows, names, own)
    assert paths.where("success and reason is null").count() == rows.count() == 30
    goals = r.where("step_idx = 0").select(F.col("problem_id").alias("qid"), F.col("p.ants").alias("atoms"), F.col("p.cons").alias("goal"), F.col("distance").alias("steps"))
    assert evaluate.reaches_goal(goals, own, 3, 2).where("reaches").count() == 30


def test_malformed_rows(spark):
    names = T.name_map(T.SPECIAL | {"a": 10, "r": 11, "0": 12, "_": 13, "1": 14})
    cases = {(): "too short", (11,): "too short", (11, 12): "<EOT> must end it", (7, 9): "empty statement", (10, 7, 9): "empty statement", (99, 9): "unknown id", (8, 9): "special token inside", (10, 4, 9): "malformed statement", (10, 9): None, (11, 12, 13, 14, 4, 10, 10, 5, 3, 10, 9): None}
    df = spark.createDataFrame([(i, list(k)) for i, k in enumerate(cases)], "i int, row array<int>")
    got = {r["i"]: r["d"] for r in df.select("i", D.decode_completion(F.col("row"), names).alias("d")).collect()}
    assert [got[i]["error"] for i in range(len(cases))] == list(cases.values())
    assert got[8]["texts"] == ["a"] and got[9]["texts"] == ["r0_1(a,a) → a"]
    null = spark.range(1).select(D.decode_completion(F.lit(None).cast("array<int>"), names).alias("d"), D.decode_prompt(F.lit(None).cast("array<int>"), names).alias("p")).first()
    assert null["d"]["error"] == "too short" and null["p"]["error"] == "exactly one <START> is needed"
    prompts = [[1, 10, 8], [10, 6, 1, 10, 8], [10, 6, 10, 1, 10, 8], [10, 10, 8], [1, 8], [8], [10, 1, 10, 8, 8]]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, row array<int>").select("i", D.decode_prompt(F.col("row"), names).alias("p")).orderBy("i").collect()
    assert [r["p"]["error"] for r in d] == [None, None, None, "exactly one ⊢ is needed", "malformed atom", "empty prompt", "exactly one <START> is needed"]
    assert d[0]["p"]["ants"] == [] and len(d[1]["p"]["ants"]) == 1 and len(d[2]["p"]["ants"]) == 2


def test_one_context_for_each_example(spark):
    one = unify.bank(spark, ["r0_1(x1) → r1_1(x1)"])
    answers = spark.createDataFrame([(1, 0, "r0_1(a) → r1_1(a)", None)], "key int, src_layer int, statement string, expected string")
    texts = "key int, active_rule_texts array<string>, fixed_rule_texts array<string>, demo_schema_texts array<string>"
    with pytest.raises(Exception, match="one context"):
        evaluate.match_rules(answers, one, spark.createDataFrame([(1, None, None, None), (1, [], None, None)], texts)).collect()
    assert evaluate.match_rules(answers.limit(0), one).count() == 0


def test_samplers_refuse_and_empty(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 4), (2, 1, 3)], "qid int, rule_id int, rank int")
    with pytest.raises(ValueError):
        augment.sample_demos(ranked, 2, "cluster", "s")
    for kind in augment.DISTRIBUTIONS[:-1]:
        assert augment.sample_demos(ranked.limit(0), 2, kind, "s").count() == 0
        assert augment.sample_demos(ranked, 0, kind, "s").count() == 0
        got = augment.sample_demos(ranked, 5, kind, "s").collect()
        assert len(got) == (2 if "headless" in kind else 3)
    with pytest.raises(Exception, match="not among"):
        ground = spark.createDataFrame([(1, [("p", ["a"])], [("q", ["a"])])], f"qid int, lhs array<{A.ATOM_TYPE}>, rhs array<{A.ATOM_TYPE}>")
        augment.oracle_schema(ranked.join(unify.bank(spark, ["r0_1(x1) → r1_1(x1)", "r0_2(x1) → r1_1(x1)"]).select("rule_id", "lhs", "rhs"), "rule_id"), ground).collect()
    assert augment.resolved_beta(None) == float("inf") and augment.resolved_beta(None, False) == 0 and augment.resolved_beta(2) == 2


def test_random_constants_are_instances(spark, bank):
    rules = bank.frames(spark)["rules"].where("pool = 'base'")
    ground = augment.with_random_constants(rules, ["a", "b"], "s", "rule_id").select("rule_id", F.struct("lhs", "rhs").alias("g"))
    pairs = rules.select("rule_id", F.struct("lhs", "rhs").cast(A.RULE_TYPE).alias("t")).join(ground, "rule_id")
    pairs = pairs.select(F.col("rule_id").alias("key"), F.lit(0).alias("prio"), F.col("rule_id").alias("pos"), "t", F.col("g").cast(A.RULE_TYPE).alias("g"))
    assert evaluate.instances(pairs).select("key").distinct().count() == rules.count()


def test_adapter_sees_demonstrations(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0)], "qid int, step int")
    add = lambda d: d.where("qid = 1").withColumn("prompt", F.array(F.lit("x")))
    base = lambda d: d.withColumn("answer", F.coalesce(F.array_join("prompt", ""), F.lit("none")))
    assert {r["qid"]: r["answer"] for r in augment.demo_adapter(base, add)(rows).collect()} == {1: "x", 2: "none"}


def test_cluster_grid_against_brute_force(spark):
    ranks = {(q, r): 1 + (q * r) % 4 for q in range(6) for r in range(1, 6)}
    pool = spark.createDataFrame([(q, r, k) for (q, r), k in ranks.items()], "qid long, rule_id int, rank int")
    actual = spark.createDataFrame([(r, 1 + r % 4) for r in range(1, 6)], "rule_id int, rank int")
    got = cluster.select_grid(pool, actual, 5, [1.0], [2], [1, 2], "7", rounds=0)
    everyone = pool.unionByName(actual.select(F.lit(-1).cast("long").alias("qid"), "rule_id", "rank"))
    shown = augment.sample_demos(everyone, 2, "zipf_per_rule", "7|1.0|2", 1.0)
    v = {r["vec_id"]: np.array(r["v"]) for r in cluster.vectors_of(shown, 5, 3, "7").collect()}
    demos = {}
    for r in shown.collect():
        demos.setdefault(r["qid"], {})[r["place"]] = r["rule_id"]
    import hashlib

    first = sorted(range(6), key=lambda q: (hashlib.md5(f"7|{q}".encode()).hexdigest(), q))
    want = []
    for k in (1, 2):
        best = min(sorted(first[:k]), key=lambda m: (np.abs(v[m] - v[-1]).sum(), m))
        want += [(k, p, r, 1 + r % 4) for p, r in demos[best].items()]
    assert sorted((r["k"], r["place"], r["rule_id"], r["rank"]) for r in got.collect()) == sorted(want)
    sel = spark.createDataFrame([(1, 1, 3, 2), (1, 2, 4, 2), (2, 1, 9, 1)], "qid int, place int, rule_id int, rank int")
    out = cluster.with_oracle(sel, spark.createDataFrame([(1, 7), (2, 9)], "qid int, rule_id int")).collect()
    assert sorted((r["qid"], r["place"], r["rule_id"], r["rank"]) for r in out) == [(1, 1, 3, 2), (1, 2, 7, 1), (2, 1, 9, 1)]


def test_fresh_queries_and_rankings(spark, bank):
    actual = bank.frames(spark)["rules"].where("src_layer = 0 and pool = 'base'").select("rule_id", F.lit(4).alias("rank"))
    got = cluster.candidate_rankings(spark, bank, 0, 2, 8, 3, 2, actual)
    assert got.count() == 8 * actual.count() and {r["rank"] for r in got.collect()} <= {1, 2, 3, 4}
    assert sorted(got.collect()) == sorted(cluster.candidate_rankings(spark, bank, 0, 2, 8, 3, 2, actual).collect())


def test_choice_and_filling(spark):
    z = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    draws = [r[0] for r in spark.range(4000).select(generation.choose(z, 1.0, F.col("id").cast("string"))).collect()]
    p = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    assert np.abs(np.bincount(draws, minlength=3) / 4000 - p).max() < 0.03
    assert spark.range(1).select(generation.choose(z, 0.0)).first()[0] == 2

    def model(ids):
        out = np.full((*ids.shape, 12), -50.0)
        np.put_along_axis(out, ((ids + 1) % 12)[..., None], 50.0, axis=2)
        return out

    rows = spark.createDataFrame([(1, [3, 4, 0, 0, 0]), (2, [5, 8, 0])], "key int, xs array<int>")
    assert {r["key"]: r["xs"] for r in generation.fill(rows, model).collect()} == {1: [3, 4, 5, 6, 7], 2: [5, 8, 9]}
    prompt = spark.createDataFrame([(1, [3, 8])], "key int, prompt array<int>")
    assert generation.predict(prompt, model, 10, 5).first()["completion"] == [9]
    assert generation.predict(prompt, model, 4, 4, "completion").first()["completion"] == [4, 9]
    for bad in ([[3, 4]], [[8] * 2], [[3] * 11 + [8]]):
        with pytest.raises(Exception, match="START"):
            generation.predict(spark.createDataFrame([(1, bad[0])], "key int, prompt array<int>"), model, 10, 5).collect()
    assert generation.split_batch(100, 30) == (25, 4)
    with pytest.raises(ValueError):
        generation.loss("none")


def test_propositions(spark, tmp_path):
    b = propositions.build(5, 4, 6, 2, 2, 1)
    for layer in range(4):
        own = b.of(layer)
        assert len(set(own)) == len(own) == 6 and all(set(r[0]) <= set(b.names(layer)) and set(r[1]) <= set(b.names(layer + 1)) for r in own)
    path = f"file://{tmp_path}/props"
    files.save_propositions(spark, b, path)
    assert files.load_propositions(spark, path).to_json() == b.to_json()
    rules = {propositions.statement(r): (s, set(r[0]), set(r[1])) for s, r in b.rules}
    steps = propositions.problems(spark, b, [1, 3], 20, 5, parts=3).orderBy("problem_id", "step_idx").collect()
    assert len(steps) == 20 + 60 and steps == propositions.problems(spark, b, [1, 3], 20, 5, parts=7).orderBy("problem_id", "step_idx").collect()
    held = None
    for r in steps:
        layer, lhs, rhs = rules[r["statement"]]
        facts = set(r["ants"].split(","))
        assert layer == r["src_layer"] and lhs <= facts and (r["step_idx"] == 0 or facts == held)
        held = rhs
        assert r["step_idx"] < r["distance"] - 1 or r["goal"] in rhs
    with pytest.raises(ValueError):
        propositions.build(3, 1, 2, 1, 1, 0)
    with pytest.raises(ValueError):
        propositions.problems(spark, b, [5], 1, 1)
    # propositions are whole tokens, and rows of them decode
    names = T.name_map(T.collected(T.proposition_vocabulary(spark.createDataFrame([(n,) for k in range(5) for n in b.names(k)], "name string"))))
    ids = F.map_from_arrays(F.map_values(names), F.map_keys(names))
    r = tasks.token_records(propositions.problems(spark, b, [2], 5, 5).withColumn("completions", F.array("statement")), ids)
    assert r.where(D.decode_completion(F.col("completion"), names)["texts"] == F.col("completions")).count() == 10


def test_options():
    o = tasks.Options(distances=(2,), split="fresh", role="eval", most_demos=3)
    assert o.forced_step == 0 and tasks.options_from_json(o.to_json()) == o
    f = tasks.FreshOptions(name_length=3)
    assert tasks.options_from_json(f.to_json()) == f
    for bad in ({"split": "other"}, {"distances": ()}, {"least_demos": 2, "most_demos": 1}, {"include_oracle": True}, {"alpha": -1.0}, {"split": "transfer"}, {"step": 1}, {"distribution": "none"}):
        with pytest.raises(ValueError):
            tasks.Options(**bad)
    got, spec = tasks.options_from_args(["--distances", "3-1", "--beta", "inf", "--unique", "false", "--predicates-per-layer", "2,3,4", "--n-layers", "3", "--rules-per-transition", "2"])
    assert got.distances == (1, 2, 3) and got.beta == float("inf") and not got.unique and spec.predicates_per_layer == (2, 3, 4)
    assert tasks.condition_list("icl, hybrid") == ("icl", "hybrid")
    with pytest.raises(ValueError):
        tasks.condition_list("icl,other")


def test_configs():
    c = json.loads(tasks.run_config(7, "x", train={"rate": 0.1, "beta": float("inf")}, spec=SPEC, info=None))
    assert c["run_id"] == 7 and c["experiment"] == "x" and c["train"] == {"rate": 0.1, "beta": "Infinity"} and c["spec"]["n_layers"] == 5 and "info" not in c


def test_splits(spark):
    three = banks.BankSpec(n_layers=3, predicates_per_layer=4, rules_per_transition=8, k_in=(1, 2), k_out=(1, 2))
    train, held = banks.build_depth3_pair(three, 2)
    t = tasks.Transfer(train, held)
    for role, own in (("train", train), ("eval", held)):
        s = t.steps(spark, tasks.Options(distances=(2,), split="transfer", role=role), 12).collect()
        assert len(s) == 12 and (role == "train" or {r["step_idx"] for r in s} == {0})
        first = {p for r in s if r["src_layer"] == 0 for p in (a.split("(")[0] for a in r["statement"].split(" → ")[0].split(" ∧ "))}
        assert first <= set(own.layers[0])
    base = banks.build(three, 1)
    f = tasks.Fresh(base).steps(spark, tasks.FreshOptions(), 10).collect()
    used = [{a.split("(")[0] for a in r["statement"].split(" → ")[0].split(" ∧ ")} for r in f if r["src_layer"] == 0]
    assert len(f) == 10 and all(p.startswith("r_") and len(p) == 6 for u in used for p in u)
    assert all(r["template"] in r["active_rule_texts"] for r in f)
    rng = np.random.default_rng(0)
    temp = banks.temporary_bank(base, rng, 2)
    assert temp.of(1) == base.of(1) and not set(temp.layers[0]) & set(base.arity)
    with pytest.raises(ValueError):
        banks.fresh_layer0(banks.build(SPEC, 1), ["r_a"], 2, rng)
    with pytest.raises(RuntimeError):
        banks.fresh_names(37, rng)
    assert len(set(banks.fresh_names(36, rng))) == 36


def test_factory(spark):
    f = tasks.TaskFactory(3, SPEC, 2, 3)
    seeds = {(c, d): f.options(c, d).seed for c in tasks.CONDITIONS for d in (None, 1, 2, 3)}
    assert len(set(seeds.values())) == 12
    assert f.steps(spark, "internalized", 4).count() == 4 * (1 + 2) and f.steps(spark, "hybrid", 4).count() == 8
    assert {d: x.count() for d, x in f.per_depth(spark, "icl", 2).items()} == {1: 2, 2: 4, 3: 6}
    for bad in (lambda: f.options("other"), lambda: f.options("icl", 4), lambda: tasks.TaskFactory(3, SPEC, 4, 3)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="no step"):
        tasks.one_step(f.steps(spark, "internalized", 2), "s", 1).collect()


def test_pairs_on_disk(spark, tmp_path):
    a, b = banks.build_depth3_pair(banks.BankSpec(n_layers=3, predicates_per_layer=3, rules_per_transition=4), 5)
    path = f"file://{tmp_path}/pair"
    files.save_pair(spark, a, b, path)
    x, y, numbers = files.load_pair(spark, path)
    assert (x.to_json(), y.to_json()) == (a.to_json(), b.to_json()) and sorted(numbers["train"] + numbers["eval"]) == list(range(1, 7))
    old = {"version": 1, "train": json.loads(a.to_json()), "eval": json.loads(b.to_json())}
    for name, d in (("v1", old), ("v9", old | {"version": 9})):
        spark.createDataFrame([(json.dumps(d),)], "value string").coalesce(1).write.text(f"file://{tmp_path}/{name}")
    assert files.load_pair(spark, f"file://{tmp_path}/v1")[2] == numbers
    with pytest.raises(ValueError):
        files.load_pair(spark, f"file://{tmp_path}/v9")
    assert files.bank_for(spark, SPEC, 3).to_json() == banks.build(SPEC, 3).to_json()


def test_metadata(spark, bank, vocab, tmp_path):
    path = f"file://{tmp_path}/set"
    r = tasks.token_records(generate.with_completions(generate.problems(spark, bank, [1, 2], 6, 4)), T.id_map(vocab))
    generate.write_dataset(r, path, 4, {"completion_format": "single"})
    m = generate.read_metadata(spark, path, [1, 2], "single")
    want = r.agg(F.max(F.size("prompt")), F.max(F.size("completion")), F.max(F.size("prompt") + F.size("completion") - 1)).first()
    assert (m["max_prompt"], m["max_completion"], m["max_seq"]) == tuple(want)
    for bad in (lambda: generate.read_dataset(spark, path, [1], "full"), lambda: generate.read_dataset(spark, path, [4])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        generate.read_metadata(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(Exception, match="already exists"):
        generate.write_dataset(r, path)
    generate.write_dataset(r.where("distance = 1"), path, overwrite=True)
    assert generate.read_dataset(spark, path).count() == 6


def test_collate_names_what_it_skips(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/b")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part.parquet").write_bytes(b"no table")
    df, skipped = files.collate(spark, [f"{tmp_path}/{n}" for n in "abcd"])
    assert df.count() == 5 and set(df.columns) == {"id", "x"} and [k[-1] for k in skipped] == ["c", "d"]


def test_streams(spark, tmp_path):
    from lamina.streaming.online import curriculum_stream, each_batch, metrics_table, problem_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/events")
    stream = curriculum_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"), [(0, 1), (100, 2)])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("by_hour").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["h"], r["d"]): r["n"] for r in events.groupBy(F.date_trunc("hour", "ts").alias("h"), F.when(F.col("event_id") >= 100, 2).when(F.col("event_id") >= 0, 1).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r["window"]["start"], r["d_max"]): r["n"] for r in spark.sql("SELECT * FROM by_hour").collect()} == want
    hybrid, _ = banks.build_hybrid(banks.build(SPEC, 13), 3)
    seen = []
    s = problem_stream(spark, hybrid, [1, 2], 5, 20, mode="train").groupBy().agg(F.count(F.lit(1)).cast("double").alias("steps"))
    q = each_batch(s, lambda b, n: seen.append(n), metrics_table(f"{tmp_path}/metrics"), mode="complete")
    try:
        for _ in range(40):
            q.processAllAvailable()
            if len(seen) > 1:
                break
    finally:
        q.stop()
    assert seen and spark.read.parquet(f"{tmp_path}/metrics").where("metric = 'stream/steps'").count() == len(seen)


def test_batch_options(spark):
    r = spark.createDataFrame([(1, [5, 8], [6, 9])], "key int, prompt array<int>, completion array<int>")
    assert batches.batched(r, "autoregressive", mask_prompt=False).first()["ys"] == [8, 6, 9]
    assert batches.batched(r, "all_at_once").first()["ys"] == [6, 9]
    with pytest.raises(ValueError):
        batches.batched(r, "other")
    m = batches.mapped(batches.batched(r, "all_at_once"), xs=lambda x: F.reverse(x)).first()
    assert m["xs"] == [8, 5] and m["ys"] == [6, 9]
    assert batches.resolved_length(None, 7, 9) == 7
    for bad in ([], [(1, 2)], [(0, 1), (0, 2)], [(0, 0)]):
        with pytest.raises(ValueError):
            batches.manual_phases(bad)
    d = batches.up_to_depth(spark.createDataFrame([(1,), (2,), (3,)], "distance int"), spark.createDataFrame([(0,), (5,)], "step int"), [(0, 1), (5, 2)])
    assert sorted((x["step"], x["distance"]) for x in d.collect()) == [(0, 1), (5, 1), (5, 2)]


def test_first_arities(spark):
    rules = unify.bank(spark, ["r0_1(x1,x2) → r1_1(x1)", "r0_1(x1) ∧ r0_2(x1,x2,x3) → r1_1(x1)"])
    names = spark.createDataFrame([("r0_1",), ("r0_2",), ("r_x",)], "predicate string")
    assert {r["predicate"]: r["arity"] for r in banks.first_arities(rules, names).collect()} == {"r0_1": 2, "r0_2": 3, "r_x": 0}
