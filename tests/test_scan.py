"""Scans in blocks, as-of joins, draws by running weights and batches by tokens, against plain loops."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lamina.operators import batches, budget, demos, metrics, scan


@pytest.fixture(scope="module")
def many(spark):
    """Blocks enough that a hot key is in several."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def keyed(n, seed):
    r = random.Random(seed)
    return [(None if r.random() < 0.1 else "hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.choice([None, 1, 2, 5])) for i in r.sample(range(10 * n), n)]


def test_running(many):
    rows = keyed(300, 1)
    d = many.createDataFrame(rows, "k string, t int, c int").repartition(3)
    assert scan.blocks(d, ["k"], ["t"]).where("k = 'hot'").select("_p").distinct().count() > 3
    got = {(r["k"], r["t"]): (r["s"], r["n"], r["last"]) for r in scan.running(d, ["k"], ["t"], {"s": F.col("c"), "n": F.lit(1)}, "last").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((t, c) for x, t, c in rows if x == k)
        for i, (t, _) in enumerate(own):
            want[k, t] = (sum(c or 0 for _, c in own[:i]), i, i + 1 == len(own))
    assert got == want
    whole = scan.running(d, [], ["t"], {"n": F.lit(1)}).collect()
    assert [r["n"] for r in sorted(whole, key=lambda r: r["t"])] == list(range(300))
    assert scan.running(d.limit(0), ["k"], ["t"], {"n": F.lit(1)}).count() == 0


def test_latest(many):
    r = random.Random(2)
    states = [("hot" if r.random() < 0.8 else r.choice(["k1", "k2", None]), r.choice([None, *range(40)]), r.choice([None, "a", "b"]), i % 3) for i in range(150)]
    rows = [(r.choice(["hot", "hot", "k1", "k9", None]), r.choice([None, *range(-3, 50)]), f"r{i}") for i in range(200)] + [("hot", 5, "same")] * 3
    s = many.createDataFrame(states, "k string, start int, name string, depth int")
    d = many.createDataFrame(rows, "k string, at int, start string")  # a column named as the other side's
    got = Counter(tuple(x) for x in scan.latest(d, s, ["k"], "at", "start", ["name", "depth"]).collect())
    want = Counter()
    for k, at, tag in rows:
        own = [(t, (name is not None, name or "", depth), (name, depth)) for x, t, name, depth in states if x == k and t is not None and at is not None and k is not None and t <= at]
        want[k, at, tag, *(max(own)[2] if own else (None, None))] += 1
    assert got == want
    assert scan.latest(d, s.limit(0), ["k"], "at", "start", ["name"]).where("name is not null").count() == 0
    assert scan.latest(d.limit(0), s, ["k"], "at", "start", ["name"]).count() == 0
    phased = batches.with_phase_of(d.select("k", F.col("at").alias("step")), s.groupBy("k", "start").agg(F.max("depth").alias("d_max")), ["k"])
    assert phased.columns == ["k", "step", "d_max"] and phased.count() == len(rows)


def test_exit_of_one_long_episode(many):
    r = random.Random(3)
    p = [r.random() * 0.02 for _ in range(2000)]
    rows = [("all", i, x) for i, x in enumerate(p)] + [("sure", 0, 0.25), ("sure", 1, 1.0), ("sure", 2, 0.5), ("sure", 3, 0.5), ("one", 7, 0.1)]
    out = metrics.exit_distribution(many.createDataFrame(rows, "k string, s int, p double"), "k", "s", "p")
    got = {(x["k"], x["s"]): x["exit_prob"] for x in out.collect()}
    stay = 1.0
    for i, x in enumerate(p):
        assert math.isclose(got["all", i], stay if i == len(p) - 1 else x * stay, rel_tol=1e-9)
        stay *= 1 - x
    assert math.isclose(sum(v for (k, _), v in got.items() if k == "all"), 1, rel_tol=1e-9)
    assert [got["sure", i] for i in range(4)] == [0.25, 0.75, 0, 0] and got["one", 7] == 1


def test_draws(many):
    """One query's pool of many rules: the same draws whatever the partitions, in proportion to the weights."""
    weights = {("hot", i): 1.0 + i % 7 for i in range(60)} | {("q", 1): 0.0, ("q", 2): 2.0, ("q", 3): 0.0, ("none", 1): 0.0}
    pool = many.createDataFrame([(q, i, w, 1) for (q, i), w in weights.items()], "qid string, rule_id int, weight double, rank int")
    n = 20_000
    got = demos.sample_repeated(pool.repartition(2), n, "s").select("qid", "draw", "rule_id")
    other = demos.sample_repeated(pool.repartition(11, "rule_id"), n, "s").select("qid", "draw", "rule_id")
    assert got.exceptAll(other).count() == 0 and got.count() == other.count() == 2 * n
    count = {(r["qid"], r["rule_id"]): r["count"] for r in got.groupBy("qid", "rule_id").count().collect()}
    total = sum(w for (q, _), w in weights.items() if q == "hot")
    chi = sum((count["hot", i] - n * w / total) ** 2 / (n * w / total) for (q, i), w in weights.items() if q == "hot")
    assert chi < 59 + 5 * math.sqrt(2 * 59) and count["q", 2] == n


def test_length_classes(spark):
    got = {r["n"]: r["c"] for r in spark.range(-2, 5000).select(F.col("id").alias("n"), budget.length_class(F.col("id")).alias("c")).collect()}
    bounds = sorted({m << s for s in range(12) for m in (5, 6, 7, 8)} | set(range(1, 9)))
    assert all(c == min(b for b in bounds if b >= n) for n, c in got.items())


@pytest.mark.parametrize("ragged", [False, True])
def test_token_batches(many, ragged):
    r = random.Random(5)
    lengths = [r.choice([None, 0, 1, 7, 9, 9, 10, 33, r.randrange(1, 500)]) for _ in range(600)] + [500, 501, 900, 900]
    rows = [(i, n, f"x{i}") for i, n in enumerate(lengths)] + [(0, lengths[0], "again")]
    d = many.createDataFrame(rows, "id int, n int, x string")
    with pytest.raises(Exception, match="longer than the budget"):
        budget.token_batches(d, "id", "n", 500, "s", ragged).collect()
    out = budget.token_batches(d, "id", "n", 500, "s", ragged, "alone").collect()
    assert Counter((x["id"], x["n"], x["x"]) for x in out) == Counter(rows)
    by = defaultdict(list)
    for x in out:
        by[x["batch_id"]].append(x)
    assert ragged or sorted(by) == list(range(len(by)))
    for own in by.values():
        n = [max(x["n"] or 0, 1) for x in own]
        pad = {x["pad_to"] for x in own}
        assert len(pad) == 1 and max(n) <= min(pad) and sorted(x["row_idx"] for x in own) == list(range(len(own)))
        if max(n) > 500:
            assert len(own) == 1
        else:
            assert (sum(n) if ragged else len(n) * min(pad)) <= 500
            assert min(pad) <= max(8, 1.25 * min(n)) or min(pad) == 500
    again = budget.token_batches(d.repartition(5), "id", "n", 500, "s", ragged, "alone")
    if not ragged:  # rows of one key and class may change places
        assert {(x["id"], x["batch_id"]) for x in again.collect() if x["id"]} == {(x["id"], x["batch_id"]) for x in out if x["id"]}
    p = budget.padding(again, "n").first()
    assert p["batches"] == len(by) and p["tokens"] == sum(n or 0 for _, n, _ in rows) and p["padded"] == sum(x["pad_to"] for x in out)
    assert budget.token_batches(d.limit(0), "id", "n", 500, "s", ragged).count() == 0
