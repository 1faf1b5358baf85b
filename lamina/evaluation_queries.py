"""Named queries over token rows, answers, demonstrations and scores, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import atoms as A
from .functions import decode as D
from .functions import tokens as T
from .functions.chance import gumbel_sql, uniform_sql
from .operators import augment, batches, cluster, evaluate, generation, unify
from .plans import tasks
from .queries import RANKED_SQL, TURNS_SQL, atom, query, ranked_parts, shown, table, turn_records
from .session import spread

# --- a customer's nation and region as constants; facts r0_1(nation, region) and r0_2(region, nation)

BANK = ["r0_1(x1,x2) ∧ r0_2(x2,x3) → r1_1(x1,x3)", "r0_1(x1,x2) → r1_2(x2)", "r1_1(x1,x2) → r2_1(x2)", "r1_2(x1) → r2_2(x1)"]
CONSTANTS = [f"n{i}" for i in range(25)] + [f"g{i}" for i in range(5)]
VOCABULARY = T.SPECIAL | {t: i + len(T.SPECIAL) for i, t in enumerate([*CONSTANTS, "r", "_", "0", "1", "2"])}
UNKNOWN = 9_999


def _bank(spark):
    return unify.bank(spark, BANK, [0, 0, 1, 1])


def _names():
    return T.name_map(VOCABULARY)


def _ids(tokens):
    return T.to_ids(tokens, T.id_map(VOCABULARY))


def _customers(spark, sf_dir):
    """key, a (nation), b (region), ants, goal."""
    c, n = spread(table(spark, sf_dir, "customer")), table(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").cast("long").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("g"), "n_regionkey").alias("b"))
    return j.withColumn("ants", F.array(atom("r0_1", "a", "b"), atom("r0_2", "b", "a"))).withColumn("goal", atom("r2_1", "a"))


CUSTOMERS = "u AS (SELECT CAST(c_custkey AS BIGINT) AS key, 'n' || n_nationkey AS a, 'g' || n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)"
FACTS = "'r0_1(' || a || ',' || b || ')' || sep || 'r0_2(' || b || ',' || a || ')'"


def _said(*statements):
    """Token ids of statements (lhs, rhs) in turn."""
    return _ids(T.completion_tokens(F.array(*[T.clause_tokens(F.array(*lhs), F.array(*rhs)) for lhs, rhs in statements])))


def _by_kind(kind, values):
    out = F.when(kind == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        out = out.when(kind == k, v)
    return out


@query(f"""WITH {CUSTOMERS} SELECT key, CASE key % 6 WHEN 0 THEN {FACTS.replace("sep", "','")} || '⊢r2_1(' || a || ')' WHEN 4 THEN {FACTS.replace("sep", "','")} || '⊢r2_1(' || a || ')' END AS sequent,
CASE WHEN key % 6 IN (0, 4) THEN 0 END AS src_layer, CASE WHEN key % 6 IN (0, 4) THEN 2 END AS goal_layer,
CASE key % 6 WHEN 1 THEN 'exactly one <START> is needed' WHEN 2 THEN 'exactly one ⊢ is needed' WHEN 3 THEN 'unknown id' WHEN 5 THEN 'malformed atom' END AS error FROM u""")
def decode_prompt(spark, sf_dir):
    """Prompts as ids: one in six whole, one behind a demonstration, the others malformed in a way each."""
    c = _customers(spark, sf_dir)
    good = _ids(T.prompt_tokens(F.col("ants"), F.col("goal")))
    without = lambda t: F.filter(good, lambda x: x != VOCABULARY[t])
    demo = _said(([atom("r1_2", "b")], [atom("r2_2", "b")]))
    rows = _by_kind(F.col("key") % 6, [good, without("<START>"), without("⊢"), F.concat(F.array(F.lit(UNKNOWN)), good), T.prepend(F.array(demo), good), without(")")])
    read = c.select("key", D.prompt_info(F.concat(rows, F.array(F.lit(0), F.lit(0))), _names()).alias("p"))
    p = F.col("p")
    return read.select("key", F.when(p["error"].isNull(), D.sequent_text(p["ants"], p["cons"])).alias("sequent"), p["src_layer"].alias("src_layer"), p["goal_layer"].alias("goal_layer"), p["error"].alias("error"))


@query(f"""WITH {CUSTOMERS}, t AS (SELECT key, 'r0_1(' || a || ',' || b || ') ∧ r0_2(' || b || ',' || a || ') → r1_1(' || a || ',' || a || ')' AS s, 'r1_1(' || a || ',' || a || ') → r2_1(' || a || ')' AS s2, 'r1_1(' || a || ',' || a || ')' AS c FROM u)
SELECT key, CASE key % 6 WHEN 0 THEN s || ' <SEP> ' || s2 WHEN 1 THEN s WHEN 2 THEN c END AS display, CASE WHEN key % 6 = 1 THEN s END AS single,
CASE key % 6 WHEN 3 THEN '<EOT> must end it' WHEN 4 THEN 'empty statement' WHEN 5 THEN 'special token inside' END AS error FROM t""")
def decode_completion(spark, sf_dir):
    c = _customers(spark, sf_dir)
    one, two = ([F.col("ants")[0], F.col("ants")[1]], [atom("r1_1", "a", "a")]), ([atom("r1_1", "a", "a")], [atom("r2_1", "a")])
    plain = _ids(F.concat(T.atom_tokens(atom("r1_1", "a", "a")), F.array(F.lit("<EOT>"))))
    rows = _by_kind(F.col("key") % 6, [_said(one, two), _said(one), plain, F.filter(_said(one), lambda t: t != T.EOT), F.concat(F.array(F.lit(T.SEP)), _said(one)), F.concat(F.array(F.lit(T.PAD)), _said(one))])
    d = c.select("key", D.decode_completion(rows, _names()).alias("d"))
    single = A.let(D.clause_of(F.col("d")), lambda c: F.when(c["error"].isNull(), A.clause_text(c["lhs"], c["rhs"])))
    return d.select("key", D.shown_of(F.col("d")).alias("display"), single.alias("single"), F.col("d.error").alias("error"))


def _path_rows(spark, sf_dir):
    """Completions of six kinds: right, not ended, an unknown rule, an inapplicable one, the wrong goal, no clause."""
    c = _customers(spark, sf_dir)
    first, then = ([F.col("ants")[0], F.col("ants")[1]], [atom("r1_1", "a", "a")]), ([atom("r1_1", "a", "a")], [atom("r2_1", "a")])
    other, on = ([atom("r0_1", "a", "b")], [atom("r1_2", "b")]), ([atom("r1_2", "b")], [atom("r2_2", "b")])
    unknown = _said(first, ([atom("r1_1", "a", "a")], [atom("r2_2", "a"), atom("r2_1", "a")]))
    loose = _ids(F.concat(F.slice(T.completion_tokens(F.array(T.clause_tokens(F.array(*first[0]), F.array(*first[1])))), 1, 26), F.array(F.lit("<SEP>")), T.atom_tokens(atom("r1_1", "a", "a")), F.array(F.lit("<EOT>"))))
    rows = _by_kind(F.col("key") % 6, [_said(first, then), F.filter(_said(first, then), lambda t: t != T.EOT), unknown, _said(([atom("r0_1", "b", "b")], [atom("r1_2", "b")])), _said(other, on), loose])
    return c.select("key", _ids(T.prompt_tokens(F.col("ants"), F.col("goal"))).alias("prompt"), rows.alias("completion"))


PATHS = f"""{CUSTOMERS}, p AS (SELECT key, key % 6 = 0 AS success, CASE key % 6 WHEN 1 THEN 'decode_error' WHEN 2 THEN 'unknown_rule' WHEN 3 THEN 'inapplicable' WHEN 4 THEN 'goal_not_reached' WHEN 5 THEN 'decode_error' END AS reason,
CAST(CASE key % 6 WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INTEGER) AS n_steps, CAST(CASE key % 6 WHEN 0 THEN 2 WHEN 4 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS INTEGER) AS final_layer,
CASE key % 6 WHEN 0 THEN 'r2_1(' || a || ')' WHEN 4 THEN 'r2_2(' || b || ')' WHEN 2 THEN 'r1_1(' || a || ',' || a || ')' WHEN 5 THEN 'r1_1(' || a || ',' || a || ')' ELSE {FACTS.replace("sep", "' ∧ '")} END AS final_facts FROM u)"""


@query(f"WITH {PATHS} SELECT * FROM p")
def completion_paths(spark, sf_dir):
    return evaluate.completion_paths(_path_rows(spark, sf_dir), _names(), _bank(spark))


@query(f"""WITH {PATHS} SELECT count(*) AS n, count(*) FILTER (success) AS n_success, count(*) FILTER (reason = 'decode_error') AS n_decode_error, count(*) FILTER (reason = 'unknown_rule') AS n_unknown_rule, count(*) FILTER (reason = 'inapplicable') AS n_inapplicable,
count(*) FILTER (reason = 'goal_not_reached') AS n_goal_not_reached, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(n_steps), 6) AS avg_steps FROM p""")
def completion_path_metrics(spark, sf_dir):
    m = evaluate.path_metrics(evaluate.completion_paths(_path_rows(spark, sf_dir), _names(), _bank(spark)))
    return m.select(*[c for c in m.columns if c.startswith("n")], F.round("success_rate", 6).alias("success_rate"), F.round("avg_steps", 6).alias("avg_steps"))


@query(f"WITH {CUSTOMERS} SELECT key, key % 6 = 3 AS single, key % 6 = 0 AS full_ FROM u")
def completion_valid(spark, sf_dir):
    """The same completions as single statements of the first layer, and as paths."""
    rows = _path_rows(spark, sf_dir)
    single = evaluate.completions_valid(rows, _names(), _bank(spark)).withColumnRenamed("valid", "single")
    return single.join(evaluate.completions_valid(rows, _names(), _bank(spark), "full").withColumnRenamed("valid", "full_"), "key")


def _answers(spark, sf_dir):
    """Answers whose rule stands in the bank, in the example's fixed or demonstrated rules, nowhere, or by another name."""
    c = _customers(spark, sf_dir)
    kind = F.col("key") % 5
    text = F.format_string("r0_1(%s,%s) → r1_2(%s)", "a", "b", "b")
    none, own = F.array().cast("array<string>"), F.lit("r0_1(x1,x2) → r1_2(x2)")
    active = F.when(kind == 1, none).when(kind == 2, F.array(F.lit("r0_2(x1) → r1_2(x1)"))).when(kind == 3, none).when(kind == 4, F.array(F.lit("r0_2(x1,x2) → r1_1(x2)")))
    contexts = c.where(kind > 0).select("key", active.alias("active_rule_texts"), F.when(kind == 1, F.array(own)).when(kind == 2, none).alias("fixed_rule_texts"), F.when(kind == 2, F.array(F.lit("r0_1(x1"), own)).alias("demo_schema_texts"))
    expected = F.when(F.col("key") % 10 == 5, F.concat(text, F.lit(" ∧ more"))).otherwise(text)
    return c.select("key", F.lit(0).alias("src_layer"), text.alias("statement"), expected.alias("expected")), contexts


@query(f"""WITH {CUSTOMERS} SELECT key, CASE key % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS pos, CASE key % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'fixed' WHEN 2 THEN 'demo' END AS match_source, false AS decode_error,
key % 5 = 3 AS unknown, key % 5 = 4 OR key % 10 = 5 AS wrong, key % 5 < 3 AS valid, key % 5 < 3 AND key % 10 <> 5 AS correct FROM u""")
def match_by_source(spark, sf_dir):
    answers, contexts = _answers(spark, sf_dir)
    return evaluate.match_rules(answers, _bank(spark), contexts).drop("src_layer", "statement")


@query(f"""WITH {CUSTOMERS} SELECT count(*) AS n, count(*) FILTER (key % 5 < 3) AS n_valid, count(*) FILTER (key % 5 < 3 AND key % 2 = 0) AS n_reachable, count(*) FILTER (key % 5 = 3) AS n_unknown, count(*) FILTER (key % 5 = 4 OR key % 10 = 5) AS n_wrong, count(*) FILTER (key % 5 >= 3) AS n_invalid,
round(count(*) FILTER (key % 5 < 3 AND key % 2 = 0) / count(*) FILTER (key % 5 < 3), 6) AS reachable_given_valid FROM u""")
def first_transition_counts(spark, sf_dir):
    answers, contexts = _answers(spark, sf_dir)
    reached = answers.select("key", (F.col("key") % 2 == 0).alias("reaches"))
    m = evaluate.first_transition_metrics(evaluate.match_rules(answers, _bank(spark), contexts), reached)
    return m.select("n", "n_valid", "n_reachable", "n_unknown", "n_wrong", "n_invalid", F.round("reachable_given_valid", 6).alias("reachable_given_valid"))


@query(f"WITH {CUSTOMERS} SELECT key AS qid, key % 5 IN (0, 1, 2) AS reaches FROM u")
def goal_in_exact_steps(spark, sf_dir):
    c, k = _customers(spark, sf_dir), F.col("key") % 5
    goal = F.when(k == 0, atom("r2_1", "a")).when(k == 1, atom("r2_2", "b")).when(k == 2, atom("r1_1", "a", "a")).when(k == 3, atom("r2_1", "b")).otherwise(atom("r1_2", "b"))
    steps = F.when(k == 2, 1).when(k == 4, F.when(F.col("key") % 2 == 0, 2).otherwise(-1)).otherwise(2)
    return evaluate.reaches_goal(c.select(F.col("key").alias("qid"), F.col("ants").alias("atoms"), goal.alias("goal"), steps.alias("steps")), _bank(spark), 2, 2)


# --- demonstrations

ORACLE_SQL = "o AS (SELECT p_brand AS qid, min(p_partkey) AS oracle FROM part GROUP BY 1)"
PLACED = "CAST(row_number() OVER (PARTITION BY qid ORDER BY rank DESC, CAST(rule_id AS VARCHAR) || '#' || draw) AS INTEGER) AS place"


def _oracle(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("qid")).agg(F.min("p_partkey").alias("rule_id"))


@query(f"""WITH {RANKED_SQL}, k AS (SELECT qid, rule_id, rank, 0 AS draw, row_number() OVER (PARTITION BY qid ORDER BY {gumbel_sql("'4|'||qid||'|'||rule_id")} DESC, rule_id) AS n FROM r)
SELECT qid, rule_id, rank, {PLACED} FROM k WHERE n <= 6""")
def demos_uniform(spark, sf_dir):
    return augment.sample_demos(ranked_parts(spark, sf_dir), 6, "uniform", "4")


@query(f"""WITH {RANKED_SQL}, {ORACLE_SQL}, j AS (SELECT r.*, rule_id = oracle AS own FROM r JOIN o USING (qid)), w AS (SELECT *, pow(rank, -1.5) / sum(pow(rank, -1.5)) FILTER (rank <> 1) OVER (PARTITION BY qid) AS w FROM j),
k AS (SELECT qid, rule_id, CASE WHEN own THEN 1 ELSE rank END AS rank, 0 AS draw, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN own THEN 'Infinity'::DOUBLE ELSE ln(w) + {gumbel_sql("'6|'||qid||'|'||rule_id")} END DESC, rule_id) AS n FROM w WHERE rank <> 1 OR own)
SELECT qid, rule_id, rank, {PLACED} FROM k WHERE n <= 5""")
def demos_headless_oracle(spark, sf_dir):
    """Rank 1 is left out of the draw, the oracle's rule is in."""
    return augment.sample_demos(ranked_parts(spark, sf_dir), 5, "zipf_per_rule_headless", "6", 1.5, oracle=_oracle(spark, sf_dir))


@query(f"""WITH {RANKED_SQL}, {ORACLE_SQL}, w AS (SELECT r.*, rule_id = oracle AS own, pow(rank, -1.0) / count(*) OVER (PARTITION BY qid, rank) AS w FROM r JOIN o USING (qid)),
e AS (SELECT *, sum(w) OVER (PARTITION BY qid ORDER BY rule_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY qid) AS hi FROM w), d AS (SELECT qid, i AS draw, {uniform_sql("'8|'||qid||'|'||i")} AS u FROM o, range(1, 4) t(i)),
h AS (SELECT d.qid, d.draw, min(e.rule_id) AS rule_id FROM d JOIN e ON d.qid = e.qid AND e.hi > d.u GROUP BY 1, 2),
a AS (SELECT h.qid, h.rule_id, r.rank, h.draw FROM h JOIN r ON h.qid = r.qid AND h.rule_id = r.rule_id UNION ALL SELECT qid, oracle, 1, 0 FROM o)
SELECT qid, rule_id, rank, {PLACED} FROM a""")
def demos_repeated_oracle(spark, sf_dir):
    """Draws with replacement by rank classes, beside the oracle's rule."""
    return augment.sample_demos(ranked_parts(spark, sf_dir), 4, "zipf", "8", 1.0, oracle=_oracle(spark, sf_dir), unique=False)


@query(f"""WITH {RANKED_SQL}, {ORACLE_SQL}, s AS (SELECT r.*, rule_id = oracle AS own, row_number() OVER (PARTITION BY qid ORDER BY 5 - rank + {gumbel_sql("'2|'||qid||'|'||rule_id")} / 2.0 DESC, rank, rule_id) AS pos, least(4, count(*) OVER (PARTITION BY qid)) AS k, floor({uniform_sql("'2|spot|'||qid")} * least(4, count(*) OVER (PARTITION BY qid))) + 1 AS spot FROM r JOIN o USING (qid)),
m AS (SELECT *, bool_or(own AND pos > k) OVER (PARTITION BY qid) AS miss FROM s)
SELECT qid, rule_id, rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN miss AND own THEN spot - 0.5 ELSE pos END DESC) AS INTEGER) AS place FROM m WHERE pos <= k - CASE WHEN miss THEN 1 ELSE 0 END OR own""")
def demos_full_rank_oracle(spark, sf_dir):
    return augment.sample_demos(ranked_parts(spark, sf_dir), 4, "full_rank", "2", oracle=_oracle(spark, sf_dir), beta=2.0)


@query(f"""WITH x AS (SELECT p_partkey AS rule_id, ['a', 'b', 'c'][CAST(floor({uniform_sql("'3|'||p_partkey||'|x1'")} * 3) AS INTEGER) + 1] AS x1, ['a', 'b', 'c'][CAST(floor({uniform_sql("'3|'||p_partkey||'|x2'")} * 3) AS INTEGER) + 1] AS x2 FROM part)
SELECT rule_id, 'r0_1(' || x1 || ',k) ∧ r0_2(' || x2 || ',' || x1 || ') → r1_1(' || x2 || ')' AS statement FROM x""")
def random_constants(spark, sf_dir):
    c = A.parse_clause(F.lit("r0_2(x2,x1) ∧ r0_1(x1,k) → r1_1(x2)"))
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), c["lhs"].alias("lhs"), c["rhs"].alias("rhs"))
    return augment.with_random_constants(rules, ["a", "b", "c"], "3", "rule_id").select("rule_id", A.clause_text(F.col("lhs"), F.col("rhs")).alias("statement"))


@query(f"""WITH u AS (SELECT n_regionkey AS qid, n_nationkey AS rule_id, ['c', 'd'][CAST(floor({uniform_sql("'5|'||n_regionkey||'|'||row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)||'|x1'")} * 2) AS INTEGER) + 1] AS x FROM nation)
SELECT qid, array_to_string(list('k' || rule_id || ' ( ' || x || ' ) → m ( ' || x || ' ) <SEP>' ORDER BY rule_id), ' ') || ' k ( c ) ⊢ m ( c ) <START>' AS prompt, array_to_string(list('k' || rule_id || '(' || x || ') → m(' || x || ')' ORDER BY rule_id), '; ') AS shown FROM u GROUP BY 1""")
def augmented_prompts(spark, sf_dir):
    """All rules of a region before its prompt, with random constants."""
    n = table(spark, sf_dir, "nation")
    prompts = n.select(F.col("n_regionkey").alias("qid")).distinct().withColumn("prompt", T.prompt_tokens(F.array(atom("k", F.lit("c"))), atom("m", F.lit("c"))))
    rules = n.select(F.col("n_nationkey").alias("rule_id"), F.array(F.struct(F.concat(F.lit("k"), "n_nationkey").alias("predicate"), F.array(F.lit("x1")).alias("args"))).alias("lhs"), F.array(atom("m", F.lit("x1"))).alias("rhs"))
    ranked = n.select(F.col("n_regionkey").alias("qid"), F.col("n_nationkey").alias("rule_id"), F.lit(1).alias("rank"))
    out = augment.augment(prompts, ranked, rules, ["c", "d"], 0, 0, "uniform", "5", everything=True)
    return out.select("qid", F.array_join("prompt", " ").alias("prompt"), F.array_join("demo_instances", "; ").alias("shown"))


@query(f"WITH q AS (SELECT DISTINCT p_brand AS qid FROM part) SELECT qid, CAST(2 + floor({uniform_sql("'1|n|'||qid")} * 4) AS INTEGER) AS n_demos FROM q")
def number_of_demos(spark, sf_dir):
    return augment.number_of_demos(table(spark, sf_dir, "part").select(F.col("p_brand").alias("qid")).distinct(), 2, 5, "1")


@query(f"WITH {CUSTOMERS} SELECT key AS qid, CAST(CASE key % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS rule_id FROM u")
def oracle_schemas(spark, sf_dir):
    """Ground rules find their schemas, rank 1 first: schema 3 has the same shape as 2 but rank 1 where both fit."""
    c, k = _customers(spark, sf_dir), F.col("key") % 3
    both = F.when(k == 0, F.struct(F.array(F.col("ants")[0], F.col("ants")[1]).alias("lhs"), F.array(atom("r1_1", "a", "a")).alias("rhs"))).otherwise(F.struct(F.array(atom("r0_1", "a", "b")).alias("lhs"), F.array(atom("r1_2", "b")).alias("rhs")))
    oracle = c.select(F.col("key").alias("qid"), both.alias("g")).select("qid", "g.lhs", "g.rhs")
    bank = unify.bank(spark, [*BANK[:2], "r0_1(x3,x1) → r1_2(x1)"]).select("rule_id", "lhs", "rhs")
    ranked = c.select(F.col("key").alias("qid"), k.alias("k"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rule_id")).withColumn("rank", F.when((F.col("rule_id") == 3) & (F.col("k") == 2), 1).when(F.col("rule_id") == 3, 4).otherwise(2))
    return augment.oracle_schema(ranked.join(F.broadcast(bank), "rule_id"), oracle)


@query("""WITH r AS (SELECT n_regionkey AS key, list('r0_' || n_nationkey || '(x1) → r1_1(x1)' ORDER BY n_nationkey) AS s FROM nation GROUP BY 1)
SELECT key, array_to_string(s, '; ') AS active, CASE WHEN key = 1 THEN 'r1_1(x1) → r2_1(x1)' ELSE '' END AS fixed, s[1] AS demo, CAST(len(s) AS INTEGER) AS n FROM r""")
def rule_contexts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_nationkey").alias("place"), F.format_string("r0_%s(x1) → r1_1(x1)", F.col("n_nationkey").cast("string")).alias("statement"))
    first = n.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where("_n = 1").select("key", "place", "statement", F.lit(1).alias("rank"))
    fixed = spark.createDataFrame([(1, "r1_1(x1) → r2_1(x1)")], "place int, statement string")
    out = augment.rule_context(n.select("key", F.col("key").alias("src_layer")).distinct(), n, fixed, first)
    return out.select("key", F.array_join("active_rule_texts", "; ").alias("active"), F.array_join("fixed_rule_texts", "; ").alias("fixed"), F.col("demo_schema_texts")[0].alias("demo"), F.size("active_rule_texts").alias("n"))


@query()
def cluster_grid(spark, sf_dir):
    """Selection by clusters over a grid of weights, numbers and clusters: brands are the candidates, all parts by price the
    actual query's ranks; a test holds the operator against brute force."""
    brand = F.regexp_extract("qid", r"(\d+)$", 1).cast("long")
    pool = ranked_parts(spark, sf_dir).select(brand.alias("qid"), (F.col("rule_id") + 1).alias("rule_id"), "rank")
    actual = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("rule_id"), (1 + F.floor("p_retailprice") % 4).cast("int").alias("rank"))
    n = actual.agg(F.max("rule_id")).first()[0]
    return cluster.select_grid(pool, actual, n, [0.0, 1.0], [3], [1, 3], "7")


# --- token rows

def _longest(rows, column):
    """Of all rows; the fixed length of the queries below."""
    return rows.agg(F.max(F.size(column))).first()[0] or 1


@query(f"WITH {TURNS_SQL}, m AS (SELECT max(len(prompt)) AS n FROM t) SELECT conv_id, turn, array_to_string(list_resize(prompt, n, 0), ',') AS xs FROM t, m")
def prompt_only_rows(spark, sf_dir):
    r = turn_records(spark, sf_dir)
    return r.select("conv_id", "turn", T.prompt_only(F.concat("prompt", "completion"), _longest(r, "prompt")).alias("xs")).select("conv_id", "turn", *shown("xs"))


@query(f"WITH {TURNS_SQL}, m AS (SELECT max(len(completion)) AS n FROM t) SELECT conv_id, turn, array_to_string(list_resize(completion, n, 9), ',') AS target, CAST(len(completion) AS INTEGER) AS length, CAST(len(completion) - 1 AS INTEGER) AS eot FROM t, m")
def completion_targets(spark, sf_dir):
    r = turn_records(spark, sf_dir)
    d = batches.autoregressive(r).withColumn("t", T.completion_target(F.col("ys"), _longest(r, "completion")))
    return d.select("conv_id", "turn", F.col("t.target").alias("target"), F.col("t.length").alias("length"), T.first_eot(F.col("t.target")).alias("eot")).select("conv_id", "turn", *shown("target"), "length", "eot")


def _predicted(spark, sf_dir):
    """Autoregressive rows, predictions off by one at every third place."""
    r = batches.autoregressive(turn_records(spark, sf_dir))
    return r.withColumn("preds", F.transform("ys", lambda y, i: y + F.when(i % 3 == 0, 1).otherwise(0)))


@query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, len(prompt) - 1 AS k, completion FROM t)
SELECT conv_id, turn, array_to_string(list_transform(completion, lambda y, i: y + CASE WHEN (k + i - 1) % 3 = 0 THEN 1 ELSE 0 END), ',') AS predicted, array_to_string(completion, ',') AS gold FROM s""")
def answer_pairs(spark, sf_dir):
    return T.answer_pairs(_predicted(spark, sf_dir)).select("conv_id", "turn", *shown("predicted", "gold"))


@query(f"""WITH {TURNS_SQL}, s AS (SELECT len(prompt) - 1 AS k, len(completion) AS m FROM t), h AS (SELECT m, len(list_filter(range(m), lambda i: (k + i) % 3 <> 0)) AS ok, (k + m - 1) % 3 <> 0 AS last FROM s)
SELECT round(sum(ok) / sum(m), 6) AS tokens, round(avg(CASE WHEN last THEN 1.0 ELSE 0.0 END), 6) AS final FROM h""")
def final_and_token_accuracy(spark, sf_dir):
    r = _predicted(spark, sf_dir)
    return generation.token_accuracy(r).select(F.round("accuracy", 6).alias("tokens")).join(generation.final_token_accuracy(r).select(F.round("accuracy", 6).alias("final")))


@query(f"WITH {TURNS_SQL} SELECT turn AS distance, count(*) AS records, max(list_max(prompt || completion)) AS max_token, max(len(prompt))::INTEGER AS max_prompt, max(len(completion))::INTEGER AS max_completion, max(len(prompt) + len(completion) - 1)::INTEGER AS max_seq FROM t GROUP BY GROUPING SETS ((turn), ())")
def record_stats(spark, sf_dir):
    return tasks.record_stats(turn_records(spark, sf_dir).withColumnRenamed("turn", "distance"))


@query(f"""WITH s AS (SELECT l_orderkey AS problem_id, count(*) AS distance FROM lineitem GROUP BY 1)
SELECT problem_id, CAST(floor({uniform_sql("'3|'||problem_id")} * distance) AS INTEGER) AS step_idx, distance FROM s""")
def one_step_of_each(spark, sf_dir):
    """An order's lines as steps, one of each by seed."""
    w = Window.partitionBy("l_orderkey")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("problem_id"), (F.row_number().over(w.orderBy("l_linenumber", "l_partkey")) - 1).cast("int").alias("step_idx"), F.count(F.lit(1)).over(w).alias("distance"))
    return tasks.one_step(s, "3").select("problem_id", "step_idx", "distance")


@query(f"WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1) SELECT conv_id, r[CAST(floor({uniform_sql("'6|'||conv_id")} * len(r)) AS INTEGER) + 1] AS completion FROM c")
def one_completion_of_each(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["role"]).alias("completions"))
    return batches.one_completion(c, "6", "conv_id").select("conv_id", "completion")


@query("SELECT event_id, CASE WHEN event_id >= 500 THEN 5 WHEN event_id >= 50 THEN 2 ELSE 1 END AS d_max FROM events WHERE event_id >= 0")
def manual_curriculum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id").where("event_id >= 0")
    return batches.with_phase(e, batches.manual_phases([(0, 1), (50, 2), (500, 5)]), "event_id")


@query("""WITH n AS (SELECT n_nationkey, 'r' || n_regionkey || '_' || n_nationkey AS p FROM nation) SELECT n_nationkey, p, CASE WHEN p LIKE 'r1\\_%' ESCAPE '\\' THEN n_nationkey END AS idx FROM n""")
def predicate_index(spark, sf_dir):
    p = F.concat(F.lit("r"), "n_regionkey", F.lit("_"), "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", p.alias("p"), T.predicate_index(p, 1).cast("long").alias("idx"))


@query("SELECT n_nationkey, 'own' AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'right' ELSE 'left' END AS b, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM nation")
def merged_maps(spark, sf_dir):
    left = F.create_map(F.lit("a"), F.lit("own"), F.lit("b"), F.lit("left"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("right"), F.lit("c"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    m = A.merged(left, right)
    return table(spark, sf_dir, "nation").select("n_nationkey", m["a"].alias("a"), m["b"].alias("b"), F.size(m).alias("n"))


# --- token choice and losses

@query(f"""WITH z AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE / 0.7 + {gumbel_sql("'t|'||vec_id||'|'||(i - 1)")}) AS z FROM embeddings)
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS token FROM z""")
def sampled_token(spark, sf_dir):
    key = F.concat_ws("|", F.lit("t"), F.col("vec_id").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", generation.choose(F.col("embedding"), 0.7, key).alias("token"))


LOGITS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z, label % len(embedding) AS y FROM embeddings), n AS (SELECT *, ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[y + 1] AS ce FROM e)"


@query(f"""WITH {LOGITS} SELECT vec_id, round(greatest(z[1], 0) + ln(1 + exp(-abs(z[1]))) - z[1] * (y % 2), 6) AS bce, round(ce, 6) AS ce, CASE WHEN y <> 0 THEN round(ce, 6) END AS ce_mask, round(pow(z[1] - y % 2, 2), 6) AS mse FROM n""")
def losses_by_name(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("y", F.col("label") % F.size("embedding"))
    one, bit = F.col("embedding")[0], F.col("y") % 2
    value = {"bce": (one, bit), "ce": (F.col("embedding"), F.col("y")), "ce_mask": (F.col("embedding"), F.col("y")), "mse": (one, bit)}
    return e.select("vec_id", *[F.round(generation.loss(k)(*v), 6).alias(k) for k, v in value.items()])


@query(f"WITH {LOGITS} SELECT round(avg(ce), 6) AS loss, round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM n WHERE vec_id % 3 <> 0")
def token_weighted_evaluation(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("logits"), F.when(F.col("vec_id") % 3 == 0, -100).otherwise(F.col("label") % F.size("embedding")).alias("label"))
    m = generation.weighted_evaluation(t)
    return m.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"), "n")


@query("""WITH l AS (SELECT user_id, event_id, 0.05 + 0.9 * (event_id % 10) / 10.0 AS p, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - value AS g FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
w AS (SELECT user_id, p, 1 / (1 + exp(-2.0 * (greatest(g, 0) - 0.005))) AS w FROM l WHERE g IS NOT NULL) SELECT user_id, round(avg(-(w * ln(1 - p) + (1 - w) * ln(p))), 6) AS gate_loss FROM w GROUP BY 1""")
def gate_loss(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    e = e.select("user_id", "event_id", F.col("value").alias("loss"), (F.lit(0.05) + F.lit(0.9) * (F.col("event_id") % 10) / F.lit(10.0)).alias("halt_prob"))
    return generation.gate_loss(e, "user_id", "event_id", 2.0).select("user_id", F.round("gate_loss", 6).alias("gate_loss"))


@query("""WITH h AS (SELECT user_id, event_id, value, 0.05 + 0.9 * (event_id % 10) / 10.0 AS p FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
s AS (SELECT *, exp(coalesce(sum(ln(1 - p)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stay, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS last FROM h),
x AS (SELECT user_id, value, CASE WHEN last THEN stay ELSE p * stay END AS q FROM s), y AS (SELECT user_id, sum(q * value) AS l, -sum(q * ln(greatest(q, 1e-12))) AS h FROM x GROUP BY 1)
SELECT user_id, round(l, 4) AS expected_loss, round(h, 4) AS entropy, round(l - 0.1 * h, 4) AS objective FROM y""")
def halting_loss(spark, sf_dir):
    from .operators.metrics import exit_distribution

    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    e = e.select("user_id", "event_id", F.col("value").alias("loss"), (F.lit(0.05) + F.lit(0.9) * (F.col("event_id") % 10) / F.lit(10.0)).alias("halt_prob"))
    m = generation.halting_loss(exit_distribution(e, "user_id", "event_id"), "user_id", "event_id", 0.1)
    return m.select("user_id", *[F.round(c, 4).alias(c) for c in ("expected_loss", "entropy", "objective")])


@query("WITH m AS (SELECT max(event_id) AS last FROM events) SELECT event_id FROM events, m WHERE event_id % 50 = 0 OR event_id = last")
def evaluation_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return generation.evaluation_steps(e, 50, e.agg(F.max("event_id")).first()[0], "event_id")


@query("SELECT user_id, event_type AS metric, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")
def sweep_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null and event_type is not null")
    return generation.sweep_summary(e.select("user_id", F.col("event_type").alias("metric"), F.col("event_id").alias("step"), "value"), "user_id")


@query("SELECT CAST(c_custkey AS BIGINT) AS key, array_to_string(list_append(list_transform(range(c_custkey % 5), lambda i: 11), 9), ',') AS completion FROM customer")
def greedy_decode(spark, sf_dir):
    """A model that says 11 as often as the prompt's first id tells, then ends."""

    def model(ids):
        import numpy as np

        z = np.zeros((*ids.shape, 12))
        said = (ids == 11).sum(1)
        z[:, :, 11] = 1
        z[said >= ids[:, 0] - 20, :, 9] = 2
        return z

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.array((20 + F.col("c_custkey") % 5).cast("int"), F.lit(T.START)).alias("prompt"))
    return generation.predict(c, model, 16, 8).select("key", *shown("completion"))


@query(f"""WITH {CUSTOMERS}, f AS (SELECT * FROM u WHERE key % 6 = 0 ORDER BY key LIMIT 5)
SELECT key AS problem_id, CAST(2 AS INTEGER) AS distance, CAST(0 AS INTEGER) AS src_layer, {FACTS.replace("sep", "','")} || '⊢r2_1(' || a || ')' AS sequent,
'r0_1(' || a || ',' || b || ') ∧ r0_2(' || b || ',' || a || ') → r1_1(' || a || ',' || a || '); r1_1(' || a || ',' || a || ') → r2_1(' || a || ')' AS statements, CAST(0 AS INTEGER) AS n_demos FROM f""")
def previews(spark, sf_dir):
    """The first five customers' problems for people to read."""
    r = _path_rows(spark, sf_dir).where("key % 6 = 0").select(F.col("key").alias("problem_id"), F.lit(2).alias("distance"), "prompt", "completion")
    return tasks.previews(r, _names(), 5).select("problem_id", "distance", "src_layer", "sequent", F.array_join("statements", "; ").alias("statements"), F.size("demos").alias("n_demos"))
