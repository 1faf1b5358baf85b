"""Named queries of the engine over the test tables, and the SQL that DuckDB runs for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import atoms as A
from .functions import tokens as T
from .functions.chance import gumbel_sql, uniform, uniform_sql
from .operators import batches as B
from .operators import chain, demos, division, metrics, schema_match, unify
from .plans import banks
from .session import spread

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "rank_classify"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def atom(predicate: str, *args):
    return F.struct(F.lit(predicate).alias("predicate"), F.array(*[text(a) for a in args]).alias("args"))


# --- facts: a customer's own, its nation's and its orders'

RULES = ["r0_1(x1,x2) ∧ r0_2(x2,x3) → r1_1(x1,x3)", "r0_3(x1,x2) → r1_2(x1)", "r0_9(x1,x2) → r1_1(x2,x1)", "r0_2(x1,x1) → r1_3(x1,x1)", "r1_1(x1,x2) → r2_1(x2,x1)", "r1_2(x1) → r2_2(x1)"]
LAYERS = [0, 0, 0, 0, 1, 1]


def rules(spark):
    return unify.bank(spark, RULES, LAYERS)


def customer_facts(spark, sf_dir):
    """r0_1(customer, nation), r0_2(nation, region), r0_3(customer, segment): one query per customer."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    all_ = F.array(atom("r0_1", "c_custkey", "c_nationkey"), atom("r0_2", "n_nationkey", "n_regionkey"), atom("r0_3", "c_custkey", "c_mktsegment"))
    return unify.facts_of(j.select(F.col("c_custkey").alias("qid"), all_.alias("atoms")))


@query("""SELECT c_custkey AS qid, 1 AS rule_id, CAST(c_custkey AS VARCHAR) AS x1, CAST(c_nationkey AS VARCHAR) AS x2, CAST(n_regionkey AS VARCHAR) AS x3
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def unify_two_atom(spark, sf_dir):
    r = rules(spark).where("rule_id = 1")
    m = unify.substitutions(customer_facts(spark, sf_dir), r, 2)
    return m.select("qid", "rule_id", *[F.element_at("binding", v).alias(v) for v in ("x1", "x2", "x3")])


@query("SELECT c_custkey AS qid, 4 AS rule_id, CAST(n_nationkey AS VARCHAR) AS x1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = n_regionkey")
def unify_repeated_var(spark, sf_dir):
    m = unify.substitutions(customer_facts(spark, sf_dir), rules(spark).where("rule_id = 4"), 1)
    return m.select("qid", "rule_id", F.element_at("binding", "x1").alias("x1"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b) - 1 AS i FROM f),
m AS (SELECT x.l_orderkey AS qid, x.a AS x1, y.a AS x3, row_number() OVER (PARTITION BY x.l_orderkey ORDER BY x.i, y.i) AS n FROM g x JOIN g y ON x.l_orderkey = y.l_orderkey)
SELECT qid, x1, x3 FROM m WHERE n <= 5""")
def unify_capped(spark, sf_dir):
    """Pairs of an order's lines, facts reusable, the first five in fact order."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(atom("r0_1", "l_linenumber", "l_suppkey")).alias("atoms"))
    m = unify.substitutions(unify.facts_of(own.withColumnRenamed("l_orderkey", "qid")), unify.bank(spark, ["r0_1(x1,x2) ∧ r0_1(x3,x4) → r1_1(x1,x3)"]), 2, cap=5)
    return m.select("qid", F.element_at("binding", "x1").alias("x1"), F.element_at("binding", "x3").alias("x3"))


@query("SELECT c_custkey AS qid, r AS rule_id FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (2), (4)) v(r) WHERE r < 4 OR n_nationkey = n_regionkey")
def applicable_rules_semi(spark, sf_dir):
    return unify.applicable(customer_facts(spark, sf_dir), rules(spark).where("src_layer = 0"), 2)


@query("""WITH f AS (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS have FROM lineitem GROUP BY 1),
r AS (SELECT * FROM (VALUES (1, ['AF']), (2, ['NO', 'RF']), (3, ['AF', 'RF'])) v(rule_id, need))
SELECT l_orderkey, rule_id FROM f, r WHERE list_has_all(have, need)""")
def rule_subset_division(spark, sf_dir):
    """Propositional rules whose left side is a subset of an order's states."""
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.concat("l_returnflag", "l_linestatus").alias("fact"))
    asked = spark.createDataFrame([(1, ["AF"]), (2, ["NO", "RF"]), (3, ["AF", "RF"])], "rule_id int, need array<string>")
    return division.applicable(facts, asked).select(F.col("qid").alias("l_orderkey"), "rule_id")


@query("""SELECT n_nationkey, 'r0_1(' || n_name || ',' || r_name || ') ∧ r0_2(' || r_name || ',' || n_regionkey || ') → r1_1(' || n_name || ',x9)' AS statement
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def instantiate_rules(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    b = F.create_map(F.lit("x1"), "n_name", F.lit("x2"), "r_name", F.lit("x3"), text("n_regionkey"))
    c = A.parse_clause(F.lit("r0_2(x2,x3) ∧ r0_1(x1,x2) → r1_1(x1,x9)"))
    return j.select("n_nationkey", A.clause_text(A.substitute(c["lhs"], b), A.substitute(c["rhs"], b)).alias("statement"))


BANK_SQL = """b AS (SELECT n_nationkey AS rule_id, 0 AS src_layer, 'r1_' || n_regionkey AS gives FROM nation UNION ALL SELECT 1000 + r_regionkey, 1, 'r2_' || (r_regionkey % 2) FROM region),
f AS (SELECT rule_id, src_layer + 1 AS layer, gives AS frontier FROM b UNION ALL SELECT n_nationkey, 2, 'r2_' || (n_regionkey % 2) FROM nation)"""


def trade_rules(spark, sf_dir):
    """A rule from every nation's predicate to its region's, and from every region's on to one of two."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    one = n.select(F.col("n_nationkey").cast("int").alias("rule_id"), F.lit(0).alias("src_layer"), F.format_string("r0_%s(x1) → r1_%s(x1)", text("n_nationkey"), text("n_regionkey")).alias("s"))
    two = r.select((1000 + F.col("r_regionkey")).cast("int").alias("rule_id"), F.lit(1).alias("src_layer"), F.format_string("r1_%s(x1) → r2_%s(x1)", text("r_regionkey"), (F.col("r_regionkey") % 2).cast("string")).alias("s"))
    return one.unionByName(two).withColumn("c", A.parse_clause(F.col("s"))).select("rule_id", "src_layer", "c.lhs", "c.rhs")


@query(f"WITH {BANK_SQL} SELECT rule_id, layer, frontier FROM f")
def reachable_predicates(spark, sf_dir):
    return chain.reachable(trade_rules(spark, sf_dir), 3).select("rule_id", "layer", F.array_join("frontier", ",").alias("frontier"))


@query(f"WITH {BANK_SQL} SELECT rule_id, max((frontier = 'r2_1')::INT) = 1 AS reaches FROM f GROUP BY 1")
def goal_reachable(spark, sf_dir):
    return chain.goal_reachable(trade_rules(spark, sf_dir), "r2_1", 3)


@query("""SELECT c_custkey AS qid, r AS rule_id,
CASE WHEN (r < 3 OR (r = 4 AND n_nationkey = n_regionkey)) AND r IN (1, 3) THEN 1 WHEN r < 3 OR (r = 4 AND n_nationkey = n_regionkey) THEN 2 WHEN r IN (1, 3) THEN 3 ELSE 4 END AS rank
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (2), (3), (4)) v(r)""")
def rank_classify(spark, sf_dir):
    return chain.rank_rules(customer_facts(spark, sf_dir), rules(spark), "r2_1", 2, 3)


@query(f"""WITH m AS (SELECT c_custkey AS qid, n_regionkey, n_nationkey, c_mktsegment, rule_id FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1), (2), (4)) v(rule_id) WHERE rule_id < 4 OR n_nationkey = n_regionkey),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {uniform_sql("'7|'||qid||'|0|'||rule_id")}, rule_id) AS n FROM m),
s AS (SELECT qid, n_nationkey, 0 AS step_idx, rule_id, CASE rule_id WHEN 1 THEN 'r1_1(' || qid || ',' || n_regionkey || ')' WHEN 2 THEN 'r1_2(' || qid || ')' ELSE 'r1_3(' || n_nationkey || ',' || n_nationkey || ')' END AS derived, n_regionkey FROM a WHERE n = 1)
SELECT qid, step_idx, rule_id, derived FROM s
UNION ALL SELECT qid, 1, CASE rule_id WHEN 1 THEN 5 ELSE 6 END, CASE rule_id WHEN 1 THEN 'r2_1(' || n_regionkey || ',' || qid || ')' ELSE 'r2_2(' || qid || ')' END FROM s WHERE rule_id IN (1, 2)""")
def forward_chain(spark, sf_dir):
    c = chain.sample_chain(customer_facts(spark, sf_dir), rules(spark), 2, 2, "7")
    return c.select("qid", "step_idx", "rule_id", A.conjunction_text(F.col("rhs")).alias("derived"))


@query("""SELECT c_custkey AS qid, 'r2_1(' || n_regionkey || ',' || c_custkey || ')' AS state FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, 'r2_2(' || c_custkey || ')' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def exact_steps_reachability(spark, sf_dir):
    return chain.exact_steps(customer_facts(spark, sf_dir), rules(spark), 2, 2).select("qid", A.conjunction_text(F.col("atoms")).alias("state"))


# --- parsing and matching

STATEMENTS = ["r0_1(%1$s,b) ∧ r0_2(b,%2$s) → r1_1(%1$s,%2$s) ∧ r1_2(%2$s,%2$s)", "r3_20(%1$s,bob) → r4_1(%2$s,bob)", "r_a1b2(%1$s,b) → r1_1(%1$s,b)", "r0_2(%1$s,) ∧ r0_1() → r1_1(b)", "r0_1(%1$s → r1_1(a)", "r0_1(a) → r1_1(%1$s) → r2_1(a)", "plain → other"]


@query("""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'r' || n_nationkey || '_' || n_regionkey WHEN 1 THEN 'r_' || lower(n_name) WHEN 2 THEN n_name ELSE 'r' || n_nationkey || '_x' END AS p FROM nation)
SELECT p AS predicate, CASE WHEN regexp_matches(p, '^r[0-9]+_[0-9]+$') THEN CAST(regexp_extract(p, '^r([0-9]+)_', 1) AS INTEGER) WHEN regexp_matches(p, '^r_[a-z0-9]+$') THEN 0 END AS layer FROM n""")
def parse_layer(spark, sf_dir):
    k, n = F.col("n_nationkey") % 4, F.col("n_nationkey")
    name = F.when(k == 0, F.concat(F.lit("r"), n, F.lit("_"), "n_regionkey")).when(k == 1, F.concat(F.lit("r_"), F.lower("n_name"))).when(k == 2, F.col("n_name")).otherwise(F.concat(F.lit("r"), n, F.lit("_x")))
    return table(spark, sf_dir, "nation").select(name.alias("predicate")).select("predicate", A.predicate_layer(F.col("predicate")).alias("layer"))


@query("""WITH p AS (SELECT n_nationkey AS i, 'n' || n_nationkey AS a, 'g' || n_regionkey AS c, n_nationkey % 7 AS k FROM nation)
SELECT i, CASE k WHEN 0 THEN 'r0_1(' || a || ',b) ∧ r0_2(b,' || c || ') → r1_1(' || a || ',' || c || ') ∧ r1_2(' || c || ',' || c || ')' WHEN 1 THEN 'r3_20(' || a || ',bob) → r4_1(' || c || ',bob)' WHEN 2 THEN 'r_a1b2(' || a || ',b) → r1_1(' || a || ',b)'
WHEN 3 THEN 'r0_1 ∧ r0_2(' || a || ') → r1_1(b)' WHEN 6 THEN 'plain → other' END AS canonical, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 1 END AS n_lhs FROM p""")
def parse_clause(spark, sf_dir):
    c, names = A.parse_clause(F.col("s")), [F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("g"), text("n_regionkey"))]
    said = F.get(F.array(*[F.format_string(p, *names) for p in STATEMENTS]), (F.col("n_nationkey") % 7).cast("int"))
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), said.alias("s")).withColumn("c", c)
    return df.select("i", F.when(F.col("c").isNotNull(), A.clause_text(F.col("c.lhs"), F.col("c.rhs"))).alias("canonical"), F.when(F.col("c").isNotNull(), F.size("c.lhs")).alias("n_lhs"))


#: What is said of each customer, by key: its nation and region stand in for b and c.
PREDICTED = ["r0_1(%1$s,%2$s) ∧ r0_2(%2$s,%3$s) → r1_1(%1$s,%3$s)", "r0_1(%1$s,%2$s) ∧ r0_2(%3$s,%2$s) → r1_1(%1$s,%2$s)", "r0_3(%1$s,%2$s) → r1_2(%2$s)", "r0_3(%1$s,%2$s) → r1_2(%1$s)", "r0_7(%1$s,%2$s) → r1_8(%1$s)", "r0_1(%1$s → r1_1"]
MATCH_SQL = """m AS (SELECT c_custkey AS key, c_custkey % 6 AS k FROM customer), r AS (SELECT key, CASE k WHEN 0 THEN 1 WHEN 3 THEN 2 END AS rule_id, k = 5 AS decode_error, k IN (1, 2) AS unknown, k = 4 AS wrong, k IN (0, 3) AS correct FROM m)"""


def _said(spark, sf_dir, patterns):
    """key and c, a customer's statement: one of the patterns by key, of customer, nation and region."""
    c, n = spread(table(spark, sf_dir, "customer")), table(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    names = [F.concat(F.lit(p), text(x)) for p, x in (("c", "c_custkey"), ("n", "c_nationkey"), ("g", "n_regionkey"))]
    said = F.get(F.array(*[F.format_string(p, *names) for p in patterns]), (F.col("c_custkey") % len(patterns)).cast("int"))
    return j.select(F.col("c_custkey").alias("key"), said.alias("statement"))


def _matched(spark, sf_dir):
    """Statements against the bank: exact instance of which rule, structure, decode errors."""
    from .operators import evaluate

    said = _said(spark, sf_dir, PREDICTED).select("key", F.lit(0).alias("src_layer"), "statement", F.lit(None).cast("string").alias("expected"))
    return evaluate.match_rules(said, rules(spark)).select("key", F.col("pos").alias("rule_id"), "decode_error", "unknown", "wrong", "correct")


@query(f"WITH {MATCH_SQL} SELECT * FROM r")
def match_rules(spark, sf_dir):
    return _matched(spark, sf_dir)


@query(f"""WITH {MATCH_SQL} SELECT count(*) AS n, count(*) FILTER (decode_error) AS n_decode_error, count(*) FILTER (unknown) AS n_unknown, count(*) FILTER (wrong) AS n_wrong, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT decode_error AND NOT unknown) AS n_valid,
round(count(*) FILTER (decode_error) / count(*), 6) AS decode_error_rate, round(count(*) FILTER (unknown) / count(*), 6) AS unknown_rate, round(count(*) FILTER (wrong) / count(*), 6) AS wrong_rate, round(count(*) FILTER (correct) / count(*), 6) AS correct_rate,
round(count(*) FILTER (decode_error OR unknown) / count(*), 6) AS invalid_rate, round(count(*) FILTER (correct) / count(*) FILTER (NOT decode_error AND NOT unknown), 6) AS correct_given_valid FROM r""")
def match_metrics(spark, sf_dir):
    m = metrics.match_metrics(_matched(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


SHAPES = ["u(k%1$s,k%2$s) → w(k%1$s,k%1$s)", "u(%1$s,%2$s) → w(%2$s,%1$s)", "v(%2$s,c) ∧ u(%1$s,%2$s) → w(%1$s,c)", "u(%1$s,%2$s) ∧ u(%2$s,c) → w(%1$s,c)", "u(%1$s) → u(%1$s)", "z(%1$s) → a(%1$s)"]


@query("""SELECT c_custkey AS key, CASE c_custkey % 6 WHEN 0 THEN n_nationkey = n_regionkey WHEN 1 THEN true WHEN 2 THEN true WHEN 5 THEN true ELSE false END AS matched FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def schema_match_rules(spark, sf_dir):
    """Rules of other predicates with the structure of one of the bank's; in every sixth only if nation and region are numbered alike."""
    c, n = spread(table(spark, sf_dir, "customer")), table(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    own = [F.format_string(p, text("n_nationkey"), text("n_regionkey")) if p.startswith("u(k") else F.format_string(p, F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("g"), "n_regionkey")) for p in SHAPES]
    r = j.select(F.col("c_custkey").alias("key"), A.parse_clause(F.get(F.array(*own), (F.col("c_custkey") % 6).cast("int"))).alias("c"))
    return schema_match.schema_matches(r.select("key", "c.lhs", "c.rhs"), rules(spark))


def _paths(spark, sf_dir):
    """An order as a path: placed, then shipped by its lines' states, with a goal of all returned or closed."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("states"), F.max("l_returnflag").alias("flag"))
    none = F.array().cast("array<string>")
    s1 = F.struct(F.lit(True).alias("known"), F.array(F.lit("placed")).alias("lhs"), F.concat(F.array(F.lit("sent")), F.col("states")).alias("rhs"))
    s2 = F.struct((F.col("flag") != "N").alias("known"), F.array(F.lit("O")).alias("lhs"), F.array(F.lit("done")).alias("rhs"))
    return li.select(F.col("l_orderkey").alias("path_id"), F.array(F.lit("placed")).alias("facts"), F.lit("done").alias("goal"), F.array(s1, s2).alias("steps")).withColumn("_", none).drop("_")


PATH_SQL = """WITH p AS (SELECT l_orderkey AS path_id, bool_or(l_linestatus = 'O') AS o, max(l_returnflag) AS flag FROM lineitem GROUP BY 1),
r AS (SELECT path_id, flag <> 'N' AND o AS success, 2 AS n_steps, CASE WHEN flag = 'N' THEN 'unknown_rule' WHEN NOT o THEN 'inapplicable' ELSE '' END AS reason FROM p)"""


@query(PATH_SQL + " SELECT * FROM r")
def path_validate(spark, sf_dir):
    return chain.validate_path(_paths(spark, sf_dir))


@query(PATH_SQL + " SELECT count(*) AS n, count(*) FILTER (success) AS n_success, count(*) FILTER (reason = 'unknown_rule') AS n_unknown, count(*) FILTER (reason = 'inapplicable') AS n_inapplicable, round(avg(n_steps), 6) AS avg_steps FROM r")
def path_metrics(spark, sf_dir):
    v = chain.validate_path(_paths(spark, sf_dir))
    return v.agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.count_if(F.col("reason") == "unknown_rule").alias("n_unknown"), F.count_if(F.col("reason") == "inapplicable").alias("n_inapplicable"), F.round(F.avg("n_steps"), 6).alias("avg_steps"))


# --- demonstrations: parts of a brand as ranked rules

RANKED_SQL = "r AS (SELECT p_brand AS qid, p_partkey AS rule_id, 1 + p_size % 4 AS rank FROM part)"


def ranked_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("qid"), F.col("p_partkey").alias("rule_id"), (1 + F.col("p_size") % 4).alias("rank"))


@query(f"WITH {RANKED_SQL} SELECT qid, rule_id, rank, round(pow(rank, -1.5) / sum(pow(rank, -1.5)) OVER (PARTITION BY qid), 9) AS weight FROM r")
def zipf_per_rule_weights(spark, sf_dir):
    return demos.rank_weights(ranked_parts(spark, sf_dir), 1.5).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {RANKED_SQL}, w AS (SELECT *, pow(rank, -1.0) / count(*) OVER (PARTITION BY qid, rank) AS w FROM r WHERE rank <> 1)
SELECT qid, rule_id, rank, round(w / sum(w) OVER (PARTITION BY qid), 9) AS weight FROM w""")
def zipf_rank_weights(spark, sf_dir):
    return demos.rank_weights(ranked_parts(spark, sf_dir), 1.0, per_rule=False, without=(1,)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {RANKED_SQL}, w AS (SELECT *, pow(rank, -1.5) / sum(pow(rank, -1.5)) OVER (PARTITION BY qid) AS weight FROM r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY ln(weight) + {gumbel_sql("'3|'||qid||'|'||rule_id")} DESC, rule_id) AS INTEGER) AS draw FROM w)
SELECT qid, rule_id, rank, draw FROM k WHERE draw <= 8""")
def weighted_topk_gumbel(spark, sf_dir):
    return demos.sample_distinct(demos.rank_weights(ranked_parts(spark, sf_dir), 1.5), 8, "3").select("qid", "rule_id", "rank", "draw")


@query(f"""WITH {RANKED_SQL}, w AS (SELECT *, pow(rank, -1.0) / sum(pow(rank, -1.0)) OVER (PARTITION BY qid) AS weight FROM r),
e AS (SELECT *, sum(weight) OVER (PARTITION BY qid ORDER BY rule_id ROWS UNBOUNDED PRECEDING) AS hi FROM w),
d AS (SELECT DISTINCT qid, i AS draw, {uniform_sql("'5|'||qid||'|'||i")} AS u FROM r, range(1, 5) t(i))
SELECT d.qid, CAST(d.draw AS INTEGER) AS draw, min(e.rule_id) AS rule_id FROM d JOIN e ON d.qid = e.qid AND e.hi > d.u GROUP BY 1, 2""")
def weighted_with_replacement(spark, sf_dir):
    return demos.sample_repeated(demos.rank_weights(ranked_parts(spark, sf_dir), 1.0), 4, "5").select("qid", "draw", "rule_id")


@query(f"WITH {RANKED_SQL} SELECT qid, rule_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank + {gumbel_sql("'9|'||qid||'|'||rule_id")} / 2.0 DESC, rule_id) AS INTEGER) AS place FROM r")
def rank_order_beta(spark, sf_dir):
    return demos.order_demos(ranked_parts(spark, sf_dir), 2.0, "9").select("qid", "rule_id", "place")


@query(f"WITH {RANKED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, rule_id) AS n FROM r) SELECT qid, rule_id, rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY n DESC) AS INTEGER) AS place FROM k WHERE n <= 6")
def full_rank_topk(spark, sf_dir):
    return demos.full_rank_top(ranked_parts(spark, sf_dir), 6)


@query(f"SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY {uniform_sql("'1|'||c_custkey")}, c_custkey) AS INTEGER) AS chunk FROM customer")
def split_ntile(spark, sf_dir):
    return B.split_chunk(table(spark, sf_dir, "customer"), "c_custkey", 7, "1").select("c_custkey", "chunk")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * 100).cast("int")).alias("v"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 100::FLOAT) AS INTEGER)) AS v FROM embeddings)
SELECT q.vec_id AS i, x.vec_id AS j, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: abs(p[1] - p[2]))) AS DOUBLE) AS d FROM v q JOIN v x ON q.vec_id % 50 = 0""")
def footrule_matrix(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return demos.distances(v, v.where("vec_id % 50 = 0"))


def seeded(rows: DataFrame, key: str, n: int, seed: str) -> list:
    """``n`` keys by seeded hash."""
    return [r[0] for r in rows.select(key).distinct().orderBy(uniform(F.concat_ws("|", F.lit(seed), key)), key).limit(n).collect()]


@query()
def k_medoids(spark, sf_dir):
    """Parts, by size and price, by the nearest of four medoids, from seeded ones until none moves; a test holds it against brute force."""
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.array("p_size", F.floor(F.col("p_retailprice") / 10).cast("int")).alias("v"))
    return demos.k_medoids(v, seeded(v, "vec_id", 4, "3"))[0]


@query(f"""WITH {RANKED_SQL}, g AS (SELECT a, n FROM (VALUES (0.0), (1.0), (2.0)) x(a), (VALUES (2), (4)) y(n)),
w AS (SELECT qid, a, n, rule_id, rank, row_number() OVER (PARTITION BY qid, a, n ORDER BY -a * ln(rank) + {gumbel_sql("'2|'||qid||'|'||rule_id")} DESC, rule_id) AS draw FROM r, g)
SELECT CAST(a AS DOUBLE) AS alpha, n AS n_demos, round(avg(rank), 6) AS mean_rank, count(*) AS demos FROM w WHERE draw <= n GROUP BY 1, 2""")
def param_sweep(spark, sf_dir):
    """A grid of weights and numbers of demonstrations; the noise is one for all settings."""
    from .functions.chance import gumbel

    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(n).alias("n_demos")) for a in (0.0, 1.0, 2.0) for n in (2, 4)])
    r = ranked_parts(spark, sf_dir).withColumn("g", gumbel(F.concat_ws("|", F.lit("2"), "qid", "rule_id"))).withColumn("p", F.explode(grid)).select("*", "p.*")
    w = Window.partitionBy("qid", "alpha", "n_demos").orderBy(F.desc(-F.col("alpha") * F.log("rank") + F.col("g")), "rule_id")
    return r.withColumn("draw", F.row_number().over(w)).where("draw <= n_demos").groupBy("alpha", "n_demos").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.count(F.lit(1)).alias("demos"))


# --- tokens: turns of conversations and words of documents

WORDS_OF = r"[\x20\x09-\x0D]+"


@query("""WITH n AS (SELECT DISTINCT 'r' || n_regionkey || '_' || n_nationkey AS p, replace(n_name, ' ', '') AS c FROM nation),
w AS (SELECT c AS token, 0 AS part FROM n UNION SELECT unnest(string_split(p, '')), 1 FROM n),
t AS (SELECT token, min(part) AS part FROM w GROUP BY 1),
s AS (SELECT token, CAST(9 + row_number() OVER (ORDER BY part, token) AS INTEGER) AS id FROM t)
SELECT * FROM s UNION ALL SELECT * FROM (VALUES ('<PAD>',0),('⊢',1),('∧',2),('→',3),('(',4),(')',5),(',',6),('<SEP>',7),('<START>',8),('<EOT>',9)) v(token, id)""")
def vocab_build(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    p = n.select(F.concat(F.lit("r"), "n_regionkey", F.lit("_"), "n_nationkey").alias("name"), F.lit(True).alias("is_predicate"))
    return T.vocabulary(p.unionAll(n.select(F.regexp_replace("n_name", " ", ""), F.lit(False))))


@query("""SELECT n_nationkey, 'r ' || array_to_string(string_split(CAST(n_regionkey AS VARCHAR), ''), ' ') || ' _ 1 ( ' || n_name || ' a ) ⊢ r 9 _ 2 ( a ) <START>' AS tokens FROM nation""")
def tokenize_prompt(spark, sf_dir):
    ant = F.struct(F.concat(F.lit("r"), "n_regionkey", F.lit("_1")).alias("predicate"), F.array(F.col("n_name"), F.lit("a")).alias("args"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(T.prompt_tokens(F.array(ant), atom("r9_2", F.lit("a"))), " ").alias("tokens"))


@query("""SELECT n_nationkey, 'n ( ' || n_nationkey || ' ) ∧ m ( a b ) → r 1 _ 1 ( a ) <SEP> n ( ' || n_nationkey || ' ) → q <EOT>' AS tokens FROM nation""")
def encode_completion(spark, sf_dir):
    one = atom("n", "n_nationkey")
    first = T.clause_tokens(F.array(one, atom("m", F.lit("a"), F.lit("b"))), F.array(atom("r1_1", F.lit("a"))))
    second = T.clause_tokens(F.array(one), F.array(F.struct(F.lit("q").alias("predicate"), F.array().cast("array<string>").alias("args"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(T.completion_tokens(F.array(first, second)), " ").alias("tokens"))


def turn_records(spark, sf_dir):
    """Each turn's word lengths (from 10 on) as ids: the conversation's first turn prompts, every later turn completes."""
    ids = lambda c: F.transform(F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != ""), lambda w: F.length(w) + 10)
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", ids("text").alias("ids"))
    first = c.groupBy("conv_id").agg(F.min_by("ids", "turn").alias("p"), F.min("turn").alias("t0"))
    j = c.join(first, "conv_id").where("turn > t0")
    return j.select("conv_id", "turn", F.concat("p", F.array(F.lit(T.START))).alias("prompt"), F.concat("ids", F.array(F.lit(T.EOT))).alias("completion"))


TURNS_SQL = r"""c AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''), lambda w: CAST(length(w) + 10 AS INTEGER)) AS ids FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, arg_min(ids, turn) AS p, min(turn) AS t0 FROM c GROUP BY 1),
t AS (SELECT c.conv_id, turn, list_append(p, 8) AS prompt, list_append(ids, 9) AS completion FROM c JOIN f USING (conv_id) WHERE turn > t0)"""


def shown(*names):
    return [F.array_join(n, ",").alias(n) for n in names]


@query(f"WITH {TURNS_SQL}, u AS (SELECT *, prompt || completion AS a FROM t) SELECT conv_id, turn, array_to_string(a[:-2], ',') AS xs, array_to_string(list_transform(a[2:], lambda y, i: CASE WHEN i < len(prompt) THEN 0 ELSE y END), ',') AS ys FROM u")
def ar_shift_mask(spark, sf_dir):
    return B.autoregressive(turn_records(spark, sf_dir)).select("conv_id", "turn", *shown("xs", "ys"))


@query(f"""WITH {TURNS_SQL}, m AS (SELECT *, max(greatest(len(prompt), len(completion))) OVER (PARTITION BY conv_id) AS n FROM t)
SELECT conv_id, turn, array_to_string(list_resize(prompt, n, 0), ',') AS xs, array_to_string(list_resize(completion, n, 9), ',') AS ys FROM m""")
def all_at_once_pad(spark, sf_dir):
    r = B.all_at_once(turn_records(spark, sf_dir)).withColumn("batch_id", F.col("conv_id"))
    return B.padded(r, y_pad=T.EOT).select("conv_id", "turn", *shown("xs", "ys"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, array_to_string(list_concat(flatten(list(list_append(completion[:-2], 7) ORDER BY turn)), any_value(prompt)), ',') AS row FROM t GROUP BY 1")
def prepend_demos(spark, sf_dir):
    """Completions in turn as demonstrations before the prompt."""
    r = turn_records(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "completion"))).alias("d"), F.first("prompt").alias("prompt"))
    return r.select("conv_id", F.array_join(T.prepend(F.transform("d", lambda x: x["completion"]), F.col("prompt")), ",").alias("row"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, CAST(2 AS INTEGER) AS n_segments, array_to_string(prompt, ',') AS first_segment, array_to_string(completion, ',') AS last_segment FROM t")
def split_segments(spark, sf_dir):
    r = turn_records(spark, sf_dir).withColumn("s", T.segments(F.concat("prompt", F.array(F.lit(7)), "completion", F.array(F.lit(0), F.lit(0)))))
    return r.select("conv_id", "turn", F.size("s").alias("n_segments"), F.array_join(F.col("s")[0], ",").alias("first_segment"), F.array_join(F.element_at("s", -1), ",").alias("last_segment"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, turn, array_to_string(completion, ',') AS row, array_to_string(list_resize(completion, 16, 0), ',') AS fixed, array_to_string(list_transform(prompt, lambda y: CASE WHEN y = 8 THEN -100 ELSE y END), ',') AS labels FROM t")
def truncate_eot(spark, sf_dir):
    r = turn_records(spark, sf_dir)
    row = T.up_to_eot(F.concat("completion", F.array(F.lit(5), F.lit(9))))
    labels = T.remapped_labels(F.transform("prompt", lambda y: F.when(y == 8, 0).otherwise(y)))
    return r.select("conv_id", "turn", F.array_join(row, ",").alias("row"), F.array_join(T.pad_or_trim(F.col("completion"), 16), ",").alias("fixed"), F.array_join(labels, ",").alias("labels"))


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), ',') AS roles FROM conversations")
def suffix_completions(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, Window.unboundedFollowing)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ",").alias("roles"))


@query("SELECT doc_id, n_chars, CAST(CASE WHEN n_chars <= 1 THEN 1 ELSE pow(2, length(bin(n_chars - 1))) END AS BIGINT) AS bucket FROM documents")
def pow2_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.next_power(F.col("n_chars")).alias("bucket"))


@query(f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {uniform_sql("'43|'||doc_id")}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, r // 32 AS batch_id, CAST(r % 32 AS INTEGER) AS row_idx FROM o WHERE r // 32 < n // 32""")
def shuffle_batches(spark, sf_dir):
    return B.shuffled_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32, 42, epoch=1).select("doc_id", "batch_id", "row_idx")


@query("SELECT lang, count(*) AS records, max(n_chars) AS max_chars, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), ())")
def dataset_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return d.groupingSets([[F.col("lang")], []], "lang").agg(F.count(F.lit(1)).alias("records"), F.max("n_chars").alias("max_chars"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, CASE WHEN event_id >= 700 THEN 4 WHEN event_id >= 300 THEN 3 WHEN event_id >= 100 THEN 2 ELSE 1 END AS d_max FROM events WHERE event_id >= 0")
def curriculum_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id").where("event_id >= 0")
    return B.with_phase(e, B.exponential_phases(1, 4, 100, 2.0), "event_id")


# --- scores

@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS choice FROM embeddings")
def argmax_choice(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", metrics.argmax(F.col("embedding")).alias("choice"))


NLL_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z, label % len(embedding) AS y FROM embeddings), n AS (SELECT vec_id, y, ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[y + 1] AS nll FROM e)"


def _logits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("logits"), (F.col("label") % F.size("embedding")).alias("label"))


@query(f"WITH {NLL_SQL} SELECT vec_id, round(nll, 6) AS nll FROM n")
def nll(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(metrics.nll(F.col("logits"), F.col("label")), 6).alias("nll"))


@query(f"WITH {NLL_SQL} SELECT round(sum(nll) FILTER (y <> 0) / count(*) FILTER (y <> 0), 6) AS masked_ce FROM n")
def masked_ce(spark, sf_dir):
    return metrics.masked_loss(_logits(spark, sf_dir)).select(F.round("masked_ce", 6).alias("masked_ce"))


CONF_SQL = f"c AS (SELECT doc_id, quality, toxic, {uniform_sql("'c|'||doc_id")} AS conf FROM labels)"


def _conf(spark, sf_dir):
    return table(spark, sf_dir, "labels").withColumn("conf", uniform(F.concat_ws("|", F.lit("c"), "doc_id"))).withColumn("correct", (F.col("conf") >= 0.5).cast("int") == F.col("quality"))


@query(f"""WITH {CONF_SQL}, b AS (SELECT greatest(ceil(conf * 10), 1) AS b, count(*) AS n, avg(CASE WHEN (conf >= 0.5)::INT = quality THEN 1.0 ELSE 0.0 END) AS acc, avg(conf) AS conf FROM c GROUP BY 1)
SELECT round(sum(abs(acc - conf) * n) / sum(n), 6) AS ece FROM b""")
def ece10(spark, sf_dir):
    return metrics.calibration_error(_conf(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {CONF_SQL} SELECT round(avg(CASE WHEN (conf >= 0.5)::INT = quality THEN 1.0 ELSE 0.0 END) FILTER (quality <> 0), 6) AS token_accuracy, round(avg(CASE WHEN (conf >= 0.5)::INT = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM c")
def token_accuracy(spark, sf_dir):
    ok = F.col("correct").cast("double")
    return _conf(spark, sf_dir).agg(F.round(F.avg(F.when(F.col("quality") != 0, ok)), 6).alias("token_accuracy"), F.round(F.avg(ok), 6).alias("accuracy"))


@query("""WITH b AS (SELECT doc_id // 32 AS b, avg(quality) AS m, count(*) AS n, sum(quality) AS s FROM labels GROUP BY 1)
SELECT round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS weighted_mean FROM b""")
def weighted_vs_unweighted_mean(spark, sf_dir):
    b = table(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 32)).agg(F.avg("quality").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("quality").alias("s"))
    return b.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.sum("s") / F.sum("n"), 6).alias("weighted_mean"))


EXIT_SQL = """h AS (SELECT user_id, event_id, 0.05 + 0.9 * (event_id % 10) / 10.0 AS p FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, exp(coalesce(sum(ln(1 - p)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stay, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS last FROM h),
x AS (SELECT user_id, event_id, CASE WHEN last THEN stay ELSE p * stay END AS q FROM s)"""


def _exits(spark, sf_dir):
    h = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", (F.lit(0.05) + F.lit(0.9) * (F.col("event_id") % 10) / F.lit(10.0)).alias("halt_prob"))
    return metrics.exit_distribution(h, "user_id", "event_id")


@query(f"WITH {EXIT_SQL} SELECT user_id, event_id, round(q, 6) AS exit_prob FROM x")
def exit_distribution(spark, sf_dir):
    return _exits(spark, sf_dir).select("user_id", "event_id", F.round("exit_prob", 6).alias("exit_prob"))


@query(f"WITH {EXIT_SQL} SELECT user_id, round(-sum(q * ln(greatest(q, 1e-12))), 5) AS entropy, round(sum(q), 5) AS total FROM x GROUP BY 1")
def exit_entropy(spark, sf_dir):
    q = F.col("exit_prob")
    return _exits(spark, sf_dir).groupBy("user_id").agg(F.round(-F.sum(q * F.log(F.greatest(q, F.lit(1e-12)))), 5).alias("entropy"), F.round(F.sum(q), 5).alias("total"))


@query("""WITH l AS (SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - value AS gain FROM events WHERE user_id IS NOT NULL)
SELECT user_id, event_id, round(1 / (1 + exp(-5.0 * (gain - 0.01))), 6) AS target FROM l WHERE gain IS NOT NULL""")
def act_improvement_lag(spark, sf_dir):
    """Target of a halting gate: a sigmoid of how much the last step improved."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", (F.lag("value").over(w) - F.col("value")).alias("gain"))
    return e.where("gain is not null").select("user_id", "event_id", F.round(1 / (1 + F.exp(-5.0 * (F.col("gain") - 0.01))), 6).alias("target"))


@query("SELECT count(*) AS shared FROM (SELECT text FROM benchmark INTERSECT SELECT text FROM documents)")
def split_disjointness(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("text").distinct().join(table(spark, sf_dir, "documents").select("text"), "text", "left_semi").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'rule_gen' ELSE 'pred_gen' END AS mode, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'eval_rule' ELSE 'eval_pred' END AS pool FROM customer")
def hybrid_pool_routing(spark, sf_dir):
    """Each customer's mode, and the pools that the mode draws on."""
    modes = F.create_map(*[F.lit(x) for i, m in enumerate(("train", "rule_gen", "pred_gen")) for x in (i, m)])
    pools = F.create_map(*[x for m, own in banks.POOLS.items() for x in (F.lit(m), F.array(*map(F.lit, own)))])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(modes, (F.col("c_custkey") % 3).cast("int")).alias("mode"))
    return c.select("c_custkey", "mode", F.explode(F.element_at(pools, F.col("mode"))).alias("pool"))


@query("""WITH m AS (SELECT avg(quality)::DOUBLE AS q, avg(toxic)::DOUBLE AS t, count(*)::DOUBLE AS n FROM labels)
SELECT 'eval/quality' AS metric, round(q, 6) AS value, CAST(NULL AS VARCHAR) AS text FROM m UNION ALL SELECT 'eval/toxic', round(t, 6), NULL FROM m UNION ALL SELECT 'eval/n', n, NULL FROM m UNION ALL SELECT 'eval/none', NULL, 'NaN'""")
def metric_flatten(spark, sf_dir):
    m = table(spark, sf_dir, "labels").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count(F.lit(1)).alias("n"), F.lit(float("nan")).alias("none"))
    return metrics.flatten_metrics(m, "eval")


# --- closed loops, selection by clusters, length bounds

ROLL_SQL = """r AS (SELECT c_custkey AS qid, c_custkey % 6 AS k, c_custkey, c_nationkey, n_regionkey, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT qid, k = 0 AS success, CASE k WHEN 1 THEN 'decode_error' WHEN 2 THEN 'wrong_rule' WHEN 3 THEN 'unknown_rule' WHEN 4 THEN 'inapplicable' WHEN 5 THEN 'goal_not_reached' END AS reason,
CAST(CASE WHEN k IN (0, 5) THEN 2 ELSE 1 END AS INTEGER) AS n_steps, CAST(CASE WHEN k IN (0, 5) THEN 2 ELSE 0 END AS INTEGER) AS final_layer,
CASE WHEN k = 0 THEN 'r2_1(c' || n_regionkey || ',c' || c_custkey || ')' WHEN k = 5 THEN 'r2_2(c' || c_custkey || ')' ELSE 'r0_1(c' || c_custkey || ',c' || c_nationkey || ') ∧ r0_2(c' || c_nationkey || ',c' || n_regionkey || ') ∧ r0_3(c' || c_custkey || ',c' || seg || ')' END AS final_facts FROM r)"""


def _rollouts(spark, sf_dir):
    """A scripted model over the customers: one in six goes right, the others fail in one way each."""
    from .operators.rollout import rollout

    c, n = spread(table(spark, sf_dir, "customer")), table(spark, sf_dir, "nation")
    name = lambda x: F.concat(F.lit("c"), text(x))
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    facts = F.array_sort(F.array(atom("r0_1", name("c_custkey"), name("c_nationkey")), atom("r0_2", name("c_nationkey"), name("n_regionkey")), atom("r0_3", name("c_custkey"), name("c_mktsegment"))))
    examples = j.select(F.col("c_custkey").alias("qid"), F.lit(0).alias("start_layer"), facts.alias("facts"), atom("r2_1", name("n_regionkey"), name("c_custkey")).alias("goal"))

    def scripted(rows):
        k, f = F.col("qid") % 6, lambda i: F.col("facts")[i]
        args = lambda i, at: f(i)["args"][at]
        say = F.format_string
        first = F.when(k == 0, say("r0_1(%s,%s) ∧ r0_2(%s,%s) → r1_1(%s,%s)", args(0, 0), args(0, 1), args(1, 0), args(1, 1), args(0, 0), args(1, 1)))
        first = first.when(k == 1, "r0_1(a → r1_1").when(k == 2, say("r0_7(%s,%s) → r1_8(%s)", args(2, 0), args(2, 1), args(2, 0))).when(k == 3, "r0_1(a) → r1_1(a) ∧ r1_2(a)")
        first = first.when(k == 4, "r0_3(nobody,b) → r1_2(nobody)").otherwise(say("r0_3(%s,%s) → r1_2(%s)", args(2, 0), args(2, 1), args(2, 0)))
        then = F.when(k == 0, say("r1_1(%s,%s) → r2_1(%s,%s)", args(0, 0), args(0, 1), args(0, 1), args(0, 0))).otherwise(say("r1_2(%s) → r2_2(%s)", args(0, 0), args(0, 0)))
        return rows.withColumn("answer", F.when(F.col("step") == 0, first).otherwise(then))

    return rollout(examples, rules(spark), scripted, 2, 2)


@query("WITH " + ROLL_SQL + " SELECT * FROM o")
def rollout_loop(spark, sf_dir):
    return _rollouts(spark, sf_dir).drop("steps")


@query("WITH " + ROLL_SQL + """ SELECT count(*) AS n, count(*) FILTER (success) AS n_success, count(*) FILTER (reason = 'decode_error') AS n_decode_error, count(*) FILTER (reason = 'unknown_rule') AS n_unknown_rule,
count(*) FILTER (reason = 'wrong_rule') AS n_wrong_rule, count(*) FILTER (reason = 'inapplicable') AS n_inapplicable, count(*) FILTER (reason = 'goal_not_reached') AS n_goal_not_reached, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(n_steps), 6) AS avg_steps FROM o""")
def rollout_metrics(spark, sf_dir):
    from .operators.rollout import rollout_metrics as summed

    m = summed(_rollouts(spark, sf_dir))
    return m.select(*[c for c in m.columns if c.startswith("n")], F.round("success_rate", 6).alias("success_rate"), F.round("avg_steps", 6).alias("avg_steps"))


@query()
def cluster_select(spark, sf_dir):
    """Candidates are all brands' top demonstrations; each brand is served by the nearest medoid among them. Brands have the ids in their names."""
    ranked = ranked_parts(spark, sf_dir).withColumn("qid", F.regexp_extract("qid", r"(\d+)$", 1).cast("int"))
    shown = demos.full_rank_top(ranked, 3)
    n = ranked.agg(F.max("rule_id")).first()[0]
    return demos.cluster_select(shown, shown, ranked, n, 4, seeded(shown, "qid", 2, "5"))


@query("""WITH p AS (SELECT DISTINCT n_regionkey AS a, n_nationkey AS b FROM nation)
SELECT 'p' || a || '_' || b AS token, CAST(9 + row_number() OVER (ORDER BY a, b) AS INTEGER) AS id FROM p
UNION ALL SELECT * FROM (VALUES ('<PAD>',0),('⊢',1),('∧',2),('→',3),('(',4),(')',5),(',',6),('<SEP>',7),('<START>',8),('<EOT>',9)) v(token, id)""")
def proposition_vocab(spark, sf_dir):
    return T.proposition_vocabulary(table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), "n_regionkey", F.lit("_"), "n_nationkey").alias("name")))


@query("SELECT turn AS turn, conv_id, CASE role WHEN 'user' THEN '21,22,0' ELSE '23,22,0' END AS xs, CASE role WHEN 'user' THEN '21,22,-100' ELSE '23,22,-100' END AS ys FROM conversations")
def retokenize(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for p in {11: "user", 12: "other", 13: "said"}.items() for x in p])
    row = F.array(F.lit(T.START), F.when(F.col("role") == "user", 11).otherwise(12), F.lit(13), F.lit(T.EOT))
    r = T.retokenized(row, names, T.id_map({"user": 21, "said": 22, "other": 23}), 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", F.array_join(F.col("r.xs").cast("array<string>"), ",").alias("xs"), F.array_join(F.col("r.ys").cast("array<string>"), ",").alias("ys"))


@query("""WITH r AS (SELECT 'r0_' || n_nationkey AS l, 'r1_' || n_regionkey AS r FROM nation UNION ALL SELECT 'r1_' || r_regionkey, 'r2_' || (r_regionkey % 2) FROM region),
m AS (SELECT CAST(max(greatest(length(l), length(r))) + 3 AS INTEGER) AS a, CAST(max(length(l) + length(r)) + 7 AS INTEGER) AS c FROM r)
SELECT a AS max_atom, 4 * a + 4 + c + 1 AS max_prompt, c + 1 AS max_completion, 4 * a + 4 + c + 1 + c AS n_seq FROM m""")
def length_bounds(spark, sf_dir):
    r = trade_rules(spark, sf_dir)
    each = F.explode(F.concat("lhs", "rhs")).alias("a")
    arities = r.select(each).select(F.col("a.predicate").alias("predicate"), F.size("a.args").alias("arity")).distinct()
    return T.length_bounds(r, arities, 3, n_demos=1, steps=1)


@query("""WITH r AS (SELECT o_custkey % 7 AS a, o_custkey % 5 AS b, o_orderkey % 3 AS s FROM orders), u AS (SELECT s, x, y FROM (VALUES (0), (1), (2)) t(s), (VALUES (0), (1), (2)) v(x), (VALUES (0), (1)) w(y) WHERE x >= s)
SELECT round(avg(CASE WHEN u.s IS NULL THEN 0.0 ELSE 1.0 END), 6) AS membership FROM r LEFT JOIN u ON r.s = u.s AND a = x AND b = y""")
def rule_membership(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("set_id"), F.array((F.col("o_custkey") % 7).cast("int"), (F.col("o_custkey") % 5).cast("int")).alias("pred"))
    sets = spark.createDataFrame([(s, [x, y], x >= s) for s in range(3) for x in range(3) for y in range(2)], "set_id int, rule array<int>, used boolean")
    return metrics.rule_membership(o, sets).select(F.round("membership", 6).alias("membership"))


from . import evaluation_queries, table_queries  # noqa: E402, F401  they register theirs
