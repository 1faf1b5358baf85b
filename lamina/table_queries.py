"""Named queries of the engine's later parts: nested metrics, bounded matching, as-of phases, batches by tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import propositions as P
from .functions import tokens as T
from .functions.chance import uniform_sql
from .operators import batches, budget, division, nested, subwords, unify
from .queries import WORDS_OF, atom, query, table
from .session import new_folder
from .sources import record_files as records

NESTED_SQL = """WITH e AS (SELECT event_id, event_type, value, user_id, CAST(props->>'$.k' AS DOUBLE) AS k FROM events),
r AS (SELECT event_id, 'log/event/' || event_type || '/value' AS metric, value, CAST(NULL AS VARCHAR) AS text FROM e WHERE value IS NOT NULL
UNION ALL SELECT event_id, 'log/event/' || event_type || CASE WHEN event_id % 3 = 0 THEN '/props/k' ELSE '/k' END, k, NULL FROM e WHERE k IS NOT NULL
UNION ALL SELECT event_id, 'log/user/id', user_id, NULL FROM e WHERE user_id IS NOT NULL
UNION ALL SELECT event_id, 'log/user/even', (user_id % 2 = 0)::INT, NULL FROM e WHERE user_id IS NOT NULL
UNION ALL SELECT event_id, 'log/kind', NULL, event_type FROM e WHERE event_id % 2 = 0)
SELECT event_id, metric, CAST(value AS DOUBLE) AS value, text FROM r"""


@query(NESTED_SQL)
def nested_metrics(spark, sf_dir):
    """Events as JSON whose shape follows from the row, flattened without a schema."""
    e = table(spark, sf_dir, "events")
    inner = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"props":'), "props")).otherwise(F.concat(F.lit('"k":'), F.get_json_object("props", "$.k")))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    even = F.coalesce((F.col("user_id") % 2 == 0).cast("string"), F.lit("null"))
    kind = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"kind":"'), "event_type", F.lit('"'))).otherwise(F.lit(',"kind":null'))
    text = F.concat(F.lit('{"event":{"'), "event_type", F.lit('":{"value":'), number("value"), F.lit(","), inner, F.lit('}},"user":{"id":'), number("user_id"), F.lit(',"even":'), even, F.lit('},"all":[1,{"x":2}]'), kind, F.lit("}"))
    return nested.metric_rows(e.select("event_id", F.parse_json(text).alias("m")), ["event_id"], "m", "log")


# --- matching


@query("""WITH l AS (SELECT DISTINCT l_linestatus AS qid, l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
a AS (SELECT DISTINCT qid, o, p FROM l), b AS (SELECT DISTINCT qid, p, s FROM l), c AS (SELECT DISTINCT qid, s, o FROM l)
SELECT a.qid, CAST(a.o AS VARCHAR) AS x1, CAST(a.p AS VARCHAR) AS x2, CAST(b.s AS VARCHAR) AS x3 FROM a JOIN b ON a.qid = b.qid AND a.p = b.p JOIN c ON c.qid = a.qid AND c.o = a.o AND c.s = b.s""")
def unify_triangle(spark, sf_dir):
    """Orders, their parts and those of their suppliers that supply such a part to anyone: a cycle of three atoms in two large queries."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("qid"), "l_orderkey", "l_partkey", "l_suppkey")
    atoms = [atom("r0_1", "l_orderkey", "l_partkey"), atom("r0_2", "l_partkey", "l_suppkey"), atom("r0_3", "l_suppkey", "l_orderkey")]
    facts = reduce(DataFrame.union, [li.select("qid", a.alias("a")).select("qid", "a.*") for a in atoms])  # one after the other: an atom reads its own part alone
    m = unify.substitutions(facts, unify.bank(spark, ["r0_1(x1,x2) ∧ r0_2(x2,x3) ∧ r0_3(x3,x1) → r1_1(x1,x2,x3)"]), 3, cap=None, used=False)
    return m.select("qid", *[F.col("binding")[v].alias(v) for v in ("x1", "x2", "x3")])


# --- order: phases, batches by tokens


@query("""WITH p AS (SELECT o_custkey AS user_id, o_orderkey AS start, CAST(max(1 + o_orderkey % 5) AS INTEGER) AS d_max FROM orders GROUP BY 1, 2)
SELECT e.event_id, e.user_id, p.d_max FROM (SELECT * FROM events WHERE user_id IS NOT NULL) e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.event_id >= p.start
UNION ALL SELECT event_id, user_id, NULL FROM events WHERE user_id IS NULL""")
def phases_of_users(spark, sf_dir):
    """Events as steps, under the phase that their user's last order has begun."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("start"), (1 + F.col("o_orderkey") % 5).cast("int").alias("d_max"))
    return batches.with_phase_of(table(spark, sf_dir, "events").select("event_id", "user_id"), o, ["user_id"], "event_id")


BUDGET = 32768
LENGTHS_SQL = f"""n AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, n, greatest(n, 1) - 1 AS m, greatest(length(bin(greatest(n, 1) - 1)) - 3, 0) AS sh FROM n),
c AS (SELECT doc_id, n, least(((m >> sh) + 1) << sh, {BUDGET}) AS pad_to, {uniform_sql("'b|'||doc_id")} AS u FROM s)"""
PADDED_SQL = f"""{LENGTHS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pad_to ORDER BY u, doc_id) - 1 AS r, {BUDGET} // pad_to AS k FROM c),
b AS (SELECT pad_to, (max(r // k) + 1)::BIGINT AS many FROM r GROUP BY 1), o AS (SELECT pad_to, coalesce(sum(many) OVER (ORDER BY pad_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM b),
t AS (SELECT doc_id, n, pad_to, base + r // k AS batch_id, CAST(r % k AS INTEGER) AS row_idx FROM r JOIN o USING (pad_to))"""


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), WORDS_OF), lambda w: w != "")).cast("long").alias("n"))


@query(f"WITH {PADDED_SQL} SELECT * FROM t")
def token_budget_batches(spark, sf_dir):
    """Documents in padded batches of at most 32,768 words."""
    return budget.token_batches(_lengths(spark, sf_dir), "doc_id", "n", BUDGET, "b")


@query(f"WITH {PADDED_SQL} SELECT count(DISTINCT batch_id) AS batches, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(pad_to) AS BIGINT) AS padded, round(1 - sum(n) / sum(pad_to), 9) AS share FROM t")
def token_budget_padding(spark, sf_dir):
    p = budget.padding(token_budget_batches(spark, sf_dir), "n")
    return p.withColumn("share", F.round("share", 9))


@query(f"""WITH {LENGTHS_SQL}, r AS (SELECT *, CAST(coalesce(sum(greatest(n, 1)) OVER (PARTITION BY pad_to ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // ({BUDGET} - pad_to + 1) AS k FROM c),
b AS (SELECT pad_to, max(k) + 1 AS many FROM r GROUP BY 1), o AS (SELECT pad_to, coalesce(sum(many) OVER (ORDER BY pad_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM b)
SELECT base + k AS batch_id, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens FROM r JOIN o USING (pad_to) GROUP BY 1""")
def ragged_budget_batches(spark, sf_dir):
    """Batches of as many documents as 32,768 words hold without padding."""
    b = budget.token_batches(_lengths(spark, sf_dir), "doc_id", "n", BUDGET, "b", ragged=True)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))


# --- files


@query("SELECT doc_id, lang, n_chars, sha256(text) AS text_sha256 FROM documents")
def record_files(spark, sf_dir):
    """Documents written as record files indexed by length, and read back."""
    path = new_folder(spark)
    records.register(spark)
    table(spark, sf_dir, "documents").write.format("records").option("index", "n_chars").mode("append").save(path)
    return spark.read.format("records").load(path).select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"))


# --- subwords


@query()
def retokenize_subwords(spark, sf_dir):
    """Turns of conversations as rows of 256 subword ids and their labels; no SQL says what ranked merges make of a word."""
    import public_tokenizers

    own = subwords.Subwords.load(spark, public_tokenizers.path("word_bpe_49k.json"))
    r = subwords.model_rows(subwords.subword_ids(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", own), "ids", 256)
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return r.select("conv_id", "turn", F.size("ids").alias("n"), shown("xs"), shown("ys"))


# --- propositions


@query("""WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber AS k FROM lineitem)
SELECT l_orderkey, string_agg(CAST(9 + k AS VARCHAR), ',6,' ORDER BY k) || ',1,' || (17 + l_orderkey % 5) || ',8' AS ids,
string_agg('p0_' || k, ';' ORDER BY k) AS ants, 'p1_' || (l_orderkey % 5) AS cons FROM f GROUP BY l_orderkey""")
def proposition_rows(spark, sf_dir):
    """Every order's lines as antecedents of a sequent, to ids by the vocabulary of all lines, and decoded from them."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("k"), (F.col("l_orderkey") % 5).cast("string").alias("goal"))
    named = line.select(F.explode(F.array(F.concat(F.lit("p0_"), "k"), F.concat(F.lit("p1_"), "goal"))).alias("name")).distinct()
    vocabulary = T.collected(T.proposition_vocabulary(named))
    ants = F.array_join(F.transform(F.array_sort(F.collect_set(F.col("k").cast("int"))), lambda k: F.concat(F.lit("p0_"), k.cast("string"))), ",")
    rows = line.groupBy("l_orderkey", "goal").agg(ants.alias("a")).withColumn("row", P.prompt_ids(F.concat("a", F.lit("⊢p1_"), "goal"), T.id_map(vocabulary)))
    read = rows.withColumn("d", P.decode_prompt(F.col("row"), T.name_map(vocabulary)))
    return read.select("l_orderkey", F.array_join(F.col("row").cast("array<string>"), ",").alias("ids"), F.array_join("d.ants", ";").alias("ants"), "d.cons")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS x FROM orders UNION SELECT DISTINCT o_custkey, o_orderstatus FROM orders),
n AS (SELECT DISTINCT l_suppkey AS r, o_orderpriority AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 UNION
SELECT DISTINCT l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45),
size AS (SELECT r, count(*) AS k FROM n GROUP BY r)
SELECT c AS qid, CAST(r AS BIGINT) AS rule_id FROM f JOIN n USING (x) JOIN size USING (r) GROUP BY c, r, k HAVING count(*) = k""")
def rules_by_division(spark, sf_dir):
    """Suppliers of large lines as rules that need all priorities and states of their orders, against each customer's."""
    o = table(spark, sf_dir, "orders")
    states = F.explode(F.array("o_orderpriority", "o_orderstatus"))
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    asked = large.select(F.col("l_suppkey").cast("long").alias("rule_id"), states.alias("x")).groupBy("rule_id").agg(F.collect_set("x").alias("need"))
    return division.applicable(o.select(F.col("o_custkey").alias("qid"), states.alias("fact")), asked)
