"""One query for each operator, over its whole table and with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, phrases, quality_classifier, quality_rules, substring_dedup, toxicity
from .common import documents, remainder

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = language_id.identify(docs, language_id.train(docs))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(documents(spark, sf_dir), with_text=False)


def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op4_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("copies")


def op5_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = quality_classifier.classify(docs, quality_classifier.train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op8_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return lm_scoring.score(docs, lm_scoring.train(docs))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir), with_text=False)


def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = toxicity.classify(docs, toxicity.train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_phrases(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir))


def op12_fill_middle(spark, sf_dir):
    rows = fill_middle.restored(fill_middle.fill_middle(documents(spark, sf_dir)))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_license_scan(spark, sf_dir):
    return license_scan.license_scan(documents(spark, sf_dir)).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_near_dedup, op4_mixing, op5_packing, op6_exact_dedup, op7_quality_classifier, op8_lm_scoring, op9_quality_rules, op10_toxicity, op11_phrases, op12_fill_middle, op13_license_scan)}

OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, sha256(string_agg(x, ' ') OVER f) AS s, count(*) OVER f AS n FROM pos
        WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
dup AS (SELECT s FROM win WHERE n = 35 GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i AS a FROM win JOIN dup USING (s) WHERE n = 35),
mark AS (SELECT pos.doc_id, pos.i, pos.x, max(starts.a) OVER (PARTITION BY pos.doc_id ORDER BY pos.i ROWS UNBOUNDED PRECEDING) AS last
         FROM pos LEFT JOIN starts ON pos.doc_id = starts.doc_id AND pos.i = starts.a),
flag AS (SELECT doc_id, i, x, last IS NOT NULL AND i < last + 35 AS gone FROM mark),
agg AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM flag GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (doc_id)"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""

ORACLE_SQL = {"op2_substring_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op9_quality_rules": quality_rules.oracle(), "op11_phrases": phrases.SQL, "op12_fill_middle": fill_middle.SQL}
