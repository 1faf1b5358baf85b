"""The corpus pipeline: documents to packed sequences in five stages, each written and read again.

Rows are documents from stage to stage; only the last returns pieces. A document that the quality
classifier rejects goes; of equal texts, and of each group of near duplicates, one document stays; mixing
leaves out documents and repeats others, as whole rows, until sources have their target shares.

Every stage takes rows as they are: a doc_id may be null or repeated, a text null, empty or very long, and rows
may be equal. Decisions are matched to rows by a number that each stage gives them. Columns of other names are
dropped at the first stage, so none can clash with a stage's own. A stage on an empty table returns an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import exact_dedup, mixing, near_dedup, packing, quality_classifier, registry
from lamina.llm.common import Scratch
from lamina.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more. Labels come from ``labels``, texts from ``docs``.

    Null and empty texts are scored as such; equal rows have equal scores and stay or go together.
    """
    model = quality_classifier.train(docs, registry.labels(spark, sf_dir))
    return quality_classifier.classify(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the least doc_id, null last, and one of rows that repeat it.

    Null texts equal empty ones.
    """
    rows = _numbered(docs)
    kept = exact_dedup.exact_dedup(rows.withColumn("_key", _first()), key="_key").where("kept")
    return _stay(rows, kept.select("_key._row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, chosen as in ``exact``.

    Rows linked with nothing, such as those without words, all stay.
    """
    rows = _numbered(docs)
    found = near_dedup.near_dedup(rows, key="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = rows.select("_row", _first().alias("_key")).join(found, "_row").groupBy("component_id").agg(F.min("_key").alias("_key"))
    return _stay(rows, first.select("_key._row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or up to three times. Rows without words are never taken."""
    rows = _numbered(docs)
    taken = mixing.mix(rows, carry=("_row",)).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    rows = rows.join(taken, "_row")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null text is an empty document, of its end id alone."""
    return packing.pack(docs, registry.tokenizer_path())


def _first():
    """The least of these is the row that stays."""
    return F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"), F.col("_row"))


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_row``, unique, as doc_ids may be null or repeated; a written table, so that every reader sees the same numbers."""
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))


def _stay(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources", mixed), ("packing", packed)]

#: No SQL says what a trained classifier, a fitted budget or a tokenizer returns; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.documents(spark, sf_dir)
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
