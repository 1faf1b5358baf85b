"""Words to subword ids by ranked merges of pairs: over the distinct words of a corpus, joined back to its rows."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import PAD, pad_or_trim
from ..session import cut, spread

MOST_BROADCAST = 1_000_000  # rows of a vocabulary or merge table
#: What a text is cut into: endings after an apostrophe, runs of letters, single digits, runs of anything else but white space.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_names() -> list[str]:
    """A printable character for each byte: itself where it is one, the others the first ones from 256 on, in turn."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@dataclass(frozen=True)
class Subwords:
    """A vocabulary of byte-level pair merges with word ends: token, id; and p (both symbols, a space between), rank."""

    vocabulary: DataFrame
    merges: DataFrame
    end: str

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Subwords:
        """From a tokenizer's JSON file, which the driver opens. Only its model is read: other kinds of cutting are not known here."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a vocabulary of byte-level pair merges is needed")
        pairs = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        v = spark.createDataFrame(list(model["vocab"].items()), "token string, id int")
        m = spark.createDataFrame([(p, i) for i, p in enumerate(pairs)], "p string, rank int")
        few = max(len(model["vocab"]), len(pairs)) <= MOST_BROADCAST
        return cls(F.broadcast(v) if few else v, F.broadcast(m) if few else m, model.get("end_of_word_suffix") or "")


def _composed(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def pieces(text: Column) -> Column:
    """A text's pieces in order: composed, small letters, white space dropped; none of a null text."""
    composed = F.arrow_udf(_composed, "string")
    return F.regexp_extract_all(F.lower(composed(F.coalesce(text, F.lit("")))), F.lit(PIECES), F.lit(0))


def _symbols(piece: Column, end: str) -> Column:
    """A piece's bytes by name, each between spaces of its own, so that a pair is one string and pairs share none."""
    names = F.create_map(*[F.lit(x) for b, c in enumerate(byte_names()) for x in (f"{b:02X}", c)])
    pairs = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit(".."), F.lit(0))
    last = F.size(pairs) - 1
    return F.array_join(F.transform(pairs, lambda h, i: F.concat(F.lit(" "), F.element_at(names, h), F.when(i == last, F.lit(end)).otherwise(F.lit("")), F.lit(" "))), "")


def _split(symbols: Column) -> Column:
    return F.split(F.trim(symbols), "  ")


def _merge(s: str, ranks: dict[str, int]) -> str:
    """A piece's symbols after all merges: in turn all places of the pair of least rank, from left to right."""
    while True:
        y = s.strip(" ").split("  ")
        best = min(((ranks[p], p) for p in map(" ".join, zip(y, y[1:])) if p in ranks), default=None)
        if best is None:
            return s
        a, b = best[1].split(" ")
        s = s.replace(f" {a}  {b} ", f" {a}{b} ")


def merged(words: DataFrame, subwords: Subwords) -> DataFrame:
    """piece, ids: distinct pieces (piece) by the merges of the vocabulary. A symbol outside of the vocabulary is an error.

    Merges that are few are broadcast, and tasks merge each piece to its end in one pass; more are joined in ``_rounds``.
    """
    head = subwords.merges.limit(MOST_BROADCAST + 1).collect()
    if len(head) > MOST_BROADCAST:
        done = _rounds(words, subwords)
    else:
        ranks = words.sparkSession.sparkContext.broadcast({r["p"]: r["rank"] for r in sorted(head, key=lambda r: -r["rank"])})
        ends = F.arrow_udf(lambda s: pa.array([_merge(x, ranks.value) for x in s.to_pylist()], pa.string()), "string")
        done = spread(words.select("piece").distinct()).select("piece", ends(_symbols(F.col("piece"), subwords.end)).alias("s"))
    each = done.select("piece", F.posexplode(_split(F.col("s"))).alias("i", "token")).join(subwords.vocabulary, "token", "left")
    known = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("not in the vocabulary: "), "token")).cast("int")).otherwise(F.col("id"))
    return each.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("i", known.alias("id")))).alias("_x")).select("piece", F.transform("_x", lambda x: x["id"]).alias("ids"))


def _rounds(words: DataFrame, subwords: Subwords) -> DataFrame:
    """piece, s: distinct pieces' symbols after all merges, by joins with the table of merges.

    A round merges, in each piece that has a pair of symbols with a rank, all places of its pair of least rank from left to
    right, and writes what is left; pieces without such a pair are done. As many rounds as the longest chain of
    merges, each over the pieces still open.
    """
    state, done = cut(words.select("piece").distinct().withColumn("s", _symbols(F.col("piece"), subwords.end))), None
    while True:
        own = state.withColumn("y", _split(F.col("s")))
        pairs = F.array_distinct(F.zip_with(F.slice("y", F.lit(1), F.size("y") - 1), F.slice("y", F.lit(2), F.size("y")), lambda a, b: F.concat(a, F.lit(" "), b)))
        met = own.select("piece", "s", F.explode_outer(pairs).alias("p")).join(subwords.merges, "p", "left")
        best = met.groupBy("piece", "s").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "p"))).alias("b"))
        old, new = F.concat(F.lit(" "), F.replace(F.col("b.p"), F.lit(" "), F.lit("  ")), F.lit(" ")), F.concat(F.lit(" "), F.replace(F.col("b.p"), F.lit(" "), F.lit("")), F.lit(" "))
        now = cut(best.select("piece", F.when(F.col("b").isNull(), F.col("s")).otherwise(F.replace("s", old, new)).alias("s"), F.col("b").isNull().alias("end")))
        ended = now.where("end").select("piece", "s")
        done = ended if done is None else done.unionByName(ended)
        state = now.where("not end").select("piece", "s")
        if state.isEmpty():
            return done


def subword_ids(rows: DataFrame, text: str, subwords: Subwords, name: str = "ids") -> DataFrame:
    """Adds the ids of each row's text; none where it is null or empty. Rows may repeat, and have columns of any other names.

    Only distinct pieces are merged, whatever their number of places. Special tokens' texts are ordinary text.
    """
    own = cut(rows.select(F.struct(*rows.columns).alias("_row"), pieces(F.col(text)).alias("_pieces"), F.monotonically_increasing_id().alias("_n")))
    words = own.select(F.explode("_pieces").alias("piece")).distinct()
    at = own.select("_n", F.posexplode("_pieces").alias("i", "piece"))
    got = at.join(merged(words, subwords), "piece").groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("_x"))
    out = own.join(got.select("_n", F.flatten(F.transform("_x", lambda x: x["ids"])).alias(name)), "_n", "left")
    return out.select("_row.*", F.coalesce(name, F.array().cast("array<int>")).alias(name))


def model_rows(rows: DataFrame, ids: str, n: int, pad: int = PAD, ignore: int = -100) -> DataFrame:
    """Adds xs, ids cut or padded to ``n``, and ys, the same with ``ignore`` at padding: labels unshifted, prompts not masked."""
    xs = pad_or_trim(F.col(ids), n, pad)
    ys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < F.size(ids), F.get(xs, i)).otherwise(F.lit(ignore)))
    return rows.withColumn("xs", xs).withColumn("ys", ys)
