"""Collocations: merged count-min sketches name the phrases that may be frequent, a last pass counts just those."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, WordHashes, mixed, slices

#: A sketch has two rows of one cell for so many bytes of text, within these bounds; its bitmap is a quarter of a byte a cell.
BYTES_A_CELL, LEAST_CELLS, MOST_CELLS, ROWS = 64, 1 << 16, 1 << 29, 2
BLOCK = 1 << 16  # cells of a sketch that are merged together
HELD = 1 << 22  # hashes that a task holds before it hands on their cells
SHORT = 2  # words of the runs in the first sketch; longer ones are in the second
SLICE = 1 << 22  # bytes of text that are counted together
BREAK = b"\xff"  # no byte of UTF-8
_table = bytes(255 if 10 <= b <= 13 or b in b".,;:!?" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_up = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: list[bytes]) -> pa.Array:
    """Small-lettered words of texts, with a ``BREAK`` between pieces. No word is a Python object: bytes are laid end to end."""
    text = np.frombuffer(BREAK.join(texts).translate(_table).replace(BREAK, b" \xff "), np.uint8)
    keep = np.concatenate([[False], text != 32, [False]])
    edges = np.flatnonzero(keep[1:] != keep[:-1])
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text[keep[1:-1]])])


class Grams:
    """Runs of words of one language in one slice: word numbers, where runs of each length may start, and their hashes."""

    def __init__(self, lang: str, words: pa.Array | list[bytes], hashes: WordHashes):
        self.lang = lang
        numbered = (words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())).dictionary_encode()
        self.kinds = numbered.dictionary
        self.ids = numbered.indices.to_numpy().astype(np.int64)
        self.own = hashes.laid(self.kinds)[self.ids]
        self.word = self.ids != self.kinds.index(BREAK).as_py()
        self.salt = mixed(np.array([zlib.crc32(lang.encode()) + len(lang.encode())], dtype=np.uint64))

    def sizes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: whether a run of it starts at a place, and the runs' hashes, equal wherever and whenever runs are."""
        can, h = self.word, self.own
        for n in range(1, longest + 1):
            if n > 1:
                can = can[:-1] & self.word[n - 1 :]
                h = mixed(h[:-1] * _up + self.own[n - 1 :])
            yield n, can, mixed(h ^ (self.salt * np.uint64(2 * n + 1)))


def _each(batches, limit: int) -> Iterator[Grams]:
    hashes = WordHashes(seed=11)
    for batch in batches:
        for part in slices(batch, limit=limit):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                by.setdefault(lang, []).append(text or b"")
            for lang in list(by):
                yield Grams(lang, _words(by.pop(lang)), hashes)


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.uint32)


def _asked(g: Grams, first: int, longest: int, before: np.ndarray | None) -> Iterator[np.ndarray]:
    """Hashes of the runs of ``first`` to ``longest`` words all of whose runs of ``first`` - 1 words pass the sketch ``before``."""
    held = None
    for n, can, h in g.sizes(longest):
        if n == first - 1:
            can[can] = survivors(before, h[can])
            held = can
        elif n >= first:
            if held is not None:
                can = held = can & held[:-1] & held[1:]
            yield h[can]


def sketch(docs: DataFrame, width: int, least: int, longest: int, first: int = 1, before=None) -> np.ndarray:
    """ROWS bitmaps of ``width`` cells: which cells of the count-min sketch of runs of ``first`` to ``longest`` words reach ``least``.

    ``before``, a broadcast sketch of shorter runs, leaves out runs that hold one that is not frequent.
    A task never holds a whole sketch: it hands on the cells of ``HELD`` hashes at a time, by blocks, as sorted places and counts that
    stop at ``least``, which changes no answer. So what is shuffled follows the text and not the tasks times the cells.
    Blocks are added up in two steps, so that none meets more than about the root of all tasks' blocks.
    The driver gets the bitmaps alone: ROWS * width / 8 bytes.
    """
    kind = np.dtype(np.uint8 if least < 256 else np.uint32)
    tasks = max(1, docs.rdd.getNumPartitions())
    step = max(1, round(tasks**0.5))
    schema = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])

    def packed(at: np.ndarray, n: np.ndarray) -> bytes:
        gaps = np.diff(at, prepend=at[:1]).astype(np.uint16)
        gaps[:1] = at[:1]
        return zlib.compress(gaps.tobytes() + n.astype(kind).tobytes(), 1)

    def cells_of(held: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        for r in range(ROWS):
            at, n = np.unique(_cells(h, r, width), return_counts=True)
            n, block = np.minimum(n, least), at // BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(at)]
            rows = [{"r": r, "b": int(block[a]), "part": part, "cells": packed(at[a:z] % BLOCK, n[a:z])} for a, z in zip(cuts, cuts[1:]) if z > a]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % step
        held, size = [], 0
        for g in _each(batches, SLICE):
            for h in _asked(g, first, longest, before.value if before else None):
                held.append(h)
                size += len(h)
                if size >= HELD:
                    yield from cells_of(held, part)
                    held, size = [], 0
        if size:
            yield from cells_of(held, part)

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("cells"):
            raw = zlib.decompress(x.as_py())
            k = len(raw) // (2 + kind.itemsize)
            at = np.cumsum(np.frombuffer(raw[: 2 * k], np.uint16), dtype=np.int64)
            total[at] = np.minimum(total[at] + np.frombuffer(raw[2 * k :], kind), least)
        return total

    def row(table: pa.Table, cells: bytes) -> pa.Table:
        return pa.Table.from_pylist([{"r": table.column("r")[0].as_py(), "b": table.column("b")[0].as_py(), "part": 0, "cells": cells}], schema)

    def merge(table: pa.Table) -> pa.Table:
        total = added(table)
        at = np.flatnonzero(total)
        return row(table, packed(at, total[at]))

    def end(table: pa.Table) -> pa.Table:
        return row(table, np.packbits(added(table) >= least, bitorder="little").tobytes())

    form = "r int, b int, part int, cells binary"
    out = docs.mapInArrow(build, form).groupBy("r", "b", "part").applyInArrow(merge, form).groupBy("r", "b").applyInArrow(end, form)
    bits = np.zeros((ROWS, width // 8), np.uint8)
    for x in out.toArrow().to_pylist():
        bits[x["r"], x["b"] * BLOCK // 8 : (x["b"] + 1) * BLOCK // 8] = np.frombuffer(x["cells"], np.uint8)
    return bits


def survivors(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), dtype=bool)
    for r in range(len(bits)):
        at = _cells(h, r, bits.shape[1] * 8)
        ok &= (bits[r, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


def counted(g: Grams, short: np.ndarray, long: np.ndarray | None, longest: int) -> Iterator[pa.RecordBatch]:
    """Exact counts within a slice of the runs that may be frequent by the sketches of short and of long runs, and of all words (as phrase '').

    A run is looked up only if both runs one word shorter are in; it is named by the pair of their numbers, so equal
    names are equal words.
    """
    names = ["lang", "phrase", "f"]
    kinds = g.kinds.cast(pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([g.lang]), pa.array([b""], pa.binary()).cast(pa.string()), pa.array([int(g.word.sum())], pa.int64())], names)
    number = None
    for n, can, h in g.sizes(longest):
        if n == 1:
            at = np.flatnonzero(can)
        else:
            before = number >= 0
            at = np.flatnonzero(before[:-1] & before[1:] & can)
        at = at[survivors(short if n <= SHORT else long, h[at])]
        if not len(at):
            return
        code = g.ids[at] if n == 1 else (number[at] << 32) | number[at + 1]
        _, first, own, f = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        number = np.full(len(can), -1, np.int64)
        number[at] = own
        start = at[first]
        words = [kinds.take(pa.array(g.ids[start + j])) for j in range(n)]
        phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, b" ")
        yield pa.RecordBatch.from_arrays([pa.array([g.lang] * len(f)), phrase.cast(pa.string()), pa.array(f, pa.int64())], names)


def frequent(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, f: exact counts of all runs of up to ``longest`` words with f >= ``least``, and with phrase '' each language's words.

    ``docs`` has lang and text, neither null.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))
    short = spark.sparkContext.broadcast(sketch(docs, width, least, min(SHORT, longest)))
    long = spark.sparkContext.broadcast(sketch(docs, width, least, longest, SHORT + 1, short)) if longest > SHORT else None

    def run(batches):
        for g in _each(batches, SLICE):
            yield from counted(g, short.value, long.value if long else None, longest)

    rows = docs.mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def scored(grams: DataFrame, longest: int, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, score of candidates that no longer one subsumes.

    Both parts of every cut meet their counts in one join by (lang, part) with a unique side, which Spark may split;
    a cut's score is worked out in decimals of 38 digits, then floored.
    """
    grams = grams.where("phrase <> ''")
    words = F.split("phrase", " ")
    cand = grams.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where(F.size("w") > 1)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), part(1, k).alias("l"), part(k + 1, longest).alias("r")) for k in range(1, longest)]), lambda c: c["k"] < F.size("w"))
    sides = F.flatten(F.transform(cuts, lambda c: F.array(F.struct(c["k"].alias("k"), F.lit(True).alias("left"), c["l"].alias("part")), F.struct(c["k"].alias("k"), F.lit(False).alias("left"), c["r"].alias("part")))))
    asked = cand.select("lang", "phrase", "a", F.explode(sides).alias("s")).select("lang", "phrase", "a", "s.*")
    met = asked.join(grams.withColumnRenamed("phrase", "part"), ["lang", "part"])
    of = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    own = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *[of(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, longest) for left in (True, False)])
    score = lambda k: F.expr(f"CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l{k} AS DECIMAL(20, 0)) + r{k})")
    worst = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, longest)]), lambda c: c["score"].isNotNull()))
    inner = [(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
    subs = F.array(*[F.when((F.size("w") > n) & (F.size("w") >= i + n - 1), part(i, n)) for i, n in inner])
    over = cand.select("lang", F.explode(F.array_distinct(subs)).alias("phrase"), F.col("a").alias("over")).where("phrase is not null").groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = own.join(over, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("a")))
    return left.select("lang", "phrase", "a", worst.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def best(rows: DataFrame, n: int, total: int) -> DataFrame:
    """Adds rank, 1 to n by language. Shares of about 4 n rows are cut to their first n before a language's rows meet."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(1 + total // (4 * n)))
    rows = rows.withColumn("_s", share).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_n") <= n)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).drop("_s", "_n")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    Letters A-Z are made small, texts split at ``.,;:!?`` and line ends into pieces and these at spaces and tabs into words; a
    phrase lies within a piece. a, l, r are exact counts of the phrase and of the two parts of its worst cut, n of all words
    of the language. Candidates occur ``least`` times or more; those within a longer one that has ``percent`` of a hundred
    of their count go. Null texts have no words, a null language is ``und``. Repeated rows count each time;
    other columns are not read. Ties end at the phrase, by bytes. Without words there are no rows.

    The texts are read four times: for their size, for the sketch of one and two words, for that of longer runs, and for the exact counts.
    A sketch has a cell for 64 bytes of text, so that rare phrases pass it no more often as the input grows, up to 512 million cells (128 MB
    of bitmaps); past 32 GB of text more of them pass, which the exact count then drops: results are the same, with more to shuffle.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        grams = scratch.table(frequent(rows, least, longest))
        kept = scratch.table(scored(grams, longest, percent))
        ranked = best(kept, top, kept.count())
        n = grams.where("phrase = ''").select("lang", F.col("f").alias("n"))
        return scratch.result(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws, unnest([1, 2, 3, 4]) AS m FROM p),
g AS (SELECT lang, m, ws, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, any_value(ws[i:i + m - 1]) AS v, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, phrase, v, m, f AS a FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * k.a) // (x.f + y.f) AS BIGINT) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.v[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.v[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, v, m, a, unnest([2, 3]) AS j FROM c), h AS (SELECT lang, v, a, j, unnest(generate_series(1, m - j + 1)) AS q FROM i WHERE j < m),
o AS (SELECT lang, array_to_string(v[q:q + j - 1], ' ') AS phrase, max(a) AS over FROM h GROUP BY ALL),
e AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE over IS NULL OR 100 * over < 80 * a)
SELECT e.lang, rank, phrase, a, l, r, n, score FROM e JOIN n ON n.lang = e.lang WHERE rank <= 2000"""
