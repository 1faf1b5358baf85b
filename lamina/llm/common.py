"""Helpers shared by the operators: scratch tables, words, distributed ranks, training rows."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, delete, new_folder

#: Words are maximal runs without these characters; bytes.split() splits at just these six.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Groups that hold at least this share of all rows are hot: at most as many as the share goes into one.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Scratch(contextlib.AbstractContextManager):
    """Tables written to the shared folder while a query is built; all go when the block ends.

    ``table`` cuts lineage with a Parquet table. Its joins are merge joins at every size of the input, which
    Spark splits where they are skewed, unless the other side is marked for broadcast. ``result`` is the last
    thing in a block: a table that stays until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, new_folder(spark), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/t{self.n}"
        df.write.parquet(at)
        self.spark._jvm.System.gc()  # Spark's cleaner frees shuffle files only of plans that the driver has collected
        return self.spark.read.schema(df.schema).parquet(at).hint("merge")

    def result(self, df: DataFrame) -> DataFrame:
        return cut(df)

    def drop(self, df: DataFrame) -> None:
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.startswith(self.path) or self.path.removeprefix("file://") in at:
                delete(self.spark, at)

    def __exit__(self, *_):
        delete(self.spark, self.path)


def long_key(docs: DataFrame, key: str):
    """The key as a long; other types than whole numbers are an error at once, not a task's."""
    kind = docs.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{key} is of type {kind}; keys are whole numbers")
    return F.col(key).cast("long")


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups``, a written table with one row for each value of ``keys``, which holds its size as ``n``.

    Rows of hot groups, of which there are at most ``HOT``, meet them by broadcast where they lie, so no key of
    a shuffle holds more than a thousandth of all ``total`` rows. Keys are not null.
    """
    hot = F.broadcast(groups.where(F.col(n) * HOT >= total).withColumn("_hot", F.lit(True)))
    cold = groups.where(F.col(n) * HOT < total)
    new = [c for c in groups.columns if c not in keys]
    both = rows.join(hot, keys, "left")
    left = both.where("_hot is null").drop("_hot", *new).join(cold, keys, how)
    return both.where("_hot").drop("_hot").unionByName(left)


def remainder(column: str, n: int):
    """crc32(column as text) mod n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def ranked(df: DataFrame, keys: list[str], counts: DataFrame, total: int, seed: int, order: list[str]) -> DataFrame:
    """Adds ``rank``, 0 to count - 1 within ``keys``, in an order that ``seed`` and ``order`` fix.

    ``counts`` is a written table of ``keys``, ``count`` (and more columns, which stay); ``total`` rows in all.
    No group meets in one task: a group of c rows is dealt by hash into about sqrt(c) buckets, buckets are
    counted and their counts summed up, and only a bucket's own rows are sorted together.
    """
    d = meet(df, counts, keys, "count", total).withColumn("_h", F.xxhash64(*order, F.lit(seed)))
    d = d.withColumn("_b", F.pmod(F.col("_h"), F.ceil(F.sqrt("count")).cast("long")))
    d = d.repartition(*keys, "_b")  # else Spark is content with the join's dealing by keys alone
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    base = n.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_b").orderBy("_h", *order)
    d = d.join(base.hint("merge"), [*keys, "_b"]).withColumn("rank", F.col("_base") + F.row_number().over(within) - 1)
    return d.drop("_h", "_b", "_base")


def training_ids(labels: DataFrame, label: str, folds: int, held: int, bound: int, seed: int = 7) -> DataFrame:
    """At most ``bound`` labelled doc_ids outside the held-out fold, the same in every run.

    A doc_id that comes with both labels is left out; repeated rows count once.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", folds) != held))
    h = F.xxhash64("doc_id", F.lit(seed))
    n = rows.select("doc_id").distinct().count()
    if n > bound:  # thinned first, so that the limit below sees few rows from each task
        rows = rows.where(F.pmod(h, F.lit(1_000_000)) < int(min(1.0, 1.5 * bound / n) * 1_000_000))
    rows = rows.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("_z")).where("y = _z")
    return rows.select("doc_id", "y").orderBy(h, "doc_id").limit(bound)


def one_row(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``columns`` of one row for each key, that of least hash."""
    best = F.min(F.struct(F.xxhash64(*columns).alias("_h"), *columns))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))


def training_rows(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """doc_id, text, y: one row of ``docs`` for each of ``ids``, however many rows repeat an id."""
    met = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")  # broadcast: a bound's rows at most
    return one_row(met, "doc_id", ["text", "y"])


def slices(batch, column: int = 1, limit: int = 1 << 20):
    """Rows of an Arrow batch in slices whose texts hold about ``limit`` bytes, so that Python sees few at once."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class WordHashes:
    """64-bit hashes of words (bytes), in turn, with a cache that is emptied when full."""

    most_laid = 64  # bytes of a word that are hashed in step with other words'

    def __init__(self, seed: int = 0, most: int = 400_000):
        import xxhash

        self.known: dict[bytes, int] = {}
        self.hash, self.seed, self.most = xxhash.xxh3_64_intdigest, seed, most

    def __call__(self, words: list[bytes]):
        import numpy as np

        known, f, seed = self.known, self.hash, self.seed
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = f(w, seed)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def laid(self, words):
        """Other hashes, of a large binary Arrow array's words, for all of them at once: a polynomial over their bytes, then mixed."""
        import numpy as np

        if not len(words):
            return np.zeros(0, np.uint64)
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        data, start, size = np.frombuffer(data, np.uint8), offsets[:-1], np.diff(offsets)
        h = np.full(len(words), self.seed + 1, np.uint64)
        live = np.flatnonzero(size <= self.most_laid)
        for j in range(self.most_laid):
            live = live[size[live] > j]
            if not len(live):
                break
            h[live] = h[live] * np.uint64(0x9E3779B97F4A7C15) + data[start[live] + j] + np.uint64(1)
        for i in np.flatnonzero(size > self.most_laid).tolist():
            h[i] = self.hash(data[offsets[i] : offsets[i + 1]].tobytes(), self.seed)
        return mixed(h)


class Rolling:
    """Hashes of runs of words: a polynomial modulo 2**64 over word hashes, then mixed."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = None

    def sums(self, h):
        import numpy as np

        n = len(h) + 1
        if self.up is None or len(self.up) < n:
            m = max(n, 1 << 18)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)])) for b in (self.base, self.inverse))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.up[: n - 1])])

    def of(self, sums, start, stop):
        """Hash of the words start to stop - 1, for arrays of both."""
        return mixed((sums[stop] - sums[start]) * self.down[start])


def mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
