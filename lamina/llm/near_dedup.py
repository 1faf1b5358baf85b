"""Near duplicates by min-max hashing: of every permutation both the least and the greatest value are kept."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, WordHashes, long_key, meet, mixed, slices
from .components import components

WORDS = 5
BANDS, ROWS = 60, 6  # values a signature: BANDS * ROWS, from half as many permutations
FEW, PART = 16, 640  # most sets of a shingle whose pairs a plain join makes; rows of a part of more
SHORT = 32  # sets of fewer shingles are joined exactly, by their rarest shingles
_rolling, _digest = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


def shingles(words: list[bytes], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; of all words if they are fewer; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    sums = _rolling.sums(hashes(words))
    size = min(size, n)
    at = np.arange(n - size + 1)
    return np.unique(_rolling.of(sums, at, at + size) ^ np.uint64(size))


class MinMax:
    """Band keys of a set. A permutation is x -> x * a + b modulo 2**64, cut to its upper half."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        n = (bands * rows + 1) // 2
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, n, dtype=np.uint64)
        self.salt = r.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.weights = r.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, x: np.ndarray) -> np.ndarray:
        """Least and greatest value of each permutation, side by side."""
        lo = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        hi = np.zeros(len(self.a), dtype=np.uint64)
        for at in range(0, len(x), 1024):
            v = x[None, at : at + 1024] * self.a[:, None]
            v += self.b[:, None]
            np.minimum(lo, v.min(1), out=lo)
            np.maximum(hi, v.max(1), out=hi)
        return np.stack([lo, hi], axis=1).ravel() >> np.uint64(32)

    def keys(self, x: np.ndarray) -> np.ndarray:
        s = self.signature(x)[: self.bands * self.rows].reshape(self.bands, self.rows)
        return mixed(mixed((s * self.weights).sum(1, dtype=np.uint64)) ^ self.salt).view(np.int64)


def _read(bands: int, rows: int, longest: int):
    import zstandard

    def run(batches):
        pack, hashes, family, n = zstandard.ZstdCompressor(level=3), WordHashes(), MinMax(bands, rows), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for s in slices(batch):
                out = [[] for _ in range(7)]
                for t in s.column(1).cast(pa.binary()).to_pylist():
                    words = (t or b"").lower().split()
                    x = shingles(words, hashes)
                    one = int(_digest.of(_digest.sums(x), np.array([0]), np.array([len(x)]))[0]) if len(x) else 0
                    two = int(_digest.of(_digest.sums(mixed(x)), np.array([0]), np.array([len(x)]))[0]) if len(x) else 0
                    for column, v in zip(out, (part << 32 | n, len(x), one, two, family.keys(x) if len(x) else None, pack.compress(b" ".join(words)), x.view(np.int64) if 0 < len(x) <= longest else None)):
                        column.append(v)
                    n += 1
                rid, size, one, two, keys, payload, short = out
                longs = [np.array(c, dtype=np.uint64).view(np.int64) for c in (one, two)]
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), s.column(0), pa.array(size, pa.int64()), *map(pa.array, longs), pa.array(keys, pa.list_(pa.int64())), pa.array(payload, pa.binary()), pa.array(short, pa.list_(pa.int64()))], ["rid", "doc_id", "n", "d1", "d2", "keys", "payload", "short"])

    return run


def _hashed():
    """From rid, n, comp, payload: a row for each shingle of the text."""

    def run(batches):
        import zstandard

        opener, hashes = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            for s in slices(batch, 3):
                sets = [shingles(opener.decompress(p.as_py()).split(), hashes) for p in s.column(3)]
                each = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([*(s.column(i).take(each) for i in range(3)), pa.array(np.concatenate(sets).view(np.int64))], ["rid", "n", "comp", "s"])

    return run


def _fits(na, pa_, nb, pb, percent: int):
    """Whether sets whose first common shingle lies at ``pa_`` and ``pb`` of their orders can be alike: as many
    as the shorter rest holds can be common at most, and alike sets have percent / (100 + percent) of both sizes."""
    least = percent * (na + nb)
    return (100 + percent) * (na - pa_) >= least, (100 + percent) * (nb - pb) >= least, 100 * na >= percent * nb, 100 * nb >= percent * na


def _across(percent: int):
    """Pairs of one unit whose components differ and whose sizes and places leave the similarity possible.

    A unit holds part of the rows with one shingle: rows of its largest component (``main``) and others, or others alone.
    """

    def run(t: pa.Table) -> pa.Table:
        rid, comp, n, p = (t.column(c).to_numpy() for c in ("rid", "comp", "n", "p"))
        main, left = t.column("main").to_numpy(zero_copy_only=False), t.column("left").to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~main)
        against = np.flatnonzero(main) if main.any() else np.arange(len(rid))
        out = []
        for x in others:
            y = against[comp[against] != comp[x]]
            if not main.any():  # others among themselves: each pair once, and only of different parts if the unit has two
                y = y[(rid[y] < rid[x]) & ((left[y] != left[x]) | (t.column("alone")[0].as_py()))]
            y = y[np.logical_and.reduce(_fits(n[x], p[x], n[y], p[y], percent))]
            out.append(np.stack([np.maximum(rid[y], rid[x]), np.minimum(rid[y], rid[x])]))
        a, b = np.concatenate(out, axis=1) if out else np.empty((2, 0), dtype=np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _set(payload: bytes, opener) -> set:
    words = opener.decompress(payload).split()
    if len(words) < WORDS:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(WORDS))))


def _confirm(percent: int):
    """Pairs with both texts: those whose full sets of word shingles are alike, as those of equal words are."""

    def run(batches):
        import zstandard

        opener, last = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for y, p, q in zip(b, batch.column(2), batch.column(3)):
                if p == q:
                    ok.append(True)
                    continue
                if y not in last:
                    if len(last) > 64:
                        last.clear()
                    last[y] = _set(q.as_py(), opener)
                s, t = _set(p.as_py(), opener), last[y]
                both = len(s & t)
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)], ["a", "b"])

    return run


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of lower-cased word 5-shingles have a Jaccard similarity of
    ``percent`` / 100 or more, and components are those of these links.

    1. One pass over the texts makes each set's digest and its band keys from min-max signatures. Documents
       whose digests are equal and whose full sets have been compared and are equal are one class from here on.
    2. A class weighs as much as its buckets hold together, and a bucket's heaviest class is its leader. Each
       class is first confirmed, on the full sets, against the heaviest of its leaders, which makes
       components; then against its other leaders, but for those that are in its component by now.
    3. In buckets that still hold several components, the classes are searched for pairs of different
       components by their rarest shingles: two sets that are alike must share one of the first of either,
       and where they lie in the order bounds how many they can have in common. The bounds are exact, so
       every pair that shares a bucket and is alike is found, whatever the size of the bucket; what they
       leave is confirmed on the full sets. A bucket of near copies costs as many pairs as it has members,
       not their square, and unlike texts around one passage have no rare shingle in common.

    Buckets are found by partial sums, and rows meet them in joins with written tables, which Spark splits
    where they are skewed. With the default bands a pair of large sets at exactly 0.75 shares no
    bucket with a chance of eight in a million, one at 0.8 with one in 80 million. In small sets the least and
    the greatest shingle, which are different ones, rarer both agree (3.3e-4 for 3 of 4 shingles), so sets of
    fewer than ``SHORT`` shingles have more buckets, one for each of their rarest shingles. Pairs with such a set are all found, whatever the hashing.

    Null and wordless texts have an empty set and are linked with nothing. Repeated rows are linked as equal
    documents. A null doc_id is never a component's id unless all are null. Other columns are not read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    longest = (SHORT - 1) * 100 // percent  # sets that can be alike to a short one
    with Scratch(spark) as scratch:
        schema = "rid long, doc_id long, n long, d1 long, d2 long, keys array<long>, payload binary, short array<long>"
        read = scratch.table(docs.select(long_key(docs, key), F.col(text)).mapInArrow(_read(bands, rows, longest), schema))
        same = read.where("n > 0").groupBy("n", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("rep")).where("c > 1")
        same = scratch.table(same.select("n", "d1", "d2", "c", "rep"))
        digests = meet(read.select("rid", "n", "d1", "d2"), same, ["n", "d1", "d2"], "c", read.count())
        pairs = scratch.table(digests.where("rid <> rep").select(F.col("rid").alias("a"), F.col("rep").alias("b")))
        equal = scratch.table(_links(pairs, read.select("rid", "n", "payload"), 100).select(F.col("a").alias("rid"), F.col("b").alias("rep")))
        scratch.drop(same)
        scratch.drop(pairs)
        rows_ = read.select("rid", "doc_id", "n", "keys", "short").join(equal, "rid", "left")
        alone = F.col("rep").isNull()
        member = scratch.table(rows_.select("rid", "doc_id", "n", F.coalesce("rep", "rid").alias("rep"), F.when(alone, F.col("keys")).alias("keys"), F.when(alone, F.col("short")).alias("short")))

        # 2. buckets of several classes, and the pairs with their leaders
        rare = _rarest(member, percent, scratch)
        held = member.where("keys is not null").select("rid", F.posexplode("keys").alias("band", "h")).unionByName(rare)
        buckets = scratch.table(held.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
        inside = scratch.table(held.join(buckets, "h"))  # classes that share a bucket, once for each such bucket
        size = member.where("keys is not null").select("rid", "n")
        weight = scratch.table(inside.groupBy("rid").agg(F.sum("c").alias("w")))
        leaders = inside.join(weight, "rid").groupBy("h").agg(F.max(F.struct("w", (-F.col("rid")).alias("r"))).alias("top"))
        leaders = scratch.table(leaders.select("h", F.col("top.w").alias("w"), (-F.col("top.r")).alias("b")))
        pairs = scratch.table(inside.select("h", F.col("rid").alias("a")).join(leaders, "h").where("a <> b").select("a", "b", "w").distinct())
        best = pairs.groupBy("a").agg(F.max(F.struct("w", (-F.col("b")).alias("r"))).alias("top"))
        best = scratch.table(best.select("a", (-F.col("top.r")).alias("b")))
        texts = scratch.table(read.select("rid", "n", "payload").join(inside.select("rid").distinct(), "rid"))
        comp = components(scratch.table(_links(best, texts, percent)), scratch)
        rest = pairs.join(best.withColumnRenamed("b", "tried"), "a").where("b <> tried")
        for side in "ab":
            rest = rest.join(comp.select(F.col("v").alias(side), F.col("comp").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        comp = _merged(comp, scratch.table(rest.where("ca <> cb").select("a", "b")), texts, percent, scratch)

        # 3. pairs across components in one bucket
        where = inside.select("h", "rid").join(comp.select(F.col("v").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        where = scratch.table(where)
        unlike = where.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
        where = meet(where, scratch.table(unlike.select("h", "c")), ["h"], "c", where.count()).join(size, "rid")
        mixed_ = where.select("rid", "n", "comp").distinct()
        across = _sharing(texts.select("rid", "payload").join(mixed_, "rid").select("rid", "n", "comp", "payload"), percent, scratch)
        tried = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        across = across.distinct().join(tried, ["a", "b"], "left_anti")
        comp = _merged(comp, scratch.table(across), texts, percent, scratch)

        # classes to components to the least doc_id in each
        label = member.join(comp.select(F.col("v").alias("rep"), "comp"), "rep", "left").select("doc_id", "n", F.coalesce("comp", "rep").alias("comp"))
        label = scratch.table(label)
        least = label.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("least")).where("c > 1")
        least = scratch.table(least.select("comp", "least"))
        out = label.join(least, "comp", "left").withColumn("component_id", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least")))
        return scratch.result(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def _prefixes(shingle: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """From (rid, n, s) and more columns: s, c, p for each set's rarest shingles that other sets have too.

    Shingles are ordered by their number of sets (c), then hash; p is the place in that order, from 0. Two alike
    sets share one of the first of either, as many as such a set may lack and one.
    """
    often = scratch.table(shingle.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    own = [c for c in shingle.columns if c != "s"]
    met = meet(shingle, often, ["s"], "c", shingle.select("rid").distinct().count())
    order = met.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o"))
    single = F.col("n") - F.size("o")  # shingles of this set alone come first
    most = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - single).cast("int")
    return order.where(most > 0).withColumn("_single", single).select(*own, "_single", F.posexplode(F.slice("o", F.lit(1), most)).alias("p", "x")).select(*own, "x.s", "x.c", (F.col("p") + F.col("_single")).alias("p"))


def _rarest(member: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """rid, band (-1), h: a bucket of each short set for each of its rarest shingles."""
    shingle = scratch.table(member.where("short is not null").select("rid", "n", F.explode("short").alias("s")))
    return _prefixes(shingle, percent, scratch).select("rid", F.lit(-1).alias("band"), F.xxhash64("s").alias("h"))


def _sharing(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of sets (rid, n, comp, payload), pairs of different components that can be alike: none that is alike is left out."""
    shingle = scratch.table(sets.mapInArrow(_hashed(), "rid long, n long, comp long, s long"))
    first = scratch.table(_prefixes(shingle, percent, scratch))
    scratch.drop(shingle)
    counts = first.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.groupBy("s").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m")).where("top.c < m")
    counts = scratch.table(counts.select("s", "m", F.col("top.c").alias("d"), F.col("top.comp").alias("top")))
    first = scratch.table(meet(first.drop("c"), counts, ["s"], "m", first.count()))
    few = first.where(F.col("m") <= FEW)
    x, y = (few.select("s", *(F.col(c).alias(v + side) for c, v in (("rid", ""), ("comp", "c"), ("n", "n"), ("p", "p")))) for side in "ab")
    ok = (F.col("ca") < F.col("cb"),) + _fits(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
    pairs = x.join(y, "s").where(reduce(and_, ok)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    many = first.where(F.col("m") > FEW)
    return pairs if many.isEmpty() else pairs.unionAll(_large(many, percent))


def _merged(comp: DataFrame, pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Components once those of some pairs that are alike are linked too."""
    if pairs.isEmpty():
        return comp
    more = scratch.table(_links(pairs, texts, percent))
    if more.isEmpty():
        return comp
    return components(comp.select(F.col("v").alias("a"), F.col("comp").alias("b")).unionAll(more.select("a", "b")), scratch)


def _large(many: DataFrame, percent: int) -> DataFrame:
    """Pairs across components that share a frequent shingle, by units of at most about two ``PART`` rows.

    The shingle's largest component and the rest are dealt into parts by hash. Units are every part of the
    one with every part of the other, and every two parts of the rest.
    """
    parts = lambda n: F.ceil(n / PART).cast("long")
    main = F.col("comp") == F.col("top")
    many = many.withColumn("main", main).withColumn("cd", parts(F.col("d"))).withColumn("cr", parts(F.col("m") - F.col("d")))
    many = many.withColumn("part", F.pmod(F.xxhash64("rid"), F.when(F.col("main"), F.col("cd")).otherwise(F.col("cr"))))
    each = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    unit = lambda a, b: F.struct(a.alias("i"), b.alias("j"))
    with_main = each("cd", lambda i: unit(i, F.col("part")))
    among = each("cr", lambda j: unit(-1 - F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    units = F.when(F.col("main"), each("cr", lambda j: unit(F.col("part"), j))).otherwise(F.concat(with_main, among))
    many = many.withColumn("u", F.explode(units)).select("s", "rid", "comp", "n", "p", "main", F.col("u.i").alias("i"), F.col("u.j").alias("j"), (F.col("part") == -1 - F.col("u.i")).alias("left"), (F.col("u.j") == -1 - F.col("u.i")).alias("alone"))
    return many.groupBy("s", "i", "j").applyInArrow(_across(percent), "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that are alike."""
    a, b = (texts.select(F.col("rid").alias(c), F.col("payload").alias(f"p{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "pa", "pb").mapInArrow(_confirm(percent), "a long, b long")
