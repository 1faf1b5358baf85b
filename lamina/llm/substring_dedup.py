"""Repeated passages by compaction of a De Bruijn graph over selected word k-mers."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, WordHashes, long_key, meet, mixed, slices

K = 8  # words of a node of the graph; fewer where windows are shorter
BLOCK = 1 << 18  # bytes of text in a block of documents
_one, _two = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


class Sums:
    """Rolling hashes over the words of some documents end to end."""

    def __init__(self, words: list[bytes], hashes: WordHashes):
        h = hashes(words)
        self.one = _one.sums(h)
        self.two = _two.sums(mixed(h ^ np.uint64(0x94D049BB133111EB)))

    def keys(self, at: np.ndarray, size: int):
        """Distinct 128-bit keys of the windows at some places in order, as two arrays; each window's among them; their counts."""
        one, two = (r.of(s, at, at + size).view(np.int64) for r, s in ((_one, self.one), (_two, self.two)))
        order = np.argsort(one, kind="stable")
        one, two = one[order], two[order]
        new = np.ones(len(at), dtype=bool)
        if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():  # keys that agree in their first half
            again = np.lexsort((two, one))
            order, one, two = order[again], one[again], two[again]
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        inverse = np.empty(len(at), dtype=np.int64)
        inverse[order] = np.cumsum(new) - 1
        return one[new], two[new], inverse, np.diff(np.append(np.flatnonzero(new), len(at)))


def edges_of(words: list[bytes], lengths: np.ndarray, hashes: WordHashes, size: int):
    """Edges of a block's documents in turn: node, label, first window's place, number of windows.

    A window is ``size`` consecutive words of one document. Of the k-mers in it, its node is the one with the
    smallest hash, the leftmost at a tie: windows with equal words have their node at the same place in them.
    An edge is the run of words of neighbouring windows with one node, labelled by the hash of all its words and
    the node's place among them; it leads on to the edge that starts with the next window.
    """
    n, k = len(words), min(K, size)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(n)
    start = at[ends - at >= size]
    if not len(start):
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    s = Sums(words, hashes)
    kmer = _one.of(s.one, at[: n - k + 1], at[: n - k + 1] + k)
    best, span, want = np.arange(len(kmer)), 1, size - k + 1
    while span < want:  # best[i]: the place of the least k-mer of ``span`` from i
        step = min(span, want - span)
        left, right = best[:-step], best[step:]
        best, span = np.where(kmer[left] <= kmer[right], left, right), span + step
    node = best[start]
    first = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    last = np.append(first[1:], len(node)) - 1
    a, b, node = start[first], start[last] + size, node[first]
    label = mixed(_one.of(s.one, a, b) ^ (_two.of(s.two, a, b) + np.uint64(7)) ^ ((node - a) * 65536 + (b - a)).astype(np.uint64))
    return kmer[node], label, a, last - first + 1


def _row(x: np.ndarray, kind=np.int64) -> pa.Array:
    """One row with a list."""
    return pa.ListArray.from_arrays([0, len(x)], pa.array(x.astype(kind, copy=False)))


BLOCKS = "block long, ids array<long>, payload binary, nodes array<long>, labels array<long>, starts array<int>, counts array<int>"


def _blocks(size: int):
    import zstandard

    def run(batches):
        pack, hashes, n = zstandard.ZstdCompressor(level=3), WordHashes(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for s in slices(batch, limit=BLOCK):
                docs = [(t or b"").split() for t in s.column(1).cast(pa.binary()).to_pylist()]
                node, label, start, count = edges_of([w for d in docs for w in d], np.array([len(d) for d in docs]), hashes, size)
                payload = pack.compress(b"\n".join(map(b" ".join, docs)))
                ids = pa.ListArray.from_arrays([0, len(docs)], s.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), ids, pa.array([payload]), _row(node.view(np.int64)), _row(label.view(np.int64)), _row(start, np.int32), _row(count, np.int32)], [c.split()[0] for c in BLOCKS.split(", ")])
                n += 1

    return run


def _open(payload: bytes) -> bytes:
    """A block's words, documents by lines."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(payload)


def _windows(words: list[bytes], hashes: WordHashes, starts, counts, met: np.ndarray, size: int):
    """Places of the windows of branching nodes' edges, and hashes and places among the words that such windows cover."""
    parted = met[met & 1 == 1] >> 1
    starts, counts = np.array(starts), np.array(counts)
    at = _places(starts, counts, parted)
    edge = np.bincount(starts[parted], minlength=len(words) + 1) - np.bincount(starts[parted] + counts[parted] - 1 + size, minlength=len(words) + 1)
    cover = np.cumsum(edge)[: len(words)] > 0
    return at, Sums(list(compress(words, cover.tolist())), hashes), (np.cumsum(cover) - 1)[at]


def _places(starts: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places of all windows of some edges."""
    c = counts[edges].astype(np.int64)
    return np.repeat(starts[edges] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum()) if len(edges) else np.empty(0, np.int64)


def _walks(batches):
    """From block, nodes, starts, counts, met: each edge whose label its node always has, with the nodes of such edges next to it."""
    names = ["node", "to", "back", "block", "edge"]
    for batch in batches:
        for block, nodes, starts, counts, met in zip(*(batch.column(i).to_pylist() for i in range(5))):
            nodes, starts, counts, met = np.array(nodes), np.array(starts), np.array(counts), np.array(met)
            on = np.zeros(len(nodes) + 1, dtype=bool)
            on[met[met & 1 == 0] >> 1] = True
            go = np.zeros(len(nodes) + 1, dtype=bool)  # whether an edge and the one before it are both such and follow one another
            go[1:-1] = on[:-2] & on[1:-1] & (starts[1:] == starts[:-1] + counts[:-1])
            own = np.flatnonzero(on)
            to = pa.array(nodes[np.minimum(own + 1, len(nodes) - 1)], pa.int64(), mask=~go[own + 1])
            back = pa.array(nodes[np.maximum(own - 1, 0)], pa.int64(), mask=~go[own])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), to, back, pa.array(np.full(len(own), block, dtype=np.int64)), pa.array(own.astype(np.int32))], names)


def _paths(walks: DataFrame, scratch: Scratch) -> DataFrame:
    """head, n, length, block, edge: maximal nonbranching paths of repeated edges, by their first node; how often each occurs, its
    number of edges, and where it occurs first.

    An edge leads on without branching if every walk through its node goes to the same next node, and every walk
    through that comes from it. Each node gets its predecessor, and predecessors of predecessors are joined, twice
    as far in each round, until all nodes have their path's first. Nodes on a circle have none: each stays a path.
    """
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    points = walks.groupBy("node").agg(F.count(F.lit(1)).alias("n"), one("to").alias("to"), one("back").alias("back"), F.min(F.struct("block", "edge")).alias("first"))
    points = scratch.table(points.select("node", "n", "to", "back", "first.block", "first.edge"))
    links = points.where("to is not null").select(F.col("node").alias("up"), F.col("to").alias("v"))
    links = points.select(F.col("node").alias("v"), "back").join(links, "v").where("back = up").select(F.col("v").alias("node"), "up")
    state = points.select("node").join(links.hint("merge"), "node", "left")
    state = scratch.table(state.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("hops"), F.col("up").isNull().alias("done")))
    for _ in range(points.count().bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        above = state.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("hops").alias("more"), F.col("done").alias("end"))
        moved = state.where("not done").join(above, "up").select("node", F.col("top").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), F.col("end").alias("done"))
        old, state = state, scratch.table(state.where("done").unionByName(moved))
        scratch.drop(old)
    ended = F.col("done")
    state = state.select("node", F.when(ended, F.col("up")).otherwise(F.col("node")).alias("head"), F.when(ended, F.col("hops")).otherwise(F.lit(0)).alias("hops"))
    length = state.groupBy("head").agg((F.max("hops") + 1).cast("int").alias("length"))
    return scratch.table(points.select(F.col("node").alias("head"), "n", "block", "edge").join(length.hint("merge"), "head"))


def _between(starts, counts, edge: int, length: int, size: int) -> tuple[int, int]:
    """The words from the first window of a path of edges to its last."""
    return starts[edge], starts[edge + length - 1] + counts[edge + length - 1] - 1 + size


def _texts(size: int):
    """The words of paths where they occur first, compressed."""
    import zstandard

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for payload, starts, counts, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = _open(payload).split()
                text = [pack.compress(b" ".join(words[slice(*_between(starts, counts, x["edge"], x["length"], size))])) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([x["head"] for x in own], pa.int64()), pa.array(text, pa.binary())], ["head", "text"])

    return run


def _ask(size: int):
    """Windows of branching nodes' edges: keys that the block has once (asked), and those it has more often (told)."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for block, payload, starts, counts, met in zip(*(batch.column(i).to_pylist() for i in range(5))):
                _, sums, at = _windows(_open(payload).split(), hashes, starts, counts, np.array(met), size)
                one, two, _, n = sums.keys(at, size)
                lists = [_row(x[m]) for m in (n == 1, n > 1) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists], ["block", "ask_a", "ask_b", "tell_a", "tell_b"])

    return run


def _remove(size: int):
    import zstandard

    def run(batches):
        hashes, opener = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            for ids, payload, starts, counts, met, a, c, spans in zip(*(batch.column(i).to_pylist() for i in range(8))):
                text = _open(payload)
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for x in spans or []:
                    i, j = _between(starts, counts, x["edge"], x["length"], size)
                    if b" ".join(words[i:j]) == opener.decompress(x["text"]):
                        gone[i] += 1
                        gone[j] -= 1
                met = np.array(met or [], dtype=np.int64)
                if (met & 1).any():
                    at, sums, among = _windows(words, hashes, starts, counts, met, size)
                    one, two, inverse, n = sums.keys(among, size)
                    found = n > 1
                    if a:
                        a, c = np.array(a), np.array(c)
                        i = np.searchsorted(one, a)
                        while (other := two[i] != c).any():  # keys that agree in their first half
                            i[other] += 1
                        found[i] = True
                    at = at[found[inverse]]
                    gone[: len(words)] += np.bincount(at, minlength=len(words))[: len(words)]
                    gone -= np.bincount(at + size, minlength=len(words) + 1)
                keep = np.cumsum(gone)[: len(words)] <= 0
                left = np.concatenate([[0], np.cumsum(keep)]).tolist()
                rows, at = [[], [], [], []], 0
                for own in text.split(b"\n"):
                    n = own.count(b" ") + 1 if own else 0
                    removed = n - left[at + n] + left[at]
                    kept = own if not removed else b"" if removed == n else b" ".join(compress(words[at : at + n], keep[at : at + n].tolist()))
                    for column, v in zip(rows, (n, removed, hashlib.sha256(kept).hexdigest(), kept)):
                        column.append(v)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), pa.array(rows[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 35, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Every word goes that lies in a window of ``size`` words (2 or more) which starts anywhere else too.

    1. Documents are packed into compressed blocks with the edges of their walks through a De Bruijn graph, whose
       nodes are k-mers selected by hash (``edges_of``). One aggregation finds nodes met twice or more, and
       whether their edges always have one label.
    2. Repeated edges with one label are followed: where neither end branches they are contracted to paths, by
       joins of each node with its predecessor, twice as far in each round (``_paths``). A path is a long repeated
       span. Its words at the source coordinates of its first occurrence go to every other occurrence, which
       removes them if its own words there are the same, word by word.
    3. A node whose edges differ branches: windows on its edges are compared one by one, by 128-bit keys of
       their words, once per block.

    Blocks are joined to what was found by their ids. Nodes and keys that are frequent are summed on the map
    side; rows of hot ones meet their counts by broadcast (``meet``), or in merge joins that Spark splits.

    Null text has no words. Texts under ``size`` words lose nothing. Repeated rows are documents of their own,
    so both lose what they share. Null ids stay. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        blocks = scratch.table(docs.select(long_key(docs, key), F.col(text)).mapInArrow(_blocks(size), BLOCKS))
        met = blocks.select("block", F.posexplode(F.arrays_zip("nodes", "labels")).alias("edge", "e")).select("block", "edge", F.col("e.nodes").alias("node"), F.col("e.labels").alias("label"))
        nodes = met.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 1")
        nodes = scratch.table(nodes.select("node", "n", F.when(F.col("lo") == F.col("hi"), 0).otherwise(1).alias("parts")))
        total = blocks.agg(F.sum(F.size("nodes"))).first()[0] or 0
        met = meet(met.select("block", "edge", "node"), nodes, ["node"], "n", total).groupBy("block").agg(F.collect_list(F.col("edge") * 2 + F.col("parts")).alias("met"))
        met = scratch.table(met)  # as many as a block's edges
        scratch.drop(nodes)

        asked = blocks.select("block", "payload", "starts", "counts").join(met.where(F.exists("met", lambda p: p % 2 == 1)), "block").select("block", "payload", "starts", "counts", "met")
        asked = scratch.table(asked.mapInArrow(_ask(size), "block long, ask_a array<long>, ask_b array<long>, tell_a array<long>, tell_b array<long>"))
        ask = asked.select("block", F.explode(F.arrays_zip("ask_a", "ask_b")).alias("k")).select("block", F.col("k.ask_a").alias("a"), F.col("k.ask_b").alias("b"))
        tell = asked.select(F.explode(F.arrays_zip("tell_a", "tell_b")).alias("k")).select(F.col("k.tell_a").alias("a"), F.col("k.tell_b").alias("b"), F.lit(2).alias("n"))
        keys = ask.select("a", "b", F.lit(1).alias("n")).unionAll(tell).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        keys = scratch.table(keys.select("a", "b"))
        found = scratch.table(ask.join(keys, ["a", "b"]).groupBy("block").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")))
        scratch.drop(asked)
        scratch.drop(keys)

        shapes = blocks.select("block", "nodes", "starts", "counts").join(met, "block").select("block", "nodes", "starts", "counts", "met")
        walks = shapes.mapInArrow(_walks, "node long, to long, back long, block long, edge int")
        paths = _paths(walks, scratch)
        own = paths.groupBy("block").agg(F.collect_list(F.struct("head", "edge", "length")).alias("own"))
        texts = blocks.select("block", "payload", "starts", "counts").join(own.hint("merge"), "block").select("payload", "starts", "counts", "own")
        texts = scratch.table(texts.mapInArrow(_texts(size), "head long, text binary"))
        at = meet(walks.select(F.col("node").alias("head"), "block", "edge"), paths.select("head", "n", "length"), ["head"], "n", total)
        spans = scratch.table(at.join(texts, "head").groupBy("block").agg(F.collect_list(F.struct("edge", "length", "text")).alias("spans")))

        rows = blocks.select("block", "ids", "payload", "starts", "counts").join(met, "block", "left").join(found, "block", "left").join(spans, "block", "left")
        rows = rows.select("ids", "payload", "starts", "counts", "met", "a", "b", "spans")
        out = rows.mapInArrow(_remove(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
        return scratch.result(out if with_text else out.drop("kept_text"))
